"""String, binary and hash functions that Spark lacks or spells differently."""

from __future__ import annotations

import base64
import unicodedata
import zlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType


def split_literal(s: Column, separator: str) -> Column:
    """Split at a literal text (Spark's split takes a pattern)."""
    quoted = "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.split(s, quoted, -1)


def regexp_replace_first(s: Column, pattern: str, replacement: str) -> Column:
    """Replace the first match only (Spark replaces all)."""
    at = F.regexp_instr(s, F.lit(pattern))
    found = F.regexp_substr(s, F.lit(pattern))
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.lit(replacement), F.substring(s, at + F.length(found), F.length(s)))).otherwise(s)


def concat_skipping_nulls(*cs: Column) -> Column:
    """Concatenation in which null counts as empty."""
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in cs])


def substring_zero(s: Column, start: int, length: int) -> Column:
    """substring whose position 0 counts, so that it yields a character less."""
    return F.substring(s, 1, max(0, length - 1)) if start == 0 else F.substring(s, start, length)


def code_points(s: Column) -> Column:
    """Code points of the characters."""
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c))


def from_code_points(a: Column) -> Column:
    return F.array_join(F.transform(a, _char), "")


def _char(c: Column) -> Column:
    """UTF-8 of a code point (Spark's chr knows 8 bits only)."""
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    more = lambda k: byte(F.lit(0x80).bitwiseOR(F.shiftright(c, k).bitwiseAND(F.lit(0x3F))))
    lead = lambda head, k: byte(F.lit(head).bitwiseOR(F.shiftright(c, k)))
    code = F.when(c < 0x80, byte(c)).when(c < 0x800, F.concat(lead(0xC0, 6), more(0))).when(c < 0x10000, F.concat(lead(0xE0, 12), more(6), more(0))).otherwise(F.concat(lead(0xF0, 18), more(12), more(6), more(0)))
    return F.decode(F.unhex(code), "UTF-8")


def code_points_to_bytes(a: Column) -> Column:
    return F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def md5_upper64(s: Column) -> Column:
    """First 64 bits of the MD5 as an unsigned number in decimal digits."""
    return F.conv(F.substring(F.md5(s.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def md5_lower64(s: Column) -> Column:
    return F.conv(F.substring(F.md5(s.cast("binary")), 17, 16), 16, 10).cast("decimal(20,0)")


def initcap_delimited(s: Column, delimiters: str = " ") -> Column:
    """Upper case after any of the delimiters, lower case elsewhere."""
    out = F.lower(s)
    for d in delimiters:
        out = F.array_join(F.transform(split_literal(out, d), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), d)
    return out


def contains_words(s: Column, query: str, every: bool = True) -> Column:
    """Full-text match: whether the lower-case words of the text hold all (any) words of the query."""
    words = F.split(F.lower(s), r"[^\p{L}\p{N}]+")
    wanted = F.split(F.lower(F.lit(query)), r"[^\p{L}\p{N}]+")
    return F.size(F.array_except(wanted, words)) == 0 if every else F.arrays_overlap(words, wanted)


def similar_to(s: Column, pattern: str) -> Column:
    """SQL SIMILAR TO: %, _ and regular expression operators over the whole text."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append("\\" + pattern[i + 1])
            i += 1
        else:
            out.append({"%": ".*", "_": ".", ".": "\\.", "^": "\\^", "$": "\\$"}.get(c, c))
        i += 1
    return s.rlike("(?s)^(?:" + "".join(out) + ")$")


def glob(s: Column, pattern: str) -> Column:
    """GLOB: *, ? and [sets]."""
    out = "".join({"*": ".*", "?": "."}.get(c, c if c in "[]-" or c.isalnum() else "\\" + c) for c in pattern.replace("[!", "[^")).replace("[\\^", "[^")
    return s.rlike(f"(?s)^{out}$")


def hamming(a: Column, b: Column) -> Column:
    """Positions in which two texts of equal length differ; null if lengths differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda t, x: t + x))


def jaccard_chars(a: Column, b: Column) -> Column:
    """Similarity of the sets of characters."""
    sets = [F.array_distinct(F.filter(F.split(x, ""), lambda c: c != "")) for x in (a, b)]
    return F.size(F.array_intersect(*sets)) / F.size(F.array_union(*sets))


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity, 0 to 1."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if x == y:
            return 1.0
        reach = max(0, max(len(x), len(y)) // 2 - 1)
        used = [False] * len(y)
        left = []
        for i, c in enumerate(x):
            for j in range(max(0, i - reach), min(len(y), i + reach + 1)):
                if not used[j] and y[j] == c:
                    used[j] = True
                    left.append(c)
                    break
        if not left:
            return 0.0
        right = [c for j, c in enumerate(y) if used[j]]
        m, t = len(left), sum(p != q for p, q in zip(left, right, strict=True)) // 2
        jaro = (m / len(x) + m / len(y) + (m - t) / m) / 3
        prefix = 0
        while prefix < min(4, len(x), len(y)) and x[prefix] == y[prefix]:
            prefix += 1
        return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


SLICE = 64  # rows of a batch that are Python objects at a time


def _by_slices(f: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """f of each row. Of a batch of long texts only a slice at a time is held as Python objects; the rest stays in Arrow."""
    starts = range(0, len(columns[0]), SLICE)
    return pa.concat_arrays([pa.array(map(f, *[c.slice(i, SLICE).to_pylist() for c in columns]), kind) for i in starts] or [pa.array([], kind)])


def _bytes(x: str | bytes) -> bytes:
    return x.encode() if isinstance(x, str) else x


@F.arrow_udf(StringType())
def normalize(s: pa.Array, form: pa.Array) -> pa.Array:
    """Unicode normal form NFC, NFD, NFKC or NFKD."""
    return _by_slices(lambda x, f: None if x is None else unicodedata.normalize(f, x), pa.string(), s, form)


@F.arrow_udf(BinaryType())
def compress(s: pa.Array) -> pa.Array:
    """zlib of the UTF-8 bytes."""
    return _by_slices(lambda x: None if x is None else zlib.compress(_bytes(x)), pa.binary(), s)


@F.arrow_udf(StringType())
def decompress_string(s: pa.Array) -> pa.Array:
    return _by_slices(lambda x: None if x is None else zlib.decompress(x).decode(), pa.string(), s)


@F.pandas_udf(StringType())
def to_base32(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else base64.b32encode(x.encode() if isinstance(x, str) else bytes(x)).decode())


@F.pandas_udf(StringType())
def from_base32(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else base64.b32decode(x).decode())
