"""Addresses, hosts, columns by pattern, and searches by vector."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """COLUMNS('pattern')."""
    return [c for c in df.columns if re.search(pattern, c)]


def star(df: DataFrame, except_: Sequence[str] = (), replace: dict[str, Column] | None = None, rename: dict[str, str] | None = None, ilike: str | None = None) -> DataFrame:
    """SELECT * EXCEPT / REPLACE / RENAME / ILIKE."""
    replace, rename = replace or {}, rename or {}
    known = set(df.columns)
    for c in [*except_, *replace, *rename]:
        if c not in known:
            raise ValueError(f"no column {c}")
    like = re.compile("^" + re.escape(ilike).replace("%", ".*").replace("_", ".") + "$", re.I) if ilike else None
    return df.select(*[replace.get(c, F.col(f"`{c}`")).alias(rename.get(c, c)) for c in df.columns if c not in except_ and (like is None or like.match(c))])


def ipv4_number(ip: Column) -> Column:
    """Dotted address as a number; null if malformed."""
    parts = F.split(ip, r"\.")
    ok = ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(ok, F.aggregate(F.transform(F.when(ok, parts), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda t, x: t * 256 + x))


def ipv4_text(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(n, k).bitwiseAND(F.lit(255)) for k in (24, 16, 8, 0)])


def ipv4_in(ip: Column, network: str) -> Column:
    """Whether an address lies in a network a.b.c.d/n."""
    base, bits = network.split("/")
    size = 1 << (32 - int(bits))
    number = sum(int(x) << k for x, k in zip(base.split("."), (24, 16, 8, 0), strict=True))
    return F.floor(ipv4_number(ip) / size) == number // size


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def public_suffix(url: Column, suffixes: Sequence[str]) -> Column:
    """The longest of the given suffixes that the host ends with, else its last label."""
    h = host(url)
    out = F.substring_index(h, ".", -1)
    for s in sorted(suffixes, key=len):
        out = F.when((h == s) | h.endswith("." + s), s).otherwise(out)
    return out


def registered_domain(url: Column, suffixes: Sequence[str]) -> Column:
    """The public suffix and one label before it."""
    h, s = host(url), public_suffix(url, suffixes)
    rest = F.substring(h, F.lit(1), F.length(h) - F.length(s) - 1)
    return F.when(F.length(rest) > 0, F.concat(F.substring_index(rest, ".", -1), F.lit("."), s))


def url_parameter(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


def xml_valid(s: Column) -> Column:
    """Whether a text has the outer form of an XML element."""
    return s.rlike(r"(?s)^\s*(<\?xml[^>]*\?>)?\s*<([A-Za-z_][\w.-]*)(\s[^>]*)?(/>|>.*</\2\s*>)\s*$")


def xml_element(name: str, *content: Column, attributes: dict[str, Column] | None = None) -> Column:
    escape = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c.cast("string"), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    attrs = [F.concat(F.lit(f' {k}="'), F.regexp_replace(escape(v), '"', "&quot;"), F.lit('"')) for k, v in (attributes or {}).items()]
    return F.concat(F.lit(f"<{name}"), *attrs, F.lit(">"), *[F.coalesce(escape(c), F.lit("")) for c in content], F.lit(f"</{name}>"))


DISTANCES = ("cosine", "euclidean", "manhattan", "dot")
BLOCK = 4096  # rows of a block of vectors


def vector_search(base: DataFrame, queries: DataFrame, vector: str, base_id: str, query_id: str, k: int, distance: str = "cosine", max_queries: int = 10_000) -> DataFrame:
    """The k nearest base rows of each query, exactly. Both sides are dealt into blocks by a hash, of about BLOCK base rows and
    max_queries queries; each pair of blocks is one group of a shuffle, which keeps its best k of a query. Nothing is
    broadcast. Vectors that are null, of unlike lengths or hold nulls have a null distance, which comes last."""
    if distance not in DISTANCES:
        raise ValueError(f"unknown distance {distance}")
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("v"))
    b = base.select(F.col(base_id).alias("match_id"), F.col(vector).alias("v"))
    n, m = max(1, -(-q.count() // max_queries)), max(1, -(-b.count() // BLOCK))
    block = lambda c, blocks: F.pmod(F.xxhash64(c, "v"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    q = q.withColumn("_q", block("query_id", n)).withColumn("_b", every(m))
    b = b.withColumn("_b", block("match_id", m)).withColumn("_q", every(n))
    schema = StructType([StructField("query_id", q.schema["query_id"].dataType), StructField("match_id", b.schema["match_id"].dataType), StructField("distance", DoubleType())])

    def nearest(q: pa.Table, b: pa.Table) -> pa.Table:
        return _nearest(q, b, k, distance)

    return top_matches(q.groupBy("_q", "_b").cogroup(b.groupBy("_q", "_b")).applyInArrow(nearest, schema), k)


def _nearest(q: pa.Table, b: pa.Table, k: int, distance: str) -> pa.Table:
    """The best k of the base rows for each query; base rows are put in order of their ids, so that positions break ties."""
    b = b.take(pc.sort_indices(b, sort_keys=[("match_id", "ascending")], null_placement="at_start"))
    parts = []
    mine, theirs = _by_length(q["v"]), _by_length(b["v"])
    for size, (at, x) in mine.items():
        base_at, y = theirs.get(size, (np.zeros(0, np.int64), np.zeros((0, max(size, 0)))))
        others = np.setdiff1d(np.arange(b.num_rows), base_at)[:k]
        if size >= 0 and len(base_at):
            for i in range(0, len(at), 128):
                parts.append(_best(x[i : i + 128], y, at[i : i + 128], base_at, k, distance))
        if size < 0 or len(base_at) < k:
            rest = np.arange(min(k, b.num_rows)) if size < 0 else others
            parts.append((np.repeat(at, len(rest)), np.tile(rest, len(at)), np.zeros(len(at) * len(rest)), np.ones(len(at) * len(rest), bool)))
    qi, bi, d, none = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
    return pa.table({"query_id": q["query_id"].take(pa.array(qi)), "match_id": b["match_id"].take(pa.array(bi)), "distance": pa.array(d, mask=none)})


def _by_length(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and matrix of the vectors of each length; those that are null or hold nulls have length -1."""
    v = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    lengths = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if v.flatten().null_count:
        parents = pc.list_parent_indices(v).to_numpy(zero_copy_only=False)
        lengths[parents[v.flatten().is_null().to_numpy(zero_copy_only=False)]] = -1
    out = {}
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        flat = v.take(pa.array(at)).flatten() if size >= 0 else None
        out[int(size)] = at, np.zeros((len(at), 0)) if flat is None else flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), int(size))
    return out


def _best(x: np.ndarray, y: np.ndarray, at: np.ndarray, base_at: np.ndarray, k: int, distance: str) -> tuple[np.ndarray, ...]:
    """Distances by matrix product, within an error that is bounded, choose what can be among the best k; the distances of
    these are added up in order, as Spark does, and ranked. Values far out of range are added up at once."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    tame = all(((s == 0) | ((s > 1e-200) & (s < 1e200))).all() for s in (xx, yy))
    error = 16 * (x.shape[1] + 8) * np.finfo(np.float64).eps
    if distance == "manhattan" or not tame:
        rough, slack = _exact(x[:, None, :], y[None, :, :], distance)[0], np.zeros(len(x))
    elif distance == "euclidean":
        rough, slack = xx[:, None] + yy[None, :] - 2 * (x @ y.T), error * (xx + yy.max())
    elif distance == "dot":
        rough, slack = -(x @ y.T), error * np.sqrt(xx * yy.max())
    else:
        unit = lambda m, s: m / np.sqrt(np.where(s > 0, s, np.nan))[:, None]
        rough, slack = -(unit(x, xx) @ unit(y, yy).T), np.full(len(x), error)
    last = np.partition(rough, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
    qi, bi = np.nonzero(~(rough > (last + slack)[:, None]))
    d, none = _exact(x, y, distance, qi, bi)
    order = np.lexsort((bi, d, none, qi))
    qi, bi, d, none = qi[order], bi[order], d[order], none[order]
    best = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return at[qi[best]], base_at[bi[best]], d[best], none[best]


def _exact(x: np.ndarray, y: np.ndarray, distance: str, qi: np.ndarray | None = None, bi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distances of pairs of rows, or of all rows that broadcast, added up from the first coordinate on; and which are null."""
    coordinate = lambda m, at, j: m[..., j] if at is None else m[at, j]

    def total(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        out = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]) if qi is None else len(qi))
        for j in range(x.shape[-1]):
            out += f(coordinate(x, qi, j), coordinate(y, bi, j))
        return out

    with np.errstate(all="ignore"):
        if distance == "cosine":
            norms = np.sqrt(total(lambda a, b: a * a)) * np.sqrt(total(lambda a, b: b * b))
            none = norms == 0
            return np.where(none, np.nan, 1 - total(lambda a, b: a * b) / norms), none
        d = {"euclidean": lambda: np.sqrt(total(lambda a, b: (a - b) * (a - b))), "manhattan": lambda: total(lambda a, b: np.abs(a - b)), "dot": lambda: -total(lambda a, b: a * b)}[distance]()
    return d, np.zeros(d.shape, bool)


def top_matches(near: DataFrame, k: int) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "match_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
