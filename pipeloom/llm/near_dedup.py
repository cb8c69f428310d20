"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set holds its distinct SHINGLE-word shingles, A-Z in lower case (with
fewer words, the whole sequence as one). Documents with
100 * |A & B| >= PERCENT * |A | B| are linked; components of links are groups.

1. Sketch of COORDS coordinates: in round i < COORDS every element falls into a
   hashed bin with the value (i, hash); in round COORDS + j every element falls
   into bin j. A bin keeps its least value; rounds end when all bins are filled,
   which the later rounds force. Coordinates of two sets agree with a chance equal
   to their similarity, and concentrate as independent ones do.
2. Documents with equal sets are one class (128-bit hash of the set).
3. Bands of ROWS coordinates: classes that share a band share a bucket; of buckets with the
   same classes one is looked at.
4. Candidates: in each bucket the classes whose sizes fit and whose sketches agree in
   LEAST of the coordinates or more are joined by a spanning forest, not by all pairs; buckets
   above CROWD hang on one hub instead. Components of these edges hold every link between candidates.
5. Exact verification: the classes of a candidate component meet in blocks of about
   BLOCK with their texts (some in all blocks of their component, as pivots); links are tried on the full sets, most similar sketches
   first, and only between classes not yet connected, so a block gives a spanning forest
   of its links and stops early. Where a component of several blocks still holds more
   than one group, the classes outside of its largest group are compared with every
   block too: work there grows with the product of the two, so a component with very many
   similar classes that aren't linked is slow. No pair list is made and no task holds a whole group.

Components are found by rounds of contraction: every node goes to its least neighbour (a minimum that
is combined in tasks before the shuffle, so hubs are harmless), and edges between what is left go on.

A pair at similarity 0.8 is missed with a chance of about 6e-8: 4.7e-8 by the bands (32 of 4) and 0.9e-8 by LEAST.

Texts are shuffled only for candidates, once each.

Defined results: null, empty and blank texts have the empty set and are linked with
nothing; rows with equal sets, repeated rows included, are one group; a null doc_id
never names a group unless all ids of the group are null; an empty table gives an
empty table. Whole texts count, of any length: a text's shingles are hashed in one array in the task that
reads it. Other columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import bitmap, materialise, may_match
from ._words import SPACED, U, chunks, grams, mix, numbers, split

SHINGLE, PERCENT = 4, 80
COORDS, ROWS = 128, 4
LEAST = 0.58
BLOCK, CROWD, PIVOTS = 384, 1024, 48
_SEEDS = numbers(2 * COORDS, 7)
_FULL = U(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = split(texts, SPACED, True)
    g = grams(w.hash, shingle)
    out = []
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        n = hi - lo
        out.append(np.unique(g[lo : hi - shingle + 1]) if n >= shingle else grams(w.hash[lo:hi], n) ^ U(n) if n else np.zeros(0, U))
    return out


def sketch(x: np.ndarray) -> np.ndarray:
    """Fast similarity sketch of a set that isn't empty."""
    out = np.full(COORDS, _FULL)
    i = 0
    while i < 2 * COORDS:
        to = min(2 * COORDS if i >= COORDS else COORDS, i + max(1, 3 * COORDS // len(x)))
        h = mix(x[None, :] ^ _SEEDS[i:to, None])
        rounds = np.arange(i, to, dtype=U)[:, None]
        bins = (h >> U(57)).astype(np.int64) if i < COORDS else np.broadcast_to((rounds - U(COORDS)).astype(np.int64), h.shape)
        np.minimum.at(out, bins.ravel(), ((rounds << U(56)) | (h & U((1 << 56) - 1))).ravel())
        if out.max() < _FULL:
            break
        i = to
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def _features(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch):
                sets = shingle_sets(b.column("text"), shingle)
                cid = [np.array([mix(x).sum(), mix(x ^ U(0x5DEECE66D)).sum()], U).tobytes() if len(x) else None for x in sets]
                small = [short_sketch(x).tobytes() if len(x) else None for x in sets]
                cols = [b.column("doc_id"), b.column("th1"), b.column("th2"), pa.array([len(x) for x in sets], pa.int64()), pa.array(cid, pa.binary()), pa.array(small, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th1", "th2", "n", "cid", "sketch"])

    return docs.select("doc_id", "th1", "th2", "text").mapInArrow(run, "doc_id long, th1 long, th2 long, n long, cid binary, sketch binary")


def short_sketch(x: np.ndarray) -> np.ndarray:
    """16 bits of each coordinate."""
    return (mix(sketch(x)) & U(0xFFFF)).astype(np.uint16)


def _matrix(table: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), np.uint16).reshape(-1, COORDS)


def fitting(n: np.ndarray, s: np.ndarray, p: np.ndarray, q: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs (p, q) whose sizes n and sketches s allow a link, and in how many coordinates they agree."""
    ok = 100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q])
    p, q = p[ok], q[ok]
    alike = np.concatenate([np.zeros(0, np.int64), *[(s[p[k : k + 32768]] == s[q[k : k + 32768]]).sum(1) for k in range(0, len(p), 32768)]])
    ok = alike >= LEAST * COORDS
    return p[ok], q[ok], alike[ok]


def by_group(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of neighbouring rows that agree in columns, and the number of each row's group."""
    rest: list[pa.Table] = []
    for batch in itertools.chain(batches, [None]):
        table = pa.concat_tables([*rest, *([pa.Table.from_batches([batch])] if batch is not None else [])]) if rest or batch is not None else None
        if table is None or not table.num_rows:
            continue
        new = np.zeros(table.num_rows, bool)
        for c in columns:
            x = np.asarray(table.column(c).to_pylist(), object) if pa.types.is_binary(table.schema.field(c).type) else table.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        group = np.cumsum(new)
        cut = len(group) if batch is None else int(np.searchsorted(group, group[-1]))  # the last group may go on
        rest = [table.slice(cut)] if cut < len(group) else []
        if cut:
            yield table.slice(0, cut), group[:cut]


def _bucket_forests(rows: DataFrame, percent: int) -> DataFrame:
    """Spanning edges of the candidates in each bucket of CROWD classes at most, as stars on their least class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in by_group(batches, ("key",)):
            n, s, k = table.column("n").to_numpy(), _matrix(table, "sketch"), table.column("k").to_numpy()
            p, q = [], []
            for lag in range(1, int(np.bincount(group).max())):
                at = np.flatnonzero(group[lag:] == group[:-lag])
                x, y, _ = fitting(n, s, at, at + lag, percent)
                p.append(x), q.append(y)
            label = np.arange(table.num_rows)
            if p:
                x, y = np.concatenate(p), np.concatenate(q)
                while True:  # least reachable row, by minima and jumps
                    before = label
                    low = np.minimum(label[x], label[y])
                    label = label.copy()
                    np.minimum.at(label, x, low)
                    np.minimum.at(label, y, low)
                    label = label[label]
                    if (label == before).all():
                        break
            at = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(k[label[at]], pa.int64()), pa.array(k[at], pa.int64())], ["a", "b"])

    return rows.select("key", "k", "n", "sketch").repartition("key").sortWithinPartitions("key", "k").mapInArrow(run, "a long, b long")


def block_links(sets: list[np.ndarray], s: np.ndarray, comp: np.ndarray, p: np.ndarray, q: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links among the pairs (p, q) that join different components, tried from the most similar sketches on."""
    n = np.array([len(x) for x in sets])
    p, q, alike = fitting(n, s, p, q, percent)
    root = comp.copy()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for k in np.argsort(-alike, kind="stable").tolist():
        a, b = find(int(p[k])), find(int(q[k]))
        if a != b:
            both, all_ = similarity(sets[p[k]], sets[q[k]])
            if 100 * both >= percent * all_:
                root[max(a, b)] = min(a, b)
                out.append((int(p[k]), int(q[k])))
    return out


def _links(rows: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Spanning links (a, b) between the groups comp of the texts in each (cand, y, z); pairs are those of two rows of side 0, or of one of each side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in by_group(batches, ("cand", "y", "z")):
            bounds = np.flatnonzero(np.diff(group, prepend=-1, append=group[-1] + 1))
            a, b = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                part = table.slice(lo, hi - lo).combine_chunks()
                comps, side = part.column("comp").to_numpy(), part.column("side").to_numpy()
                sets = shingle_sets(part.column("text").combine_chunks(), shingle)
                comp = np.unique(comps, return_index=True)[1][np.unique(comps, return_inverse=True)[1]]  # first row of each row's group
                p, q = np.triu_indices(hi - lo, 1)
                ok = (comp[p] != comp[q]) & (side[p] != side[q]) if side.any() else comp[p] != comp[q]
                for i, j in block_links(sets, _matrix(part, "sketch"), comp, p[ok], q[ok], percent):
                    a.append(int(comps[i])), b.append(int(comps[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = rows.select("cand", "y", "z", "side", "comp", "sketch", "text")
    return rows.repartition("cand", "y", "z").sortWithinPartitions("cand", "y", "z").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(k, comp) of every node with an edge (a, b) to another one; comp is one node of its component.

    A round sends every node to the least of itself and its neighbours and keeps the edges that still join two nodes. Minima
    are taken in the order of the numbers in the first rounds, which collapses stars on their least node at once, and then in
    a hashed order, new each round, under which a constant share of the nodes goes, chains in order of their numbers included."""
    left = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    maps: list[DataFrame] = []
    while True:
        left = materialise(left, "edges")
        if maps and left.isEmpty():
            break
        hashed = len(maps) > 1
        name = lambda c: F.struct(*[F.xxhash64(F.lit(len(maps)), c).alias("h")] * hashed, F.col(c).alias("k"))  # noqa: B023, E731
        both = left.select("u", "v").union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(name("v") if hashed else F.col("v")).alias("low"))
        low = low.select(F.col("u").alias("k"), F.least(name("u"), F.col("low"))["k"].alias("comp") if hashed else F.least("u", "low").alias("comp"))
        low = materialise(low, "low")
        maps.append(low)
        step = left.join(low.withColumnsRenamed({"k": "u", "comp": "x"}), "u").join(low.withColumnsRenamed({"k": "v", "comp": "y"}), "v").where("x != y")
        left = step.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    out = maps[-1]
    for low in reversed(maps[:-1]):
        out = low.join(out.select(F.col("k").alias("comp"), F.col("comp").alias("next")), "comp", "left").select("k", F.coalesce("next", "comp").alias("comp"))
    return out


def text_keys(text: Column) -> dict[str, Column]:
    """128 bits of a text."""
    text = F.coalesce(text, F.lit(""))
    return {"th1": F.xxhash64(text), "th2": F.xxhash64(F.lit(1), text)}


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """k, its candidate component cand, the component's number of blocks and the class's own block y."""
    bands = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 1 + 2 * ROWS * i, 2 * ROWS)) for i in range(COORDS // ROWS)]))
    bands = classes.select("k", bands.alias("key"))
    buckets = bands.groupBy("key").agg(F.min("k").alias("hub"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("k")).alias("all")).where("c > 1")
    buckets = buckets.groupBy("hub", "c", "all").agg(F.min("key").alias("key")).drop("all")
    members = materialise(bands.join(buckets, "key"), "members")
    forests = _bucket_forests(members.where(f"c <= {CROWD}").select("key", "k").join(classes.select("k", "n", "sketch"), "k"), percent)
    stars = members.where(f"c > {CROWD} AND k != hub").select(F.col("hub").alias("a"), F.col("k").alias("b"))
    cands = materialise(components(forests.union(stars)).withColumnRenamed("comp", "cand"), "cands")
    blocks = cands.groupBy("cand").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return cands.join(blocks, "cand").withColumn("y", F.pmod(F.xxhash64("k"), "blocks").cast("int"))


def _with_pivots(found: DataFrame) -> DataFrame:
    """Every candidate in its own block y; about PIVOTS of a component of several blocks in all its blocks, to tie them together."""
    pivot = F.pmod(F.xxhash64(F.lit(2), "k"), F.col("blocks") * BLOCK) < PIVOTS
    others = found.where((F.col("blocks") > 1) & pivot).withColumnRenamed("y", "own").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("y != own")
    return found.unionByName(others.drop("own")).withColumns({"z": F.lit(0), "side": F.lit(0), "comp": F.col("k")})


def _crossings(wide: DataFrame) -> DataFrame | None:
    """Where a candidate component of several blocks holds several groups: every block of it (side 0) with the classes
    outside of its largest group, in blocks z of their own (side 1). Columns cand, y, z, side, k, comp; None if there is none."""
    sizes = wide.groupBy("cand", "comp").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("cand").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("all")).select("cand", F.col("m.comp").alias("most"), F.ceil((F.col("all") - F.col("m.n")) / BLOCK).cast("int").alias("zs")).where("zs > 0")
    largest = materialise(largest, "largest")
    if largest.isEmpty():
        return None
    rows = wide.join(largest, "cand").withColumn("y", F.pmod(F.xxhash64("k"), "blocks").cast("int"))
    own = rows.select("cand", "y", F.explode(F.sequence(F.lit(0), F.col("zs") - 1)).alias("z"), F.lit(0).alias("side"), "k", "comp")
    minor = rows.where("comp != most").withColumn("z", F.pmod(F.xxhash64(F.lit(1), "k"), "zs").cast("int"))
    minor = minor.select("cand", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), "z", F.lit(1).alias("side"), "k", "comp")
    return own.union(minor)


def groups(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, th1, th2 (of the text), n_shingles, component_id and group (a name of the component; null if the set is empty) of every row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns(text_keys(F.col("text")))
    feats = materialise(_features(docs, shingle), "features")
    text = F.min(F.struct("th1", "th2"))
    classes = feats.where("n > 0").groupBy("cid").agg(F.first("n").alias("n"), F.min("doc_id").alias("first_id"), F.count("*").alias("rows"), text.alias("t"), F.first("sketch").alias("sketch"))
    # Written once, so the numbers stay as they are.
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("k"), "cid", "n", "first_id", "rows", "t.th1", "t.th2", "sketch"), "classes")
    cands = _candidates(classes, percent)
    found = materialise(cands.join(classes.select("k", "th1", "th2", "sketch"), "k"), "found")
    texts = may_match(docs.select("th1", "th2", "text"), "th1", bitmap(found, F.col("th1"))).dropDuplicates(["th1", "th2"])  # copies of a text are as many as they like
    found = materialise(found.join(texts, ["th1", "th2"]).select("k", "cand", "blocks", "y", "sketch", "text"), "texts")

    comps = components(_links(_with_pivots(found), percent, shingle))
    wide = found.where("blocks > 1").select("cand", "k", "blocks").join(comps, "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    rest = _crossings(materialise(wide, "wide"))
    if rest is not None:
        more = components(_links(rest.join(found.select("k", "sketch", "text"), "k"), percent, shingle)).select(F.col("k").alias("comp"), F.col("comp").alias("next"))
        alone = more.select(F.col("comp").alias("k"), "comp").join(comps, "k", "left_anti")  # groups of one class so far
        comps = comps.union(alone).join(more, "comp", "left").select("k", F.coalesce("next", "comp").alias("comp"))
    linked = classes.select("k", "cid", "first_id", "rows").join(comps, "k", "left").where("rows > 1 OR comp IS NOT NULL").withColumn("comp", F.coalesce("comp", "k"))
    linked = materialise(linked, "linked")
    named = linked.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    names = linked.join(named, "comp").select("cid", "comp", "component_id")
    out = feats.select("doc_id", "th1", "th2", "n", "cid").join(names, "cid", "left")
    return out.select("doc_id", "th1", "th2", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("comp").cast("string"), F.hex("cid")).alias("group"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(documents: DataFrame, **how: int) -> DataFrame:
    """The documents without near copies: one row of each group, that of the least doc_id, and all rows with an empty set.
    All columns of documents come back as they are, whatever their names."""
    found = groups(documents, **how)
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null")).alias("name")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th1", "th2"))
    stays = found.where("group IS NOT NULL").groupBy("group").agg(first.alias("s")).select(name(F.col("s.doc_id")), "s.th1", "s.th2")
    keys = text_keys(F.col("text"))
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = documents.select(F.struct("*").alias("row"), name(F.col("doc_id")), keys["th1"].alias("th1"), keys["th2"].alias("th2"), blank.alias("blank"))
    kept = own.where("NOT blank").join(stays, ["name", "th1", "th2"], "left_semi").dropDuplicates(["name", "th1", "th2"])
    return kept.select("row.*").union(own.where("blank").select("row.*"))
