"""MinHash near-dedup with min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so a
signature of 2P values costs P hash evaluations. Bands of the signature propose candidates; a link
counts only when the full shingle sets confirm it.

Plan: one pass over the texts gives each document its set size, a digest of its set and its band
hashes. Documents of equal sets collapse to the least id, so groups of copies cost nothing more. In
each band bucket every member is compared with one hub (a star, never all pairs). Buckets that still
hold several components then have what lies between those components compared: few pairs outright, and
more in blocks of BLOCK members against each other, whose tasks count common shingles by matrix products
and give back only links that join components. So every candidate pair of a bucket ends confirmed,
refuted or joined, and no task holds more than two blocks of a group.

With 25 bands of 5 values a pair at similarity 0.85 is missed with probability 4e-7.

Defined cases: null and empty texts, or texts of white space, have an empty set (n_shingles 0) and link
with nothing; texts of fewer words than a shingle are one shingle; rows that repeat a doc_id count
as one document if their texts agree, and otherwise each row has the component of its own text, where a link of
either text may count for both; rows without doc_id come back unlinked, with null component; an empty table
gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph

WIDTH = 5
PERMUTATIONS, BANDS, ROWS = 64, 25, 5
#: A bucket with at most so many pairs between its components has just those compared; others go by blocks.
MOST_PAIRS = 64
BLOCK = 256

_DRAW = np.random.Generator(np.random.PCG64(20240229))
_A = _DRAW.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _DRAW.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_C = _DRAW.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles."""
    words, counts = common.hashed_words(texts)
    n = len(words) - width + 1
    total = np.full(max(0, n), width, np.uint64)
    for i in range(width if n > 0 else 0):
        total += words[i : i + n] * _C[i]
    total = common.mix(total)
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(total[at : at + c - width + 1]))
        elif c:
            out.append(common.mix(np.array([(words[at : at + c] * _C[:c]).sum(dtype=np.uint64) + np.uint64(c)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def signature(x: np.ndarray) -> np.ndarray:
    """2P values: minimum and maximum of the set under each permutation."""
    out = np.empty((PERMUTATIONS, 2), np.uint64)
    least, most = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(x), 2048):  # bounds the memory that a very long text takes
        y = x[None, i : i + 2048] * _A[:, None] + _B[:, None]
        np.minimum(least, y.min(axis=1), out=least)
        np.maximum(most, y.max(axis=1), out=most)
    out[:, 0], out[:, 1] = least, most
    return out.ravel()


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    part = sig[: bands * rows].reshape(bands, rows)
    return common.mix((part * _C[:rows]).sum(axis=1, dtype=np.uint64) + _C[64 : 64 + bands]).view(np.int64)


def profiles(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, digest, bands) of every row with a doc_id."""
    common.tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            n, digests, bands = [], [], []
            for x in shingles_of(common.text_bytes(b), width):
                n.append(len(x))
                digests.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                bands.append(band_hashes(signature(x)) if len(x) else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, s): the full shingle sets, for confirmation."""
    common.tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            sets = [x.view(np.int64) for x in shingles_of(common.text_bytes(b), width)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])

    return docs.select(F.col("id"), "text").mapInArrow(run, "id long, s array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.where(F.col("common") * 100 >= percent * (F.col("n") - F.col("common"))).select("a", "b")


def _hub_pairs(buckets: DataFrame) -> DataFrame:
    """Each bucket's members with its least id."""
    hubs = buckets.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub")).select("key", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"))
    near = buckets.join(hubs, "key").where(F.col("id") != F.col("hub"))
    return near.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"), F.least("n", "hub_n").alias("small"), F.greatest("n", "hub_n").alias("large"))


def _cross_pairs(buckets: DataFrame) -> DataFrame:
    """All pairs of a bucket that lie in different components; only for buckets whose pairs were counted before."""
    x = buckets.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    y = buckets.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    return x.join(y, "key").where("a < b and ca <> cb").select("a", "b", F.least("na", "nb").alias("small"), F.greatest("na", "nb").alias("large"))


def _open_buckets(buckets: DataFrame) -> DataFrame:
    """Rows of the buckets that still hold several components, with the bucket's number of pairs between components."""
    parts = buckets.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    state = parts.groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("m2"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return buckets.join(state.select("key", "m", ((F.col("m") * F.col("m") - F.col("m2")) / 2).cast("long").alias("pairs")), "key")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of slices of their incidence matrices."""
    values, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    shared = np.bincount(at, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    use = shared[at]
    row, at = row[use], column[at[use]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for low in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(at, [low, low + 2048])
        m = np.zeros((len(left) + len(right), 2048), np.float32)
        m[row[a:b], at[a:b] - low] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _block_links(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components inside large open buckets, block against block."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = buckets.select("key", "id", "component", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select("key", "id", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = rows.join(sets, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def settle(i: int, j: int, held: list) -> list[tuple[int, int]]:
        left = [x for x in held if x[2] == i]
        right = [x for x in held if x[2] == j]
        if not left or not right:
            return []
        n, m = (np.array([len(x[3]) for x in side]) for side in (left, right))
        same = common_counts([x[3] for x in left], [x[3] for x in right])
        apart = np.array([x[1] for x in left])[:, None] != np.array([x[1] for x in right])[None]
        near = apart & (100 * same >= percent * (n[:, None] + m[None] - same))
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := root.get(c, c)) != c:
                c = up
            return c

        out = []
        for a, b in np.argwhere(near).tolist():
            x, y = top(left[a][1]), top(right[b][1])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((left[a][0], right[b][0]))
        return out

    def run(batches):
        held, at = [], None

        def packed(out):
            cols = list(zip(*out, strict=True)) if out else [[], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

        for b in batches:
            out = []
            sets_of = b.column("s")
            for k, row in enumerate(zip(*(b.column(c).to_pylist() for c in ("key", "i", "j", "id", "component", "block")), strict=True)):
                if row[:3] != at:
                    out += settle(at[1], at[2], held) if at else []
                    held, at = [], row[:3]
                held.append((*row[3:], sets_of[k].values.to_numpy()))
            yield packed(out)
        yield packed(settle(at[1], at[2], held) if at else [])

    return rows.select("key", "i", "j", "id", "component", "block", "s").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs; links have 100 * common >= percent * union."""
    found = common.stored(profiles(docs, width), "profiles")
    classes = found.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = common.stored(classes, "classes")
    keys = classes.select("id", "n", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    buckets = common.stored(keys.join(shared, "key").withColumn("component", F.col("id")), "buckets")
    members = buckets.select("id").distinct()
    with common.settings(docs.sparkSession, common.BLOOM):
        sets = common.stored(shingle_sets(common.texts_of(docs, members, "members").withColumnRenamed("doc_id", "id"), width), "sets")
    near = lambda pairs: pairs.where(f"100 * small >= {percent} * large").select("a", "b").distinct()
    links = common.stored(_confirmed(near(_hub_pairs(buckets)), sets, percent), "star-links")
    parts = None
    if not links.isEmpty():
        parts = common.stored(graph.components(links).withColumnRenamed("component_id", "c"), "parts")
        buckets = common.stored(buckets.drop("component").join(parts, "id", "left").select("id", "n", "key", F.coalesce("c", "id").alias("component")), "buckets")
    open_ = common.stored(_open_buckets(buckets), "open")
    more = _confirmed(near(_cross_pairs(open_.where(f"pairs <= {MOST_PAIRS}"))), sets, percent)
    more = common.stored(more.union(_block_links(open_.where(f"pairs > {MOST_PAIRS}"), sets, percent)), "more-links")
    if not more.isEmpty():
        parts = common.stored(graph.components(links.union(more)).withColumnRenamed("component_id", "c"), "parts")
    classes = classes.select("digest", "id")
    if parts is not None:
        classes = classes.join(parts, "id", "left").select("digest", F.coalesce("c", "id").alias("component_id"))
    else:
        classes = classes.select("digest", F.col("id").alias("component_id"))
    rows = found.select("doc_id", "n_shingles", "digest")
    linked = rows.where("digest is not null and doc_id is not null").join(classes, "digest").select("doc_id", "n_shingles", "component_id")
    out = linked.union(rows.where("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
