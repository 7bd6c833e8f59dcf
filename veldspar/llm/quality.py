"""Quality by Bradley-Terry pairwise ranking.

Each document has features of its form; pairs of a good and a poor document teach a score by logistic
loss on the differences of their features. A quantile of the training scores, at the share of poor
documents, becomes the threshold: the score returned is a logistic of the distance from it, so 0.5
is the threshold.

The fit reads every labelled training row, whole: knots and threshold are order statistics of all of them, found by
counting, and each row stands in PARTNERS pairs or more. Rows are dealt into blocks of either class, in which the pairs are
made; a class too small for that goes to several blocks. What reaches the driver is sums, of a size that the
features set. A doc_id that repeats counts once, by its least features; ids that carry both labels are left out. Defined cases: null and empty texts have the features of a text of no words; with
labels of one class or none every score is 0.5; repeated rows are scored one by one and texts of equal features get equal
scores; an empty table gives no rows; columns named score or predicted are replaced, others in `keep` stay; bytes that
aren't UTF-8 are read as replacement characters.
"""

from __future__ import annotations

import operator
import pickle
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pairs of a row of the larger class, rows of it in a block, tasks that sum, and the weight of all pairs against the ridge.
PARTNERS, BLOCK, TASKS, WEIGHT = 2, 2048, 8, 60_000
#: Rows of the smaller class in a block, about, before it goes to several blocks.
FEW = 32
KNOTS = (0.02, 0.1, 0.3, 0.7, 0.9, 0.98)
LOW_START = re.compile(r"(?:^|[.!?]\s+)[^\W\d_A-ZÀ-ÖØ-Þ]")
SYMBOLS = [ord(c) for c in "|$#%&*!.,?@=<>{}:/\\_-"]


def features(text: str | None) -> np.ndarray:
    t = text or ""
    raw = t.encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, int)
    words = t.split()
    n, size = max(1, len(words)), max(1, len(raw))
    top = Counter(words)
    lines = [x for x in t.split("\n") if x]
    packed = len(zstandard.ZstdCompressor(level=1).compress(raw)) if raw else 0
    upper, lower, digits = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    marks = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    x = [
        np.log1p(len(words)), np.log1p(size), size / n, upper / (upper + lower + 1), digits / size, marks / size, marks / n,
        len(top) / n, np.log1p(len(top)), max(top.values(), default=0) / n, sum(map(operator.eq, words, words[1:])) / n,
        len(set(zip(words, words[1:], strict=False))) / n, len(lines) / n, len(set(lines)) / max(1, len(lines)),
        packed / size, (packed - 12) / n, len(LOW_START.findall(t)) / (1 + count[46] + len(lines)), n / (1 + count[46]),
        sum(w.isupper() for w in words if len(w) > 1) / n, sum(map(str.isalpha, words)) / n, count[128:].sum() / size,
    ]
    return np.array([*x, *(count[SYMBOLS] / n)], float)


def expand(x: np.ndarray, knots: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Piecewise linear functions of each feature: hinges at the knots, so that a linear score bends."""
    return np.concatenate([np.clip((x[:, None, :] - knots[None]) / scale, -4, 4).reshape(len(x), -1), np.maximum(0, np.clip((x[:, None, :] - knots[None]) / scale, -4, 4)).reshape(len(x), -1)], axis=1)


class Ranker:
    def __init__(self, knots, scale, weights, threshold: float, slope: float = 1.0):
        self.knots, self.scale, self.weights, self.threshold, self.slope = knots, scale, weights, threshold, slope

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand(x, self.knots, self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.threshold), -30, 30)))


def _sums(rows: DataFrame, add, columns: tuple[str, ...]) -> np.ndarray | None:
    """Sum of add(arrays of columns) over all batches, one partial sum a task."""

    def run(batches):
        total = None
        for b in batches:
            for part in add(*(b.column(c) for c in columns)):
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["s"])

    found = [np.frombuffer(r.s) for r in rows.select(*columns).coalesce(TASKS).mapInArrow(run, "s binary").collect()]
    return sum(found[1:], found[0]) if found else None


def _keys(x: np.ndarray) -> np.ndarray:
    """Floats as integers of the same order."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def order_statistics(rows: DataFrame, values, ranks: list[int]) -> np.ndarray:
    """[rank, feature] of values(x), for x of all rows: found byte by byte, by counts of those that share the bytes so far."""
    width = values(np.zeros((1, len(features(""))))).shape[1]
    prefix, left = np.zeros((len(ranks), width), np.uint64), np.repeat(np.array(ranks, np.int64)[:, None], width, axis=1)
    for shift in range(56, -8, -8):

        def add(x, shift=shift, prefix=prefix):
            k = _keys(np.ascontiguousarray(values(_matrix(x)), np.float64))
            out = np.zeros((*prefix.shape, 256))
            for r in range(len(prefix)):
                i, j = np.nonzero(k >> np.uint64(shift) >> np.uint64(8) == prefix[r]) if shift < 56 else np.nonzero(np.ones(k.shape, bool))
                out[r] = np.bincount(j * 256 + (k[i, j] >> np.uint64(shift) & np.uint64(255)).astype(np.int64), minlength=width * 256).reshape(width, 256)
            yield out.ravel()

        upto = _sums(rows, add, ("x",)).reshape(len(ranks), width, 256).cumsum(axis=2)
        digit = (upto <= left[:, :, None]).sum(axis=2)
        left = left - np.where(digit > 0, np.take_along_axis(upto, np.maximum(digit - 1, 0)[:, :, None], axis=2)[:, :, 0], 0).astype(np.int64)
        prefix = prefix << np.uint64(8) | digit.astype(np.uint64)
    return np.where(prefix >> np.uint64(63), prefix & np.uint64((1 << 63) - 1), ~prefix).view(np.float64)


def _matrix(x) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def pairs_of(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(good, poor) rows of a block that are held against each other: every row in one pair at least, those of the larger class in PARTNERS."""
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = max(len(good), len(poor)) if len(good) and len(poor) else 0
    i = np.arange(n)
    if len(good) >= len(poor):
        return np.tile(good, PARTNERS)[: n * PARTNERS], np.concatenate([poor[(i + r) % len(poor)] for r in range(PARTNERS)] if n else [poor[:0]])
    return np.concatenate([good[(i + r) % len(good)] for r in range(PARTNERS)] if n else [good[:0]]), np.tile(poor, PARTNERS)[: n * PARTNERS]


def fit(rows: DataFrame, ridge: float = 30.0) -> Ranker:
    """rows (doc_id, y, x), stored: all that the ranker learns from."""
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, poor, width = sum(counts.values()), counts.get(0, 0), len(features(""))
    if len(counts) < 2:
        return Ranker(np.zeros((len(KNOTS), width)), np.ones(width), np.zeros(2 * len(KNOTS) * width), 0.0)
    mean = _sums(rows, lambda x: [_matrix(x).sum(axis=0)], ("x",)) / n
    scale = np.maximum(np.sqrt(_sums(rows, lambda x: [((_matrix(x) - mean) ** 2).sum(axis=0)], ("x",)) / n), 1e-6)
    knots = order_statistics(rows, lambda x: x, [int(q * (n - 1)) for q in KNOTS])
    small, large = sorted(counts.values())
    blocks = -(-large // BLOCK)
    slots = max(1, min(blocks, small // FEW))
    h, few = F.xxhash64("doc_id", F.lit(9)), F.col("y") == (0 if poor == small else 1)
    at = F.when(few, F.sequence(F.pmod(h, F.lit(slots)), F.lit(blocks - 1).cast("long"), F.lit(slots).cast("long"))).otherwise(F.array(F.pmod(h, F.lit(blocks))))
    dealt = rows.select("doc_id", "y", "x", F.explode(at).alias("block")).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("y", "doc_id", "x"))).alias("r"))
    dealt = common.stored(dealt.select(F.col("r.y").alias("y"), F.flatten("r.x").alias("x")), "blocks")
    size = 2 * len(KNOTS) * width
    w = np.zeros(size)
    for _ in range(12):

        def add(ys, xs, w=w):
            for y, x in zip(ys, xs, strict=True):
                y = np.asarray(y.values)  # noqa: PLW2901
                a, b = pairs_of(y)
                z = expand(np.asarray(x.values).reshape(len(y), -1), knots, scale)
                out = np.zeros(1 + size + size * size)
                for c in range(0, len(a), BLOCK):
                    d = z[a[c : c + BLOCK]] - z[b[c : c + BLOCK]]
                    p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
                    out[0] += len(d)
                    out[1 : 1 + size] += d.T @ (p - 1)
                    out[1 + size :] += ((d * (p * (1 - p) + 1e-9)[:, None]).T @ d).ravel()
                yield out

        total = _sums(dealt, add, ("y", "x"))
        share = WEIGHT / max(1.0, total[0])
        step = np.linalg.solve(total[1 + size :].reshape(size, size) * share + ridge * np.eye(size), total[1 : 1 + size] * share + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    ranker = Ranker(knots, scale, w, 0.0)
    low, high = order_statistics(rows, lambda x: ranker.raw(x)[:, None], [poor - 1, min(poor, n - 1)])[:, 0]
    ranker.threshold = float((low + high) / 2)
    return ranker


def train(docs: DataFrame, labels: DataFrame, train) -> Ranker:
    spark = docs.sparkSession
    common.tune(spark)
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y"), train.alias("in")).where(F.col("in") & F.col("y").isin(0, 1) & F.col("id").isNotNull())
    marks = marks.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")

    def run(batches):
        for b in batches:
            x = [features(t) for t in common.strings(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    with common.scratch(spark):
        with common.settings(spark, common.BLOOM):
            rows = common.texts_of(docs, marks, "labelled").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<double>")
            rows = common.stored(rows.groupBy("doc_id", "y").agg(F.min("x").alias("x")), "features")
        return fit(rows)


@lru_cache(2)
def _loaded(blob: bytes) -> Ranker:
    return pickle.loads(blob)


def score(docs: DataFrame, ranker: Ranker, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs, then score (0 to 1) and predicted."""
    spark = docs.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(pickle.dumps(ranker))
    keep = [k for k in keep if k not in ("score", "predicted")]
    docs = docs.select(*keep, *([] if "text" in keep else ["text"]))

    def run(batches):
        r = _loaded(shared.value)
        for b in batches:
            texts = common.strings(b)
            got = r.scores(np.array([features(t) for t in texts])) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32), pa.int32())], [*keep, "score", "predicted"])

    return docs.mapInArrow(run, common.schema_of(docs, keep, {"score": "double", "predicted": "integer"}))
