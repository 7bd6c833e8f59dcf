"""Bounded samples of labelled rows, and the small solvers that the learned operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows of each class that a fit takes, the first by a hash of doc_id.
PER_CLASS = 3000
#: Longer texts are no part of a fit (they are scored whole).
FIT_BYTES = 32 << 10


def sample(docs: DataFrame, labels: DataFrame, label: str, train, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, text, y) of at most per_class rows of either class for which `train` (a condition on doc_id) holds.

    Each class is a top-k by hash among the rows under a hash threshold, which its count sets, so that few
    rows leave their tasks however many there are. Labels other than 0 and 1, and ids that carry both, are left out.
    """
    marks = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where(train & F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = {r.y: r.n for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [common.first_by_hash(marks.where(F.col("y") == y), counts.get(y, 0), per_class).select("doc_id", "y") for y in (0, 1)]
    ids = parts[0].union(parts[1]).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", "y")
    # 2 * per_class ids at most: a proven bound. Rows that repeat an id count once, by their least text, so rows are bounded too
    found = docs.select("doc_id", "text").where(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression by damped Newton steps; the last column should be a constant, which isn't penalised."""
    w = np.zeros(x.shape[1])
    if not len(x):
        return w
    pen = np.full(x.shape[1], ridge)
    pen[-1] = 1e-6
    loss = lambda w: float(np.logaddexp(0, -(2 * y - 1) * (x @ w)).sum() + 0.5 * (pen * w * w).sum())
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pen * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(h, g)
        for k in range(8):
            if (then := loss(w - step / 2**k)) <= now:
                w = w - step / 2**k
                break
        else:
            break
        if now - then < 1e-7 * max(1.0, now):
            break
        now = then
    return w


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))
