"""Hybrid fusion of a vector and a lexical list of (doc_id, score). Lists are whole, of any length."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ALPHA, RULES_ALPHA, RRF_K, GAIN = 0.7, 0.4, 60, 32
RARE_DF = 5
#: Rows that one task ranks.
RANGE_ROWS = 200_000


def check_alpha(alpha: float) -> float:
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies in 0 .. 1")
    return float(alpha)


class Signals(NamedTuple):
    """What a request's shape says about how exact it is."""

    quoted_phrase: bool = False
    rarest_df: int | None = None
    identifier: bool = False


def is_identifier(term: str) -> bool:
    return any(c.isdigit() for c in term) or any(c in "_-.#@" for c in term)


def effective_alpha(alpha: float | None = None, signals: Signals | None = None) -> tuple[float, list[str]]:
    """(alpha, names of the rules that apply). The caller's own alpha always holds; rules are only asked for with signals."""
    if alpha is not None:
        return check_alpha(alpha), []
    if signals is None:
        return ALPHA, []
    rules = {"quoted_phrase": signals.quoted_phrase, "rare_exact_token": signals.rarest_df is not None and signals.rarest_df <= RARE_DF, "identifier_token": signals.identifier}
    names = [n for n, applies in rules.items() if applies]
    return (RULES_ALPHA if names else ALPHA), names


def ranked(leg: DataFrame, rows: int | None = None) -> DataFrame:
    """leg (doc_id, score) with `rank`, by score descending, then id.

    Ranges of the score, cut at quantiles, are ranked task by task; what stands before a range is added from their counts, one row
    a range. Ranges are as many as `rows`, the leg's length, asks for.
    """
    from ..sources.storage import stored

    leg = stored(leg.select("doc_id", "score"), "leg")
    rows = leg.count() if rows is None else rows
    n = min(4096, -(-rows // RANGE_ROWS))
    cuts = leg.agg(F.percentile_approx("score", [i / n for i in range(1, n)], 16 * n).alias("c")).first().c if n > 1 else []
    part = F.lit(0)
    for c in sorted(set(cuts or [])):
        part = part - (F.col("score") > F.lit(c)).cast("int")
    placed = leg.withColumn("part", part)
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    # one row a range, 4096 at most
    inside = F.row_number().over(W.partitionBy("part").orderBy(F.desc("score"), F.asc("doc_id")))
    return placed.withColumn("nth", inside).join(F.broadcast(before), "part").select("doc_id", "score", (F.col("before") + F.col("nth")).alias("rank"))


def rrf(vector: DataFrame, lexical: DataFrame, k: int = RRF_K) -> DataFrame:
    """(doc_id, score): reciprocal ranks summed over the lists."""
    parts = [ranked(leg).select("doc_id", (1.0 / (k + F.col("rank"))).alias("part")) for leg in (vector, lexical)]
    return parts[0].union(parts[1]).groupBy("doc_id").agg(F.sum("part").alias("score"))


def fuse(vector: DataFrame, lexical: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Convex sum of the min-max normalised lists; a document that a list lacks adds 0 there.

    Falls back to rrf where a list is empty, has one hit or equal scores. Each list is computed once and stored.
    """
    from ..sources.storage import stored

    alpha = check_alpha(alpha)
    legs = [stored(leg.select("doc_id", "score"), "leg") for leg in (vector, lexical)]
    ends = [leg.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first() for leg in legs]
    if any(e.n < 2 or e.low == e.high for e in ends):
        return rrf(*legs)
    parts = [leg.select("doc_id", (F.lit(w) * (F.col("score") - F.lit(e.low)) / F.lit(e.high - e.low)).alias("part")) for leg, e, w in zip(legs, ends, (alpha, 1 - alpha), strict=True)]
    return parts[0].union(parts[1]).groupBy("doc_id").agg(F.sum("part").alias("score"))


def store_alpha(alpha: float) -> float:
    return GAIN * alpha / (GAIN * alpha + 1 - alpha)


def fuse_store(vector: DataFrame, lexical: DataFrame, ceiling: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Fixed anchors: vector scores (negative squared distances) over [0, ceiling], lexical scores over [0, their maximum].

    vector has the exact score of every candidate, ceiling is one row (ceiling); a document without the
    terms scores 0 on the lexical side. An empty side leaves all the weight to the other.
    """
    alpha = store_alpha(check_alpha(alpha))
    top = lexical.agg(F.max("score").alias("top"), F.count(F.lit(1)).alias("n_lexical"))
    size = vector.agg(F.count(F.lit(1)).alias("n_vector"))
    rows = vector.select("doc_id", F.col("score").alias("v")).join(lexical.select("doc_id", F.col("score").alias("x")), "doc_id", "full")
    rows = rows.join(F.broadcast(top)).join(F.broadcast(size)).join(F.broadcast(ceiling.select("ceiling")))
    v = F.when(F.col("v").isNull(), 0.0).when(F.col("ceiling") == 0, 1.0).otherwise(1 + F.col("v") / F.col("ceiling"))
    x = F.when(F.coalesce("top", F.lit(0.0)) == 0, 0.0).otherwise(F.coalesce("x", F.lit(0.0)) / F.col("top"))
    a = F.when(F.col("n_lexical") == 0, 1.0).when(F.col("n_vector") == 0, 0.0).otherwise(F.lit(alpha))
    return rows.select("doc_id", (a * v + (1 - a) * x).alias("score"), (-F.col("v")).alias("vector_squared_l2"), F.col("x").alias("lexical_bm25"))


def top_k(fused: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    if digits is not None:
        fused = fused.withColumn("score", F.round("score", digits))
    return fused.orderBy(F.desc("score"), F.asc("doc_id")).limit(k)
