"""Exact vector search, quantised search with exact rescoring, and their bounds.

Scores are computed inside generated code by higher-order functions; a top-k is an ORDER BY with LIMIT,
which Spark runs as a top-k in every task. Filters come before scores, so only eligible rows are scored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIERS = ("unset", "auto", "exact", "scan", "graph")


def check_query(query: Sequence[float], dimension: int | None = None, unit: bool = False) -> list[float]:
    """A finite query of the right dimension; with unit, of squared norm within 1e-3 of 1."""
    q = [float(x) for x in query]
    if not q or not all(map(math.isfinite, q)):
        raise ValueError("a query vector needs finite components")
    if dimension is not None and len(q) != dimension:
        raise ValueError(f"query has {len(q)} components, the space has {dimension}")
    if unit and abs(sum(x * x for x in q) - 1) > 1e-3:
        raise ValueError("query isn't of unit norm")
    return q


def literal(query: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in query)).cast("array<float>")


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda t, x: t + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))


def scored(df: DataFrame, query: Column, vector: str = "vector", metric: str = "l2", digits: int | None = None) -> DataFrame:
    """df with `score`: negative squared distance, or inner product; larger is better."""
    v = F.col(vector)
    score = -squared_l2(v, query) if metric == "l2" else dot(v, query)
    return df.withColumn("score", F.round(score, digits) if digits is not None else score)


def top_k(df: DataFrame, query: Column, k: int, vector: str = "vector", key: str = "doc_id", metric: str = "l2", tier: str = "unset", digits: int | None = None) -> DataFrame:
    """The k best rows by score, ties by key (and revision, newest first). Every tier is exact here."""
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier}")
    if k < 1:
        raise ValueError("k is at least 1")
    order = [F.desc("score"), F.asc(key)] + ([F.desc("revision")] if "revision" in df.columns else [])
    return scored(df, query, vector, metric, digits).orderBy(*order).limit(k)


def top_k_with_ties(df: DataFrame, query: Column, k: int, **options) -> DataFrame:
    """top_k, and all rows that tie with the k-th score."""
    rows = scored(df, query, options.get("vector", "vector"), options.get("metric", "l2"), options.get("digits"))
    last = rows.select("score").orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("kth"))
    return rows.join(F.broadcast(last), F.col("score") >= F.col("kth")).drop("kth")


def top_k_by_group(df: DataFrame, query: Column, k: int, group: str, vector: str = "vector", key: str = "doc_id", digits: int | None = None) -> DataFrame:
    """The k best rows of each group; the rank limit is applied in each task before the exchange."""
    order = W.partitionBy(group).orderBy(F.desc("score"), F.asc(key))
    return scored(df, query, vector, "l2", digits).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def finite(a: Column) -> Column:
    """Whether no component is NaN or infinite."""
    return F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


#: Rows whose vectors one row of a block table holds.
BLOCK_ROWS = 512


def _blocks(batches):
    """(key, vector) in Arrow batches, as rows of up to BLOCK_ROWS keys and their vectors' bytes; vectors of another length, null or with nulls apart."""
    import pyarrow as pa

    for batch in batches:
        keys, vectors = batch.columns
        lists = vectors.to_pylist() if vectors.null_count or vectors.flatten().null_count else None
        sizes = [-1 if v is None or None in v else len(v) for v in lists] if lists is not None else np.diff(vectors.offsets.to_numpy())
        sizes = np.asarray(sizes)
        for size in np.unique(sizes[sizes >= 0]):
            at = np.flatnonzero(sizes == size)
            for i in range(0, len(at), BLOCK_ROWS):
                here = pa.array(at[i : i + BLOCK_ROWS])
                values = vectors.take(here).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                packed = pa.array([values.tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([int(size)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(here)], pa.int32()), keys.take(here)), packed], ["size", "keys", "packed"])


def _nearest(k: int, slack: float):
    """For mapInArrow over pairs of blocks: of every query of a pair, the rows of the block that can be among its k nearest.

    Distances come from a product of matrices, whose error is bounded; rows within that bound and `slack` of the k-th stay.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                size, keys, packed, query_size, query_keys, query_packed = (batch.column(c)[i] for c in range(6))
                size = size.as_py()
                if size != query_size.as_py():
                    continue  # no distance
                x = np.frombuffer(packed.as_py(), np.float64).reshape(len(keys.values), size)
                q = np.frombuffer(query_packed.as_py(), np.float64).reshape(len(query_keys.values), size)
                with np.errstate(all="ignore"):
                    xx, qq = (x * x).sum(1), (q * q).sum(1)
                    d = qq[:, None] + xx[None, :] - 2 * (q @ x.T)
                    bound = slack + 8e-16 * (size + 8) * (qq + (xx.max() if len(xx) else 0.0))
                    kth = np.partition(d, min(k, len(xx)) - 1, 1)[:, min(k, len(xx)) - 1]
                    near = ~(d > (kth + 2 * bound)[:, None])  # NaN stays
                    near |= ~np.isfinite(d) | ~np.isfinite(kth)[:, None]
                a, b = np.nonzero(near)
                found = x[b] - q[a]
                score = np.zeros(len(a))
                for j in range(size):  # summed in the order of the components, as squared_l2 does
                    score = score + found[:, j] * found[:, j]
                yield pa.RecordBatch.from_arrays([query_keys.values.take(pa.array(a)), keys.values.take(pa.array(b)), pa.array(-score)], ["query", "key", "score"])

    return run


def batch_top_k(df: DataFrame, queries: DataFrame, k: int, vector: str = "vector", key: str = "doc_id", query_key: str = "query_id", digits: int | None = None) -> DataFrame:
    """(query_key, key, score, nth): the k nearest rows for each of a stated set of queries (query_key, query), taken against all rows.

    Blocks of rows meet blocks of queries, a pair at a time; only what can be among the k nearest of a block leaves it. All pairs are
    compared, so time grows with the product of both tables, and memory with a block. Rows whose vector is null or of another length have
    no distance and are left out.
    """
    from ..sources.storage import stored

    kinds = df.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    cut = lambda rows, a, b, kind: rows.select(a, b).mapInArrow(_blocks, f"size int, keys array<{kind}>, packed binary")
    rows = cut(df, key, vector, kinds[0])
    asked = cut(queries, query_key, "query", kinds[1]).select(F.col("size").alias("_s"), F.col("keys").alias("_k"), F.col("packed").alias("_p"))
    # a small table of blocks, which Spark broadcasts or reads again for every part of the rows
    pairs = rows.repartition(df.sparkSession.sparkContext.defaultParallelism * 4).crossJoin(stored(asked, "queries"))
    near = pairs.select("size", "keys", "packed", "_s", "_k", "_p").mapInArrow(_nearest(k, 0.0 if digits is None else 10.0**-digits), f"{query_key} {kinds[1]}, {key} {kinds[0]}, score double")
    near = near.withColumn("score", F.round("score", digits)) if digits is not None else near
    order = W.partitionBy(query_key).orderBy(F.desc("score"), F.asc(key))
    return near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def quantize_int8(vector: Column) -> tuple[Column, Column, Column]:
    """(codes, scale, offset): affine, codes in -127..127; a constant row has scale 0 and codes 0."""
    low, high = F.array_min(vector).cast("double"), F.array_max(vector).cast("double")
    scale, offset = (high - low) / 254, (high + low) / 2
    code = lambda x: F.when(scale == 0, F.lit(0)).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), F.round((x.cast("double") - offset) / scale).cast("int"))))
    return F.transform(vector, code).cast("array<tinyint>"), scale, offset


def dequantize_int8(codes: Column, scale: Column, offset: Column) -> Column:
    return F.transform(codes, lambda c: c * scale + offset)


def rescored_top_k(df: DataFrame, query: Column, k: int, oversample: int = 4, vector: str = "vector", key: str = "doc_id", digits: int | None = None) -> DataFrame:
    """k * oversample candidates by int8 codes, rescored on the full vectors."""
    codes, scale, offset = quantize_int8(F.col(vector))
    coarse = df.withColumn("coarse", -squared_l2(dequantize_int8(codes, scale, offset), query))
    return top_k(coarse.orderBy(F.desc("coarse"), F.asc(key)).limit(k * oversample), query, k, vector, key, digits=digits)


def ceiling(df: DataFrame, query: Sequence[float], vector: str = "vector") -> DataFrame:
    """One row: the largest squared distance that any row can have from the query, by norms."""
    q = math.sqrt(sum(float(x) ** 2 for x in query))
    return df.agg(F.max(norm(F.col(vector))).alias("max_norm")).select("max_norm", F.pow(F.col("max_norm") + q, 2).alias("ceiling"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
