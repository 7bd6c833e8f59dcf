"""Sharding into contiguous, byte-balanced shards from global prefix sums; DataFrame functions only.

Rows are put in order of (doc_id, crc32, size). Ranges of doc_id, cut at quantiles, are the
partitions: their totals are summed on a table of one row for each range, and a window inside each
range adds the rest. A row belongs to the shard in which the middle of its bytes falls, so each shard
is within one row's size of the equal target.

Defined cases: a null text has size 1 and crc32 of the empty text; null doc_ids come first; rows that
repeat in all columns are told apart by nothing and take neighbouring slots; an empty table gives no rows; doc_id is
an integer; kept columns may have any names but those of the new ones, which take their place; very long texts are cut between, never within.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

ROWS_A_RANGE = 200_000


def _below(cuts: list[int], width: int = 64):
    """How many of the sorted cuts are below doc_id, in two steps: among the first cuts of blocks, then within one block."""
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    count = lambda items: F.size(F.filter(items, lambda c: c < F.col("doc_id")))
    block = count(F.array(*(F.lit(b[0]) for b in blocks)))
    inner = F.element_at(F.array(*(F.array(*map(F.lit, b)) for b in blocks)), F.greatest(block, F.lit(1)))
    return F.greatest(block - 1, F.lit(0)) * width + count(inner)


def shard_by_bytes(docs: DataFrame, shards: int = 16, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (doc_id by default), then size, text_crc32, shard and slot."""
    new = ["size", "text_crc32", "shard", "slot"]
    keep = [k for k in keep or ["doc_id"] if k not in new]
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    # other columns travel in one struct, so that none clashes with those of the plan
    others = [k for k in keep if k != "doc_id"]
    held = [F.struct(*(F.col(f"`{k}`") for k in others)).alias("_kept")] if others else []
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *held, (F.length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    narrow = common.stored(narrow, "sizes")
    rows = narrow.count()
    ranges = min(4096, max(8, -(-rows // ROWS_A_RANGE) * 8))
    cuts = narrow.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], ranges * 16).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    part = F.when(F.col("doc_id").isNull(), 0)
    part = part.otherwise(_below(cuts) + 1 if cuts else 1)
    placed = narrow.withColumn("part", part)
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"))
    before = totals.select("part", (F.sum("bytes").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("bytes")).alias("before"), F.sum("bytes").over(W.partitionBy()).alias("all"))
    order = W.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size")
    run = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))
    # one row for each range, 4,097 at most: a proven bound
    summed = placed.withColumn("upto", run).join(F.broadcast(before), "part").withColumn("upto", F.col("upto") + F.col("before"))
    cut = summed.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"cast(((2 * upto - size) * {shards}) div (2 * `all`) as int)"))).drop("before")
    inside = cut.withColumn("nth", F.row_number().over(W.partitionBy("part", "shard").orderBy("upto")))
    counts = cut.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("part", "shard", (F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    # at most ranges + shards rows, as ranges and shards are both contiguous
    out = inside.join(F.broadcast(starts), ["part", "shard"])
    kept = [F.col("doc_id") if k == "doc_id" else F.col("_kept").getField(k).alias(k) for k in keep]
    return out.select(*kept, "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"))
