"""Exact dedup by stateful streaming: keyed state on disk that never expires, DataFrame functions only.

One pass over the texts writes a narrow table (digest of the normalised text, byte length, doc_id,
locator) to shared storage. A structured-streaming aggregation reads it with a RocksDB state store and
no watermark, so state stays for ever: per digest the stable identifier (the largest doc_id), the
content locator of that row, and the count. Given a checkpoint, later batches continue the same state.
Hits are then checked on full bytes: a digest whose rows hold one text is confirmed, and texts that only
share a digest are grouped again by their full text.

Defined cases: a null text counts as empty; texts are equal when identical after lower-casing A-Z only;
rows that repeat a doc_id with equal text stay or go together; rows without doc_id have nothing that names
them, so they aren't compared by bytes, and count as kept only if no row of their group has a doc_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normalised(text: Column) -> Column:
    return F.coalesce(common.lower_az(text), F.lit(""))


class DedupState:
    """Streaming keyed state in a checkpoint folder; update() takes what the table at `path` has gained."""

    def __init__(self, spark, folder: str | None = None):
        self.spark, self.folder = spark, folder or common.new_path(spark, "dedup-state")

    def update(self, path: str, schema) -> DataFrame:
        """State rows (digest, keep_id, locator, group_size) of all digests that this batch touched."""
        spark, out = self.spark, f"{self.folder}/out"
        # without preallocation, a store of few keys takes kilobytes of disk instead of 4 MB; all stores of an executor share one bound
        # of memory, and those of an ended query are let go soon
        wanted = {"providerClass": ROCKSDB, "rocksdb.allowFAllocate": "false", "rocksdb.boundedMemoryUsage": "true", "rocksdb.maxMemoryUsageMB": "128", "maintenanceInterval": "5s"}
        wanted = {f"spark.sql.streaming.stateStore.{k}": v for k, v in wanted.items()}
        with common.settings(spark, wanted):
            rows = spark.readStream.schema(schema).parquet(path)
            state = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("last"), F.count(F.lit(1)).alias("group_size"))
            state = state.select("digest", F.col("last.doc_id").alias("keep_id"), F.col("last.locator").alias("locator"), "group_size")
            # each batch replaces its own folder, so a batch that is run again after a failure leaves no second copy
            query = state.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True)
            query = query.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
            query.awaitTermination()
        kinds = "digest string, keep_id long, locator string, group_size long, batch int"
        return spark.read.schema(kinds).parquet(out)


def latest(state: DataFrame) -> DataFrame:
    """One row for each digest: that of its last batch."""
    return state.groupBy("digest").agg(F.max_by(F.struct("keep_id", "locator", "group_size"), "batch").alias("s")).select("digest", "s.*")


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, locator) for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("t"))
    narrow = text.select("doc_id", digest(F.col("t")).cast("string").alias("digest"), sha256(F.col("t")).alias("text_sha256"), F.concat(F.input_file_name(), F.lit("#"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("#"), F.octet_length("t").cast("string")).alias("locator"))
    narrow = common.stored(narrow, "digests")
    state = DedupState(spark).update(narrow._veldspar_path, narrow.schema)
    state = latest(state)
    groups = common.stored(state.where("group_size > 1"), "groups")
    # full bytes on hits: every member of a group against the text of the row that stays. Only the texts of
    # groups are moved: a runtime Bloom filter on their ids, of bounded size, thins the scan before the exchange
    members = common.stored(narrow.join(groups.select("digest", "group_size"), "digest").select(F.col("doc_id").alias("id"), "digest", "group_size"), "hit-ids")
    with common.settings(spark, common.BLOOM):
        hits = common.stored(docs.select("doc_id", "text").join(members.where("group_size > 1").hint("merge"), F.col("doc_id") == F.col("id")).select(F.col("digest").alias("d"), normalised(F.col("text")).alias("t")).where(digest(F.col("t")).cast("string") == F.col("d")).withColumnRenamed("d", "digest"), "hits")
    # a digest with one text is confirmed; copies are counted where they are read, so a large group moves one row from each task
    variants = hits.groupBy("digest", "t").agg(F.count(F.lit(1)).alias("n"))
    odd = common.stored(variants.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "odd")
    clash = not odd.isEmpty()
    rows = narrow.select("doc_id", "digest", "text_sha256", "locator")
    if clash:
        again = text.withColumn("digest", digest(F.col("t")).cast("string")).join(odd, "digest").select("doc_id", "t", sha256(F.col("t")).alias("text_sha256"))
        by_text = again.groupBy("t").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.first("text_sha256").alias("text_sha256"))
        regrouped = again.drop("text_sha256").join(by_text, "t").select("doc_id", "keep_id", "group_size", "text_sha256", F.lit(None).cast("string").alias("locator"))
        rows = rows.join(odd, "digest", "left_anti")
        groups = groups.join(odd, "digest", "left_anti")
    known = groups.select("digest", "keep_id", "group_size", F.col("locator").alias("kept_at"))
    out = rows.join(known, "digest", "left").select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256", F.coalesce("kept_at", "locator").alias("locator"))
    if clash:
        out = out.unionByName(regrouped)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "locator")
