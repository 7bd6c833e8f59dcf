"""A training corpus from `documents`: toxic texts go, then copies, near copies and benchmark leaks; what stays is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents. Each begins with what memory the one before has left to it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm import bpe, common, decontaminate, exact, minhash, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SIMILAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go. The grammar learns from the labelled documents that reach this stage."""
    common.release(spark)
    grammar = toxicity.train(docs, common.table(spark, sf_dir, "labels"), F.lit(True))
    scored = toxicity.score(common.packed(docs), grammar, ["doc_id", "text", "_rest"])
    return common.unpacked(scored.where("predicted = 0"), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) one row of the largest doc_id stays; of rows without doc_id, one of each text that no other row has."""
    common.release(spark)
    decided = exact.deduplicate(docs).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    decided = decided.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_hash"), "kept", "n").where("n > 1 or not kept")
    decided = common.stored(decided, "decided").hint("merge")  # grows with the corpus, so it isn't broadcast where it happens to be small
    rows = common.packed(docs).withColumn("_sha", exact.sha256(exact.normalised(F.col("text"))))
    same = lambda d: F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_hash"))
    out = rows.join(decided, same(decided), "left_anti")
    if not (twice := decided.where("kept")).isEmpty():  # rows that repeat in doc_id and text
        out = out.unionByName(rows.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "_sha"]))
    return common.unpacked(out, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that shingles of five words link at a similarity of 0.8, the document with the least doc_id stays. All rows of a doc_id share its fate."""
    common.release(spark)
    gone = minhash.near_duplicates(docs, SIMILAR_PERCENT).where("not kept").select(F.col("doc_id").alias("_id")).distinct()
    return common.unpacked(common.packed(docs).join(gone, F.col("doc_id") == F.col("_id"), "left_anti"), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words (or a whole shorter item) of the benchmark go."""
    common.release(spark)
    out = decontaminate.decontaminate(common.packed(docs), common.table(spark, sf_dir, "benchmark"), ["doc_id", "text", "_rest"])
    return common.unpacked(out.where("not contaminated"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    common.release(spark)
    return bpe.digests(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("MinHash near-dedup", drop_near_copies), ("benchmark decontamination", drop_leaks), ("byte-level BPE", encode)]

ORACLE_SQL = None  # SQL can't express the learned grammar; tests hold each stage against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
