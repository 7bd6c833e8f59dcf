"""Helpers shared by the operators: safe column names, shared storage, cached worker state."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes in one Arrow batch. Texts are whole, so batches are kept short to bound a worker's memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

#: Lets the planner thin the text scan by the ids that it is joined with, at any size of the input.
BLOOM = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, since one row may hold a very long text.

    A frame's batches are cut when it runs, which may be long after it was built, so the settings stay with
    the session; those that its owner has set are left alone.
    """
    for k, v in BATCH.items():
        if k not in _own_settings(spark):
            spark.conf.set(k, v)


def _own_settings(spark: SparkSession) -> set[str]:
    """Those of BATCH that were set by someone else."""
    return {k for k, v in BATCH.items() if spark._jsparkSession.sessionState().conf().contains(k) and spark.conf.get(k) != v}


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings for the plans that are built and run inside."""
    was = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def texts_of(docs: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """Rows (doc_id, text, and wanted's columns) of docs whose doc_id is in `wanted` (id, ...).

    `wanted` is stored with a constant to filter on: then the planner builds a Bloom filter of bounded size
    from its ids, which thins the scan of the texts before their exchange. Use it inside settings(BLOOM).
    """
    wanted = stored(wanted.withColumn("_one", F.lit(1)), name).where("_one > 0").hint("merge")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") if dict(docs.dtypes).get("doc_id") != "bigint" else docs.select("doc_id", "text")
    return rows.join(wanted, F.col("doc_id") == F.col("id")).drop("_one", "id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a session of one machine gets a local one, and a cluster an error."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="veldspar-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone at exit  # noqa: BLE001
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/veldspar/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    if _scratch:
        _scratch[-1].append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back, so that a lost executor costs a reread."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veldspar_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Free the disk of a stored() table that no later plan reads."""
    if path := getattr(df, "_veldspar_path", None):
        _delete(df.sparkSession, path)


def free(spark: SparkSession, *tables: DataFrame) -> None:
    """Free the disk of stored() tables that no later plan reads, and of the exchanges of finished plans, which Spark deletes once the driver has forgotten them."""
    for t in tables:
        drop_stored(t)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Have all executors give back heap that garbage holds: it grows to its bound otherwise, and what a stage takes beside the heap comes on top."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("x")).write.format("noop").mode("append").save()


#: Paths made within each open scratch().
_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Yields keep(table): the stored() tables made inside go at the end, but for those that were given to it."""
    _scratch.append([])
    kept = []
    try:
        yield lambda t: kept.append(t._veldspar_path) or t
    finally:
        for path in _scratch.pop():
            if path not in kept:
                _delete(spark, path)
        free(spark)


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    """Texts as strings; bytes that aren't UTF-8 become replacement characters."""
    column = batch.column(name)
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(29)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that are hashed at a time: bounds the memory of a worker.
HASH_CHUNK = 1 << 18


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out, step = np.ones(1, np.uint64), base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step % 2**64
    return out[:n]


_POWER, _INVERSE = powers(_BASE, HASH_CHUNK), powers(pow(_BASE, -1, 2**64), HASH_CHUNK)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_chunk(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of raw, by prefix sums of a polynomial."""
    inside = np.concatenate(([False], ~WHITE[raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    n = len(raw)
    power, inverse = (_POWER[:n], _INVERSE) if n <= HASH_CHUNK else (powers(_BASE, n), powers(pow(_BASE, -1, 2**64), n))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[raw] * power, out=total[1:])
    return mix((total[end] - total[start]) * inverse[start]), start


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (lower-cased in A-Z, parted by white space) of all texts in turn, and each text's number of words."""
    counts = np.zeros(len(texts), np.int64)
    out, held, size = [], [], 0

    def settle():
        nonlocal held, size
        if held:
            starts = np.concatenate(([0], np.cumsum([len(p) + 1 for _, p in held])))
            h, at = _hash_chunk(np.frombuffer(b" ".join(p for _, p in held), np.uint8))
            found = np.diff(np.searchsorted(at, starts))
            np.add.at(counts, [i for i, _ in held], found)
            out.append(h)
            held, size = [], 0

    for i, t in enumerate(texts):
        t = (t or b"").lower()  # noqa: PLW2901
        at = 0
        while at < len(t):
            end = min(len(t), at + HASH_CHUNK - 1)
            while end < len(t) and not WHITE[t[end]]:  # a cut falls between words
                end += 1
            if size + end - at >= HASH_CHUNK:
                settle()
            held.append((i, t[at:end]))
            size += end - at + 1
            at = end
    settle()
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def lower_az(column):
    """Lower-case A-Z only; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id, modulus: int):
    """crc32 of doc_id as text, modulo modulus; the fold rule of the learning operators. Null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def first_by_hash(rows: DataFrame, total: int, k: int) -> DataFrame:
    """At most k of `total` rows, the first by a hash of doc_id; a threshold on the hash leaves about 1.5 k of them to sort."""
    share = min(1.0, (1.5 * k + 20) / max(1, total))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    return rows.where(h < int(share * (1 << 32))).withColumn("_h", h).sort("_h", "doc_id").limit(k).drop("_h")


def schema_of(docs: DataFrame, keep: list[str], new: dict[str, str | T.DataType]) -> T.StructType:
    """The kept columns of docs as they are, then the new ones by type."""
    out = T.StructType([docs.schema[k] for k in keep])
    for name, kind in new.items():
        out.add(name, kind)
    return out


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _rest): all other columns in one struct, so that no operator's column clashes with them."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(None).cast("int")).alias("_rest"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, from packed rows."""
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in docs.columns))


class Memo(dict):
    """A dict that computes missing entries. It holds at most about 2 * most_bytes: the older half is forgotten when the younger is full."""

    def __init__(self, make, most_bytes: int = 6 << 20):
        super().__init__()
        self.make, self.most, self.held, self.old = make, most_bytes, 0, {}

    def __missing__(self, key):
        if (out := self.old.get(key)) is None:
            out = self.make(key)
        self.held += 100 + sys.getsizeof(key) + sys.getsizeof(out)
        if self.held > self.most:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = out
        return out
