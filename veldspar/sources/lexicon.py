"""A lexical index that is written once and read term by term.

Folder: postings (term, first, n, and arrays of doc_id, tf, len and positions) and words (term, df), both ranged and sorted by
term, so that a query's terms prune files and row groups; lengths (doc_id, len); stats, one row; and a manifest that is
written last, so a half-written index doesn't open. A row of postings has a term's n documents of one block, whose first
one is the second key, so that a term of very many documents spans several ranges.

A block of documents is grouped where it is read, as a document's tokens are in one row: only the grouped rows are dealt out.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexical as L
from . import storage

FORMAT = 2
#: Bytes of text that are grouped at once; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: Bytes of grouped rows, as they are stored, that one task sorts.
RANGE_BYTES = 32 << 20
_OPEN: dict[tuple, str] = {}


ASCII = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def ascii_lists(texts: pa.Array) -> pa.ListArray:
    """What L.ascii_tokens gives, for a block at once."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    keep = ASCII[data]
    edges = np.diff(keep.astype(np.int8), prepend=np.int8(0))
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    ends = np.cumsum([len(r) + 1 for r in raw])  # of the texts
    bounds = pa.py_buffer(np.append(0, np.cumsum(stops - starts)).astype(np.int32))
    words = pa.StringArray.from_buffers(len(starts), bounds, pa.py_buffer(data[keep]))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.searchsorted(starts, ends)).astype(np.int32)), words)


def _bounds(counts) -> np.ndarray:
    return np.append(0, np.cumsum(counts)).astype(np.int32)


def grouped(ids: pa.Array, tokens: pa.ListArray) -> pa.RecordBatch:
    """(term, first, n, docs, tfs, lens, places) of one block, a row a term, lists as bytes. The row without a term has all documents and their lengths."""
    words = tokens.flatten().dictionary_encode()
    lens = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
    n = len(lens)
    key = words.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lens)
    places = np.arange(len(key)) - np.repeat(np.cumsum(lens) - lens, lens)
    order = np.argsort(key, kind="stable")
    key, places = key[order], places[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))  # where an entry begins
    code, doc = key[at] // n, key[at] % n
    rows = np.flatnonzero(np.diff(code, prepend=-1))  # where a term begins
    sizes, tfs = np.append(n, np.diff(rows, append=len(at))), np.diff(at, append=len(key))
    docs = ids.take(pa.array(np.append(np.arange(n), doc)))
    terms = pa.concat_arrays([pa.nulls(1, pa.string()), words.dictionary.take(pa.array(code[rows])).cast(pa.string())])
    pack = lambda values, counts: pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(_bounds(counts) * values.dtype.itemsize), pa.py_buffer(np.ascontiguousarray(values))])
    ints = lambda head, tail: pack(np.append(head, tail).astype(np.int32), sizes)
    listed = pack(docs.to_numpy(), sizes) if docs.type == pa.int64() else pa.ListArray.from_arrays(pa.array(_bounds(sizes)), docs)
    found = pack(places.astype(np.int32), np.append(0, np.add.reduceat(tfs, rows) if len(rows) else []))
    return pa.RecordBatch.from_arrays([terms, docs.take(pa.array(np.append(0, rows + n))), pa.array(sizes), listed, ints(np.zeros(n), tfs), ints(lens, lens[doc]), found], PACKED)


PACKED = ["term", "first", "n", "docs", "tfs", "lens", "places"]


def unpacked(batches):
    """The bytes of grouped rows as lists: their buffers are the lists' values."""
    for batch in batches:
        term, first, n, docs, *ints = batch.columns
        if not batch.num_rows:
            continue
        if pa.types.is_binary(docs.type):
            docs = _list(docs, np.int64)
        tfs, lens, places = (_list(c, np.int32) for c in ints)
        inner = pa.ListArray.from_arrays(pa.array(_bounds(tfs.values.to_numpy())), places.values)
        yield pa.RecordBatch.from_arrays([term, first, n, docs, tfs, lens, pa.ListArray.from_arrays(tfs.offsets, inner)], PACKED)


def _list(packed: pa.Array, kind) -> pa.ListArray:
    at = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    values = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(kind)
    return pa.ListArray.from_arrays(pa.array((at - at[0]) // values.dtype.itemsize, pa.int32()), pa.array(values))


def blocks(batches):
    """(doc_id, text or tokens) in Arrow batches, as grouped rows of blocks of BLOCK_BYTES."""
    for batch in batches:
        ids, values = batch.column(0), batch.column(1)
        plain = pa.types.is_string(values.type)
        before = values.offsets.to_numpy().astype(np.int64) if not plain else np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
        most = BLOCK_BYTES if plain else BLOCK_BYTES // 8  # tokens
        start = 0
        while start < len(ids):
            stop = max(start + 1, int(np.searchsorted(before, before[start] + most, "right")) - 1)
            part = values.slice(start, stop - start)
            # of tokens a copy, whose offsets begin at 0
            yield grouped(ids.slice(start, stop - start), ascii_lists(part) if plain else pa.concat_arrays([part]))
            start = stop


def write(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", analyze: Callable[[Column], Column] = L.ascii_tokens, epoch: str = "ascii") -> L.Index:
    """Index docs at a new path. The tokens are made once, and words come from the written postings. Rows that share a doc_id count as one document."""
    spark = docs.sparkSession
    rows = L.tokenized(docs, text, key, analyze)
    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"term string, first {kind}, n long, docs array<{kind}>, tfs array<int>, lens array<int>, places array<array<int>>"
    named = rows.where("doc_id is not null")

    def run(part: DataFrame, name: str) -> DataFrame:
        packed = f"term string, first {kind}, n long, docs {'binary' if kind == 'bigint' else f'array<{kind}>'}, tfs binary, lens binary, places binary"
        part.mapInArrow(blocks, packed).write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    runs = run(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null") if analyze is L.ascii_tokens else named, "runs")
    lens = runs.where("term is null").mapInArrow(unpacked, shape).select(F.explode(F.arrays_zip("docs", "lens")).alias("e")).select(F.col("e.docs").alias("doc_id"), F.col("e.lens").cast("long").alias("len"))
    lens.unionByName(L.lengths_of(rows.where("doc_id is null"))).write.parquet(f"{path}/lengths")
    lengths = spark.read.parquet(f"{path}/lengths")
    L.stats_of(lengths).write.parquet(f"{path}/stats")
    repeated = lengths.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id")
    again = not repeated.isEmpty()
    if again:
        runs = run(named.join(repeated, "doc_id", "left_anti"), "alone")
    # the ranges' cuts are drawn from what is written, so that texts aren't read twice
    n = max(1, -(-storage.fingerprint(spark, f"{path}/runs")[1] // RANGE_BYTES))
    dealt = runs.where("term is not null").repartitionByRange(n, "term", "first").sortWithinPartitions("term", "first")
    dealt.mapInArrow(unpacked, shape).write.parquet(f"{path}/postings")
    if again:
        lens = lengths.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list(F.col("len").cast("int")).alias("lens"))
        shared = L.postings_of(named.join(repeated, "doc_id", "left_semi")).withColumn("tf", F.col("tf").cast("int")).join(lens, "doc_id")
        each = lambda c: F.transform("lens", lambda n: F.col(c)).alias({"doc_id": "docs", "tf": "tfs", "positions": "places"}[c])
        shared = shared.select("term", F.col("doc_id").alias("first"), F.lit(1).cast("long").alias("n"), each("doc_id"), each("tf"), "lens", each("positions"))
        shared.repartitionByRange("term", "first").sortWithinPartitions("term", "first").write.mode("append").parquet(f"{path}/postings")
    for name in ("runs", "alone"):
        storage.delete(spark, f"{path}/{name}")
    words = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum("n").alias("df"))
    words.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/words")
    storage.put_json(spark, f"{path}/manifest.json", {"format": FORMAT, "epoch": epoch})
    return read(spark, path, epoch)


def read(spark: SparkSession, path: str, epoch: str = "ascii") -> L.Index:
    manifest = storage.get_json(spark, f"{path}/manifest.json")
    if manifest is None or manifest["format"] not in (1, FORMAT):
        raise FileNotFoundError(f"no lexical index of this format at {path}")
    if manifest["epoch"] != epoch:
        raise ValueError(f"the index's terms were made by {manifest['epoch']!r}")
    part = lambda name: spark.read.parquet(f"{path}/{name}")
    if manifest["format"] == 1:  # a row is an entry
        return L.Index(part("postings"), part("lengths"), part("stats"), part("words"))

    def entries(*more: str) -> DataFrame:
        rows = part("postings").select("term", F.explode(F.arrays_zip("docs", "tfs", "lens", *more)).alias("e"))
        return rows.select("term", F.col("e.docs").alias("doc_id"), F.col("e.tfs").cast("long").alias("tf"), F.col("e.lens").cast("long").alias("len"), *(F.col(f"e.{c}").alias("positions") for c in more))

    return L.Index(entries("places"), part("lengths"), part("stats"), part("words"), entries())


def of_table(spark: SparkSession, table: str, docs: DataFrame, tag: str = "text") -> L.Index:
    """The index of a table at a path: written in the shared folder when first asked for, and again when the table has changed."""
    key = (spark.sparkContext.applicationId, storage.fingerprint(spark, table), tag)
    if key not in _OPEN:
        path = f"{storage.shared_folder(spark)}/veldspar/lexicon-{uuid.uuid4().hex}"
        atexit.register(storage.delete_quietly, spark, path)
        write(docs, path)
        _OPEN[key] = path
    return read(spark, _OPEN[key])
