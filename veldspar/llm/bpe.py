"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each leaf holds the rank of the pair that begins at its byte position; the root gives the leftmost
pair of least rank. Nodes have FANOUT children. A merge updates the leaves of the merged pair and of its
live neighbours and the nodes above them, so a piece of n bytes costs O(n log n) however long it is.
Pieces repeat, so each worker remembers the packed ids of MEMO_TOTAL bytes, twice, of those it has seen last.

Defined cases: a null or empty text has no ids; lone white space and text of any length are pieces
like others; every byte value is a token of the vocabulary, so nothing is unknown; each row is encoded by
itself, so repeated rows and ids give equal results, row for row; an empty table gives no rows; bytes that
aren't UTF-8 are read as replacement characters; a column of the input that has the name of a new column is replaced
where all columns are returned, and otherwise only those in `keep` are.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

NONE = 1 << 62
#: Children of a node of the segment tree; the least of so many is one step.
FANOUT = 16
#: Longer pieces are not remembered.
MEMO_BYTES = 64
#: Bytes of the younger half of what a worker remembers.
MEMO_TOTAL = 24 << 20
#: A vocabulary is broadcast; this bounds its file.
MOST_VOCABULARY_BYTES = 64 << 20
#: Bytes that are decoded at a time.
DECODE_BYTES = 1 << 20


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: merges of least rank first, the leftmost first among equals."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    rank_of = ranks.get
    # a leaf holds rank * n + position of the pair that begins there, so the least leaf is the leftmost pair of least rank
    leaves = [NONE if (r := rank_of(piece[i : i + 2])) is None else r * n + i for i in range(n - 1)]
    leaves.append(NONE)
    levels = [leaves]
    while len(levels[-1]) > FANOUT:
        below = levels[-1]
        levels.append([min(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    top, inner = levels[-1], list(zip(levels, levels[1:], strict=False))
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # a live position's end and its live neighbour to the left
    while (best := min(top)) < NONE:
        at = best % n
        gone = end[at]
        stop = end[at] = end[gone]
        leaves[gone] = NONE
        if stop < n:
            left[stop] = at
            leaves[at] = NONE if (r := rank_of(piece[at : end[stop]])) is None else r * n + at
        else:
            leaves[at] = NONE
        before = left[at]
        if before >= 0:
            leaves[before] = NONE if (r := rank_of(piece[before:stop])) is None else r * n + before
        for below, above in inner:
            for node in {(before if before >= 0 else at) // FANOUT, at // FANOUT, gone // FANOUT}:
                above[node] = min(below[node * FANOUT : (node + 1) * FANOUT])
            before, at, gone = before // FANOUT, at // FANOUT, gone // FANOUT
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class Codec:
    """Encodes to and decodes from little-endian unsigned 32-bit ids."""

    def __init__(self, blob: bytes, pattern: str):
        self.ranks = parse_ranks(blob)
        self.find = regex.compile(pattern).findall
        self.known = np.zeros(max(self.ranks.values(), default=-1) + 1, bool)
        self.size, self.start = np.zeros(len(self.known), np.int64), np.zeros(len(self.known), np.int64)
        for b, i in self.ranks.items():
            self.known[i], self.size[i] = True, len(b)
        self.start[1:] = np.cumsum(self.size)[:-1]
        self.bytes = np.frombuffer(b"".join(sorted(self.ranks, key=self.ranks.__getitem__)), np.uint8)
        self.memo = common.Memo(self._pack, MEMO_TOTAL)

    def _pack(self, piece: str) -> bytes:
        ids = merge_piece(piece.encode(), self.ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        memo, most = self.memo, MEMO_BYTES
        return b"".join([memo[p] if len(p) <= most else self._pack(p) for p in self.find(text)])

    def decode(self, ids: bytes) -> bytes:
        return self.decode_all([ids])[0]

    def decode_all(self, many: list[bytes]) -> list[bytes]:
        """The bytes of each of many lists of ids. KeyError for an id that the vocabulary doesn't have."""
        ids = np.frombuffer(b"".join(many), "<u4").astype(np.int64)
        if len(ids) and (ids.max() >= len(self.known) or not self.known[ids].all()):
            raise KeyError("an id that the vocabulary doesn't have")
        size = self.size[ids]
        upto = np.concatenate(([0], np.cumsum(size)))
        parts, low = [], 0
        while low < len(ids):
            high = max(low + 1, int(np.searchsorted(upto, upto[low] + DECODE_BYTES)) - 1)
            n = size[low:high]
            parts.append(self.bytes[np.repeat(self.start[ids[low:high]] - upto[low:high], n) + np.arange(upto[low], upto[high])].tobytes())
            low = high
        whole = b"".join(parts)
        edge = upto[np.concatenate(([0], np.cumsum([len(x) // 4 for x in many])))].tolist()
        return [whole[a:b] for a, b in zip(edge, edge[1:], strict=False)]


@lru_cache(2)
def codec(blob: bytes, pattern: str) -> Codec:
    return Codec(blob, pattern)


def _read_ranks(ranks_path: str) -> bytes:
    with open(ranks_path, "rb") as f:
        blob = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(blob) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary over {MOST_VOCABULARY_BYTES} bytes: {ranks_path}")
    return blob


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with column `out`: binary, the ids as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(_read_ranks(ranks_path))
    docs = docs.drop(out)
    schema = docs.withColumn(out, F.lit(b"")).schema

    def run(batches):
        c = codec(shared.value, pattern)
        for b in batches:
            ids = pa.array([c.encode(t) if t else b"" for t in common.strings(b, text)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with column `out`: binary, the bytes that the ids stand for."""
    spark = docs.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(_read_ranks(ranks_path))
    docs = docs.drop(out)
    schema = docs.withColumn(out, F.lit(b"")).schema

    def run(batches):
        c = codec(shared.value, pattern)
        for b in batches:
            back = pa.array(c.decode_all([x or b"" for x in b.column(ids).to_pylist()]), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, back], [*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """Per document: n_tokens, ids_sha256 and decoded_sha256, in one pass that stores no ids."""
    spark = docs.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(_read_ranks(ranks_path))
    keep = ["doc_id"] if keep is None else keep
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    docs = docs.select(*keep, *([] if "text" in keep else ["text"]))
    kept = [k for k in keep if k not in names]

    def run(batches):
        c = codec(shared.value, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            ids = [c.encode(t) if t else b"" for t in common.strings(b)]
            cols = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(map(sha, c.decode_all(ids)), pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *cols], [*kept, *names])

    return docs.mapInArrow(run, common.schema_of(docs, kept, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}))
