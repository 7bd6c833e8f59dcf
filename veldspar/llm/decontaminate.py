"""Benchmark decontamination: one Aho-Corasick automaton over the windows of the normalised benchmark items.

Texts are lower-cased in A-Z and cut into words; a window is `width` consecutive words of an item (an
item of fewer words, but not none, is one window). Each text is scanned once; ends of matches are
mapped back to words and, for hit texts, to byte offsets of the original.

The automaton is broadcast, so its size is checked: a benchmark of more than `block_bytes` of text is dealt
into blocks of at most so much (or one item), and each block's automaton scans the texts in a pass of its
own, whose hits are stored with the rows before the next. So neither driver nor worker holds more than one block at a time.

Defined cases: a null text or one without words is not contaminated; items without words or id are
left out; repeated item ids are one item; an empty benchmark hits nothing; each row is judged by itself, so
repeated documents get equal rows; an empty table gives no rows; columns of the input that have the names of new ones are replaced,
and only those in `keep` are returned.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: All that is no part of a word, after lower-casing, becomes a space.
TO_SPACE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
BLOCK_BYTES = 16 << 20


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(TO_SPACE).split()


def windows(text: bytes, width: int) -> set[bytes]:
    found = words(text)
    return {b" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))} if found else set()


@lru_cache(1)
def automaton(items: tuple[tuple[object, bytes], ...], width: int):
    """Over ` word word ... `, so that matches begin and end at words. Values: (words in the window, item ids)."""
    owners: dict[bytes, set] = {}
    for item, text in items:
        for w in windows(text, width):
            owners.setdefault(w, set()).add(str(item))
    if not owners:
        return None
    out = ahocorasick.Automaton()
    for w, own in owners.items():
        out.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(own)))
    out.make_automaton()
    return out


def scan(found: list[bytes], machine, ranges: list[tuple[int, int]], items: set) -> list[tuple[int, int]]:
    """Ranges of hit words in a text's words, merged with those known before; items that occur are added to `items`."""
    if not found or machine is None:
        return ranges
    hits = []
    for at, (n, own) in machine.iter(f" {b' '.join(found).decode('latin-1')} "):
        hits.append((at, n))
        items.update(own)
    if not hits:
        return ranges
    last = np.cumsum([len(w) + 1 for w in found])  # where the space after each word is
    stops = (np.searchsorted(last, [e for e, _ in hits]) + 1).tolist()
    out: list[tuple[int, int]] = []
    for a, b in sorted([*ranges, *((stop - n, stop) for stop, (_, n) in zip(stops, hits, strict=True))]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of the original that ranges of words cover."""
    places = [m.span() for m in WORDS.finditer(text.lower())]
    return [(places[a][0], places[b - 1][1]) for a, b in ranges]


def _block_filters(items: DataFrame, block_bytes: int) -> list:
    """Conditions that deal the items into blocks of at most block_bytes each, or of one item."""
    n = 1
    while True:
        block = F.pmod(F.xxhash64("i"), F.lit(n))
        largest = items.groupBy(block.alias("k")).agg(F.sum(F.length("t")).alias("size"), F.count_distinct("i").alias("m")).where(f"size > {block_bytes} and m > 1")
        if largest.isEmpty():
            return [block == k for k in range(n)]
        n *= 2


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], width: int = 10, block_bytes: int = BLOCK_BYTES, with_spans: bool = False) -> DataFrame:
    """Columns `keep` of docs, then n_words, n_hit, n_items, items_sha256, contaminated (and, if asked for, spans: byte ranges)."""
    spark = docs.sparkSession
    common.tune(spark)
    new = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean"}
    new |= {"spans": T.ArrayType(T.StructType().add("start", "long").add("stop", "long"))} if with_spans else {}
    keep = [k for k in keep if k not in new]
    docs = docs.select(*keep, *([] if "text" in keep else ["text"]))
    range_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    carried = list(docs.columns)
    so_far = {"_ranges": T.ArrayType(T.StructType().add("start", "long").add("stop", "long")), "_items": T.ArrayType(T.StringType())}
    items = benchmark.select(F.col("item_id").alias("i"), F.col("text").cast("binary").alias("t")).where("i is not null and t is not null")
    filters = _block_filters(items, block_bytes)

    def step(rows: DataFrame, shared, finish: bool) -> DataFrame:
        """One pass with one automaton. Between passes rows carry the hit ranges and items found so far."""

        def run(batches):
            machine = automaton(shared.value, width)
            for batch in batches:
                texts = common.text_bytes(batch)
                known = zip(batch.column("_ranges").to_pylist(), batch.column("_items").to_pylist(), strict=True) if "_ranges" in batch.schema.names else (([], []) for _ in texts)
                sizes, ranges, owners = [], [], []
                for t, (before, own) in zip(texts, known, strict=True):
                    found, own = words(t or b""), set(own)  # noqa: PLW2901
                    sizes.append(len(found))
                    ranges.append(scan(found, machine, [(r["start"], r["stop"]) for r in before], own))
                    owners.append(own)
                if not finish:
                    cols = [pa.array([[{"start": a, "stop": b} for a, b in r] for r in ranges], range_type), pa.array([sorted(map(str, own)) for own in owners], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in carried), *cols], [*carried, "_ranges", "_items"])
                    continue
                hits = [sum(b - a for a, b in r) for r in ranges]
                listed = [",".join(sorted(map(str, own))) for own in owners]
                cols = [pa.array(sizes, pa.int64()), pa.array(hits, pa.int64()), pa.array(map(len, owners), pa.int64())]
                cols += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed], pa.string()), pa.array([n > 0 for n in hits], pa.bool_())]
                if with_spans:
                    cols.append(pa.array([[{"start": a, "stop": b} for a, b in spans(t, r)] if r else [] for t, r in zip(texts, ranges, strict=True)], range_type))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *cols], [*keep, *new])

        return rows.mapInArrow(run, common.schema_of(docs, keep, new) if finish else common.schema_of(docs, carried, so_far))

    now = docs
    for n, chosen in enumerate(filters):
        block = tuple((r.i, bytes(r.t)) for r in items.where(chosen).sort("i", "t").collect())
        finish = n == len(filters) - 1
        now = step(now, spark.sparkContext.broadcast(block), finish)
        now = now if finish else common.stored(now, "hits")
    return now
