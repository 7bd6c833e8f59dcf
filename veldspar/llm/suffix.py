"""Exact substring dedup: every byte that a string of `length` bytes covers which also starts anywhere else.

A sparse suffix array, dealt out by content. Of every window of `length` bytes the leftmost least hash
of its k-byte strings is its anchor; equal windows have equal anchors at equal offsets, so only suffixes
that start at anchors need comparing, and only with those of the same k bytes. For each bucket of such
suffixes an enhanced suffix array is built: sorted by what follows the anchor, with the common prefixes
of neighbours. A stack scan gives its interval tree; in each interval the members' left extensions are
compared, which yields the maximal repeats with all their occurrences.

Skew: occurrences of equal surroundings, and so all copies of a text, collapse to one member of a bucket
by partial sums before anything is compared. A bucket of more than MOST_MEMBERS different surroundings is
dealt by longer keys: for each place that a window may have around its anchor, in steps of STEP bytes, the
bytes that all windows of that step share. Members that have a window in common share such a key, so they meet again, and
an interval tree is built for each part; no task holds a large bucket whole. A part that is
still too large, as its members share nearly a whole window, is dealt by its STEP windows: then the key is the window, an
interval by itself, and counting its members with partial sums is all that is left to do.

Windows and surroundings are compared by 128 bits of hashes (seed and surroundings, or two of a window) where they
collapse, and by their bytes in the arrays.

Defined cases: a null text is empty; texts shorter than `length` have nothing removed; rows that repeat
a doc_id, or have none, are told apart by their text: every row counts, and equal rows count as copies of each other;
an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, SEED = 200, 50
MOST_MEMBERS = 1500
#: Places of a window around its anchor that share one longer key.
STEP = 25
CHUNK = (1 << 20) - 1
_LOW = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.Generator(np.random.PCG64(11)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_POWER, _INVERSE = common.powers(_BASE, CHUNK + 2), common.powers(pow(_BASE, -1, 2**64), CHUNK + 2)


def _seed_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * _POWER[: len(raw)], out=total[1:])
    x = (total[k:] - total[:-k]) * _INVERSE[: len(raw) - k + 1]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    full = -(-len(x) // w) * w
    y = np.concatenate([x, np.full(full - len(x), 2**64 - 1, np.uint64)]).reshape(-1, w)
    before = np.minimum.accumulate(y, axis=1).ravel()
    after = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def anchors(text: bytes, length: int = LENGTH, k: int = SEED) -> Iterator[tuple[int, int, int, int]]:
    """(hash of the k bytes at the anchor, position, first and last start of the windows whose anchor it is)."""
    w = length - k + 1
    step = CHUNK - length
    for base in range(0, max(1, len(text) - length + 1), step):
        raw = np.frombuffer(text, np.uint8)[base : base + step + length - 1]
        if len(raw) < length:
            return
        h = _seed_hashes(raw, k)
        places = np.arange(len(h), dtype=np.uint64)
        at = (_sliding_min((h & ~_LOW) | places, w) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:], [len(at)])) - 1
        for p, a, b in zip(at[first].tolist(), first.tolist(), last.tolist(), strict=True):
            yield int(h[p]), base + p, base + a, base + b


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals (prefix length, first, last) of a suffix array with neighbour prefixes lcp[i] = LCP(i - 1, i), by a stack scan."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else -1
        left = i - 1
        while stack and stack[-1][0] > now:
            length, left = stack.pop()
            yield length, left, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, left))


def maximal_repeats(members: list[tuple[bytes, bytes]], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """members: (reversed left context, right context) of one bucket. Yields (left, right, members that share so much on either side), left + right >= least.

    In an interval of common right extension, members are sorted by what stands to their left. A set whose
    left neighbours all agree isn't left-diverse: it is yielded with the longer extension.
    """
    if len(members) == 2:
        (la, ra), (lb, rb) = members
        if (right := common_prefix(ra, rb)) + (left := common_prefix(la, lb)) >= least:
            yield left, right, [0, 1]
        return
    order = sorted(range(len(members)), key=lambda i: members[i][1])
    lcp = [0, *(common_prefix(members[a][1], members[b][1]) for a, b in zip(order, order[1:], strict=False))]
    rank = {m: i for i, m in enumerate(sorted(range(len(members)), key=lambda i: members[i][0]))}
    for right, first, last in intervals(lcp):
        if first == last or not right:
            continue
        inside = sorted(order[first : last + 1], key=rank.__getitem__)
        lefts = [0, *(common_prefix(members[a][0], members[b][0]) for a, b in zip(inside, inside[1:], strict=False))]
        if max(lefts) + right < least:
            continue
        for left, a, b in intervals(lefts):
            if a < b and left + right >= least:
                yield left, right, inside[a : b + 1]


KEY = ["doc_id", "id", "x"]


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, id, x, text): x is a hash of the text, id the doc_id or, without one, another hash of the text."""
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(doc.alias("doc_id"), F.coalesce(doc, F.xxhash64(F.lit(7), text)).alias("id"), F.xxhash64(text).alias("x"), text.alias("text"))


def _texts_of(docs: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """Rows (id, x, text, and wanted's columns) that `wanted` (id, x, ...) names."""
    wanted = common.stored(wanted.withColumn("_one", F.lit(1)), name).where("_one > 0").hint("merge")
    return _named(docs).drop("doc_id").join(wanted, ["id", "x"]).drop("_one")


def _profiles(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, id, x, n_bytes, digest, sha256, anchors) of every row; (id, x) names a row by its doc_id and text."""
    common.tune(docs.sparkSession)
    kind = pa.list_(pa.struct([("h", pa.int64()), ("p", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("c", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in common.text_bytes(batch)]
            found = []
            for t in texts:
                whole = [(h, p, a, b, xxhash.xxh3_64_intdigest(t[a : b + length], p - a)) for h, p, a, b in anchors(t, length)]
                cols = np.array([(h, c) for h, _, _, _, c in whole], np.uint64).reshape(-1, 2).view(np.int64)
                found.append([{"h": h, "p": p, "a": a, "b": b, "c": c} for (_, p, a, b, _), (h, c) in zip(whole, cols.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in KEY), pa.array(map(len, texts), pa.int64()), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(found, kind)],
                [*KEY, "n_bytes", "digest", "sha256", "anchors"],
            )

    return _named(docs).mapInArrow(run, "doc_id long, id long, x long, n_bytes long, digest binary, sha256 string, anchors array<struct<h:long,p:int,a:int,b:int,c:long>>")


def _settled(members: DataFrame, length: int, names: list[str]) -> DataFrame:
    """members (`names`: bucket; id, x, p, l, r, single) -> (id, x, start, stop), bucket by bucket, each of bounded size."""

    def run(batches):
        held, key = [], None

        def settle(rows):
            # all spans of a member hold its anchor, so their union is one span
            widest = {}
            for left, right, who in maximal_repeats([(m[3][::-1], m[4]) for m in rows], length):
                for i in who:
                    a, b = widest.get(i, (0, 0))
                    widest[i] = max(a, left), max(b, right)
            for i, (a, b) in widest.items():
                d, x, p, _, _, single = rows[i]
                if single:
                    yield d, x, p - a, p + b

        def packed(out):
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], SPAN)

        out = []
        for b in batches:
            keys = zip(*(b.column(n).to_pylist() for n in names), strict=True)
            for now, *row in zip(keys, *(b.column(n).to_pylist() for n in MEMBER), strict=True):
                if now != key:
                    out.extend(settle(held))
                    held, key = [], now
                held.append(row)
            yield packed(out)
            out = []
        yield packed([*out, *settle(held)])

    return members.select(*names, *MEMBER).repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "id long, x long, start long, stop long")


SPAN, MEMBER = ["id", "x", "start", "stop"], ["id", "x", "p", "l", "r", "single"]


def _parts(members: DataFrame, length: int, places, step: int) -> DataFrame:
    """members by longer keys (h, g, k1, k2), one row for each g of `places` whose windows, which begin g to g + step - 1 bytes before the anchor, the member may have."""
    rows = members.withColumn("g", F.explode(places)).where(f"length(l) >= g and length(r) >= {length} - g - {step} + 1")
    around = F.expr(f"concat(substring(l, length(l) - g + 1, g), substring(r, 1, {length} - g - {step} + 1))")
    return rows.withColumn("k1", F.xxhash64(around)).withColumn("k2", F.xxhash64(F.lit(1), around))


def _large_buckets(members: DataFrame, length: int) -> DataFrame:
    """The same for buckets of many members, dealt by longer keys. Stored, as the parts are freed step by step."""
    spark, names, last = members.sparkSession, ["h", "g", "k1", "k2"], length - SEED
    parts = common.stored(_parts(members.drop("m"), length, F.sequence(F.lit(0), F.lit(last), F.lit(STEP)), STEP), "parts")
    sizes = common.stored(parts.groupBy(*names).agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "part-sizes")
    common.free(spark)
    sized = parts.join(sizes, names)
    spans = common.stored(_settled(sized.where(f"m <= {MOST_MEMBERS}"), length, names), "part-spans")
    common.free(spark)
    rest = sized.where(f"m > {MOST_MEMBERS}").select(*MEMBER, "h", F.col("g").alias("g0"))
    windows = _parts(rest, length, F.sequence(F.col("g0"), F.least(F.col("g0") + STEP - 1, F.lit(last))), 1).select("id", "x", "p", "single", *names)
    again = common.stored(windows.groupBy(*names).agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"), "windows")
    common.free(spark)
    whole = windows.where("single").join(again, names).groupBy("id", "x", "p").agg(F.max("g").alias("most"), F.min("g").alias("least"))
    whole = common.stored(whole.select("id", "x", (F.col("p") - F.col("most")).cast("long").alias("start"), (F.col("p") - F.col("least") + length).cast("long").alias("stop")), "window-spans")
    common.free(spark, parts, sizes, again)
    return spans.unionByName(whole)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles of all rows; copies of each digest; spans (id, x, start, stop)), all stored.

    After each step the driver forgets the plans that have ended; else what it holds of their tasks and exchanges grows with the partitions.
    """
    spark = docs.sparkSession
    found = common.stored(_profiles(docs, length), "anchors")
    copies = common.stored(found.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")), "copies")
    heads = common.stored(found.select(*KEY, "n_bytes", "digest", "sha256"), "heads")
    common.free(spark)
    marks = found.select("id", "x", F.explode("anchors").alias("m")).select("id", "x", "m.*")
    # most seeds occur once: those are counted with partial sums and left behind before anything wider moves
    # counts are stored before they are joined, so that both sides of the join are exchanges that Spark can split at a hot seed
    again = common.stored(marks.groupBy("h").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select("h"), "again")
    common.free(spark)
    marks = common.stored(marks.join(again, "h"), "marks")
    common.free(spark, found, again)
    same = common.stored(marks.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "x", "p")).alias("first")), "same")
    buckets = common.stored(same.groupBy("h").agg(F.count(F.lit(1)).alias("m")), "buckets")
    common.free(spark)
    rows = common.stored(marks.join(same.join(buckets, "h"), ["h", "c"]), "rows")
    common.free(spark, marks, same, buckets)
    inside = rows.where("n > 1").select("id", "x", F.col("a").cast("long").alias("start"), (F.col("b") + length).cast("long").alias("stop"))
    fine = rows.where("m > 1 and (n = 1 or (first.id = id and first.x = x and first.p = p))")
    lists = fine.groupBy("id", "x").agg(F.collect_set(F.struct("h", "p", "a", "b", "m", (F.col("n") == 1).alias("single"))).alias("f"))
    with common.settings(docs.sparkSession, common.BLOOM):
        members = _texts_of(docs, lists, "lists").select("id", "x", F.col("text").alias("t"), F.explode("f").alias("f"))
        members = members.select("id", "x", "f.h", "f.p", "f.m", "f.single", F.expr("substring(t, f.a + 1, f.p - f.a)").alias("l"), F.expr(f"substring(t, f.p + 1, f.b + {length} - f.p)").alias("r"))
        members = common.stored(members, "members")  # more than once for rows that repeat in doc_id and text, which are copies anyway
    common.free(spark)
    spans = common.stored(inside.unionByName(_settled(members.where(f"m <= {MOST_MEMBERS}"), length, ["h"])), "spans")
    common.free(spark, rows)
    if not (large := members.where(f"m > {MOST_MEMBERS}")).isEmpty():
        spans = spans.unionByName(_large_buckets(large, length))
    common.free(spark, members)
    return heads, copies, spans


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs; with_text adds `kept`, the remaining bytes."""
    empty = hashlib.sha256(b"").hexdigest()
    names = ["id", "x", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches):
        for b in batches:
            rows = []
            for t, found in zip(common.text_bytes(b), b.column("spans").to_pylist(), strict=True):
                merged = _merged([(s["start"], s["stop"]) for s in found])
                edges = [0, *(x for span in merged for x in span), len(t)]
                rest = b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(t) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary())], names)

    with common.scratch(docs.sparkSession) as keep:
        heads, copies, spans = repeated_spans(docs, length)
        parts = keep(heads).join(keep(copies), "digest").select(*KEY, "n_bytes", "sha256", "copies").withColumn("whole", F.expr(f"copies > 1 and n_bytes >= {length}"))
        lists = spans.groupBy("id", "x").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
        cut = parts.where("not whole").join(lists, ["id", "x"]).select("id", "x", "spans")  # each such text stands in one row
        with common.settings(docs.sparkSession, common.BLOOM):
            raw = _texts_of(docs, cut, "cut").select("id", "x", "text", "spans")
            done = keep(common.stored(raw.mapInArrow(run, "id long, x long, n_removed long, n_spans long, kept_sha256 string, kept binary"), "done"))
    changed = parts.where("not whole").join(done, ["id", "x"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), "kept")
    whole = parts.where("whole").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept_sha256"), F.lit(b"").alias("kept"))
    out = changed.unionByName(whole)
    return out if with_text else out.drop("kept")
