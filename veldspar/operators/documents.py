"""Document lifecycle on DataFrames: live views, upserts, deletes, pages, counts, retention, cascades, chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import predicates


class StaleRevision(ValueError):
    """A batch holds a revision older than the live one, or a condition of the batch fails."""


class TooManyGroups(ValueError):
    """A grouped count has more groups than its limit: it is refused, never truncated."""


def live_view(log: DataFrame, key: str = "doc_id", revision: str = "revision", tombstone: str = "deleted") -> DataFrame:
    """The highest revision of each key, unless that is a tombstone. One aggregation with partial maxima, so a key of many revisions moves one row per task."""
    rest = [c for c in log.columns if c not in (key, revision)]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), revision).alias("_r"), F.max(revision).alias(revision)) if rest else log.groupBy(key).agg(F.max(revision).alias(revision))
    out = newest.select(*(F.col(c) if c in (key, revision) else F.col(f"_r.{c}").alias(c) for c in log.columns))
    return out.where(~F.coalesce(F.col(tombstone), F.lit(False))).drop(tombstone) if tombstone in log.columns else out


def classify_batch(live: DataFrame, batch: DataFrame, key: str = "doc_id", revision: str = "revision") -> DataFrame:
    """batch with `outcome`: stale (an older revision), replayed (the same) or applied."""
    known = live.select(F.col(key), F.col(revision).alias("_live"))
    was = F.when(F.col(revision) < F.col("_live"), "stale").when(F.col(revision) == F.col("_live"), "replayed").otherwise("applied")
    return batch.join(known, key, "left").withColumn("outcome", was).drop("_live")


def upsert(live: DataFrame, batch: DataFrame, key: str = "doc_id", revision: str = "revision") -> DataFrame:
    """live after the batch: atomic, so one stale row refuses all of it; equal revisions are replays and change nothing."""
    marked = classify_batch(live, batch, key, revision)
    if not marked.where("outcome = 'stale'").isEmpty():
        raise StaleRevision("the batch holds a revision older than the live one")
    new = marked.where("outcome = 'applied'").drop("outcome")
    return live.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def conditional_upsert(live: DataFrame, batch: DataFrame, expected: str, key: str = "doc_id", revision: str = "revision") -> DataFrame:
    """As upsert, if every row's column `expected` is the live revision (null: the key must be absent); else nothing changes."""
    known = live.select(F.col(key), F.col(revision).alias("_live"))
    bad = batch.join(known, key, "left").where(~F.col(expected).eqNullSafe(F.col("_live")))
    if not bad.isEmpty():
        raise StaleRevision("a condition of the batch doesn't hold")
    return upsert(live, batch.drop(expected), key, revision)


def conditional_delete(live: DataFrame, batch: DataFrame, expected: str = "expected", key: str = "doc_id", revision: str = "revision") -> DataFrame:
    """live without the batch's keys, if every row's column `expected` is the live revision; else nothing changes."""
    known = live.select(F.col(key), F.col(revision).alias("_live"))
    if not batch.join(known, key, "left").where(F.col("_live").isNull() | ~F.col(expected).eqNullSafe(F.col("_live"))).isEmpty():
        raise StaleRevision("a condition of the batch doesn't hold")
    return delete(live, batch, key)


def delete(live: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return live.join(ids.select(key).distinct(), key, "left_anti")


def delete_matching(live: DataFrame, predicate) -> tuple[DataFrame, DataFrame]:
    """(what stays, what went)."""
    hit = F.coalesce(predicates.compile_predicate(predicate, live.schema), F.lit(False))
    return live.where(~hit), live.where(hit)


def get(live: DataFrame, ids: Sequence, key: str = "doc_id", columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in the caller's order (column pos), repeated ids repeated, missing ones with nulls."""
    spark = live.sparkSession
    kind = live.schema[key].dataType.simpleString()
    asked = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], f"pos long, {key} {kind}")
    rows = live.select(key, *(columns or [c for c in live.columns if c != key])).withColumn("found", F.lit(True))
    return F.broadcast(asked).join(rows, key, "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy("pos")


def scan_page(live: DataFrame, limit: int, order: str = "ts asc", after: tuple | None = None, predicate=None, ts_range=None, key: str = "doc_id", ts: str = "ts", columns: Sequence[str] | None = None) -> DataFrame:
    """One page by keyset: `after` is the (ts, key) of the last row seen; ties by key ascending in either direction.

    The order `storage` is that of the keys, whatever their ts.
    """
    if order not in ("ts asc", "ts desc", "storage"):
        raise ValueError(f"unknown order {order}")
    rows = predicates.where(live, predicate, ts_range, ts)
    if columns is not None:
        rows = rows.select(*dict.fromkeys([key, ts, *columns]))
    if order == "storage":
        return (rows if after is None else rows.where(F.col(key) > F.lit(after[1]))).orderBy(F.asc(key)).limit(limit)
    down = order == "ts desc"
    if after is not None:
        t, k = after
        beyond = F.col(ts) < F.lit(t) if down else F.col(ts) > F.lit(t)
        rows = rows.where(beyond | ((F.col(ts) == F.lit(t)) & (F.col(key) > F.lit(k))))
    return rows.orderBy(F.desc(ts) if down else F.asc(ts), F.asc(key)).limit(limit)


def scan_ordered(live: DataFrame, column: str, limit: int, descending: bool = False, key: str = "doc_id", after: tuple | None = None) -> DataFrame:
    """By a numeric attribute; missing and NaN last in either direction, -0 like 0, ties by key. after: the (value, key) of the last row seen."""
    c = F.col(column)
    missing = c.isNull() | (F.isnan(c) if live.schema[column].dataType.simpleString() in ("float", "double") else F.lit(False))
    if after is not None:
        value, last = after
        tie = F.col(key) > F.lit(last)
        if value is None or value != value:
            live = live.where(missing & tie)
        else:
            beyond = c < F.lit(value) if descending else c > F.lit(value)
            live = live.where(missing | beyond | ((c == F.lit(value)) & tie))
    return live.orderBy(F.asc(missing), F.desc(c) if descending else F.asc(c), F.asc(key)).limit(limit)


def count(live: DataFrame, predicate=None, ts_range=None, ts: str = "ts") -> DataFrame:
    return predicates.where(live, predicate, ts_range, ts).agg(F.count(F.lit(1)).alias("n"))


def count_grouped(live: DataFrame, column: str, limit: int, predicate=None, ts_range=None, ts: str = "ts") -> DataFrame:
    """(value, n) ascending, nulls as one row of null value, refused if there are more than `limit` values."""
    if not 1 <= limit <= 65536:
        raise ValueError("limit lies in 1 .. 65536")
    kind = live.schema[column].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "string") and not kind.startswith("decimal"):
        raise predicates.PredicateError(f"can't group by {kind}")
    groups = predicates.where(live, predicate, ts_range, ts).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if groups.where("value is not null").limit(limit + 1).count() > limit:
        raise TooManyGroups(f"{column} has more than {limit} values")
    return groups.orderBy(F.asc_nulls_last("value"))


def drop_range(live: DataFrame, low, high, ts: str = "ts") -> DataFrame:
    return live.where((F.col(ts) < F.lit(low)) | (F.col(ts) >= F.lit(high)))


def retain(live: DataFrame, window: int, now: int, ts: str = "ts") -> DataFrame:
    if window <= 0:
        raise ValueError("the window is positive")
    return live.where(F.col(ts) >= F.lit(now - window))


def cascade(roots: DataFrame, steps: Sequence[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Keys that go with the roots (one column): each step is (table, its reference to the level above, its own key)."""
    out, above = [], roots
    for child, reference, key in steps:
        gone = child.join(above.select(F.col(above.columns[0]).alias(reference)).distinct(), reference, "left_semi").select(key).distinct()
        out.append(gone)
        above = gone
    return out


class CycleError(ValueError):
    """Cascades that lead back to where they began."""


def check_rules(rules: Sequence[tuple[str, str, str]]) -> list[str]:
    """Declared cascades (parent table, child table, reference of the child): the tables from parents to children, or CycleError."""
    left = {t for p, c, _ in rules for t in (p, c)}
    out: list[str] = []
    while left:
        free = sorted(t for t in left if not any(c == t and p in left for p, c, _ in rules))
        if not free:
            raise CycleError(f"cascades among {sorted(left)} form a cycle")
        out += free
        left -= set(free)
    return out


def cascade_by_rules(tables: dict[str, DataFrame], keys: dict[str, str], rules: Sequence[tuple[str, str, str]], root: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Keys that go from each table with the root's ids, by declared rules; a table with several parents goes by any of them."""
    order, gone = check_rules(rules), {root: ids.select(F.col(ids.columns[0]).alias(keys[root])).distinct()}
    for child in order:
        found = None
        for parent, name, reference in rules:
            if name == child and parent in gone:
                part = tables[child].join(gone[parent].select(F.col(keys[parent]).alias(reference)), reference, "left_semi").select(keys[child])
                found = part if found is None else found.union(part)
        if found is not None:
            gone[child] = (found if child not in gone else found.union(gone[child])).distinct()
    return gone


def cascade_closure(edges: DataFrame, roots: DataFrame, most: int = 64, refuse_cycles: bool = False) -> DataFrame:
    """(id) of all that (parent, child) edges reach from the roots, level by level. What was seen before isn't followed again, so a
    cycle ends; with refuse_cycles it is an error: then what is reached holds a part in which every id has a parent of its own."""
    from ..sources.storage import stored

    seen = front = roots.select(F.col(roots.columns[0]).alias("id")).distinct()
    for _ in range(most):
        front = stored(edges.join(front, edges["parent"] == front["id"], "left_semi").select(F.col("child").alias("id")).distinct().join(seen, "id", "left_anti"), "front")
        if front.isEmpty():
            break
        seen = stored(seen.union(front), "seen")
    else:
        raise ValueError(f"more than {most} levels")
    if refuse_cycles:
        inner = edges.select("parent", "child").distinct()
        for end in ("parent", "child"):
            inner = inner.join(seen.select(F.col("id").alias(end)), end, "left_semi")
        inner = stored(inner, "inner")
        while True:  # take away what has no child left; what remains at last is cycles and what leads to them
            parents = inner.select(F.col("parent").alias("id")).distinct()
            rest = stored(inner.join(parents.withColumnRenamed("id", "child"), "child", "left_semi"), "inner")
            if rest.isEmpty():
                break
            if rest.count() == inner.count():
                raise CycleError("the edges form a cycle")
            inner = rest
    return seen


def chunks(tokens: Column, longest: int, overlap: int = 0) -> Column:
    """array of (start, tokens): windows of `longest` tokens that share `overlap` with the one before."""
    if longest < 1 or not 0 <= overlap < longest:
        raise ValueError("chunks need longest >= 1 and 0 <= overlap < longest")
    # bound to a name, so that the tokens are made once and not for every window
    return F.element_at(F.transform(F.array(tokens), lambda t: _windows(t, longest, longest - overlap)), 1)


def _windows(tokens: Column, longest: int, step: int) -> Column:
    last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - longest) / step).cast("int")) * step
    return F.when(F.size(tokens) == 0, F.array().cast("array<struct<start:int,tokens:array<string>>>")).otherwise(F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.struct(i.alias("start"), F.slice(tokens, i + 1, longest).alias("tokens"))))


def with_row_number(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(*order)))
