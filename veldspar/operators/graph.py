"""Property-graph operators over two tables: nodes (id, labels, ...) and relationships (rel_id, src, dst, type, ...).

A pattern is a DataFrame of bindings: a node variable is a column with its id, a relationship variable
one with its rel_id. Each operator adds bindings by equi-joins, which Catalyst plans; properties are
joined in only where an expression reads them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_HOPS = 16


@dataclass
class Graph:
    nodes: DataFrame
    rels: DataFrame
    id: str = "id"

    def unit(self) -> DataFrame:
        """One empty row."""
        return self.nodes.sparkSession.range(1).select()

    def scan(self, var: str, labels: Sequence[str] = (), properties: Sequence[str] = ()) -> DataFrame:
        """Bindings (var) of all nodes that carry every label, and their columns `var.name`."""
        rows = self.nodes
        for label in labels:
            rows = rows.where(F.array_contains("labels", label))
        return rows.select(F.col(self.id).alias(var), *(F.col(n).alias(f"{var}.{n}") for n in properties))

    def lookup(self, var: str, value) -> DataFrame:
        return self.nodes.where(F.col(self.id) == F.lit(value)).select(F.col(self.id).alias(var))

    def lookup_relationship(self, var: str, value, source: str, target: str) -> DataFrame:
        """Bindings (var, source, target) of one relationship by its id."""
        return self.rels.where(F.col("rel_id") == F.lit(value)).select(F.col("rel_id").alias(var), F.col("src").alias(source), F.col("dst").alias(target))

    def get_nodes(self, ids: Sequence, columns: Sequence[str] | None = None) -> DataFrame:
        """In the caller's order (column pos); repeated ids are repeated, unknown ones have found = false."""
        from .documents import get

        return get(self.nodes, ids, self.id, columns)

    def get_relationships(self, ids: Sequence, columns: Sequence[str] | None = None) -> DataFrame:
        from .documents import get

        return get(self.rels, ids, "rel_id", columns)

    def edges(self, direction: str = "out", types: Sequence[str] = ()) -> DataFrame:
        """(_r, _s, _d): relationships as walked. Either way gives both directions, but a self-loop once."""
        rows = self.rels.where(F.col("type").isin(*types)) if types else self.rels
        out = rows.select(F.col("rel_id").alias("_r"), F.col("src").alias("_s"), F.col("dst").alias("_d"))
        if direction == "out":
            return out
        back = rows.select(F.col("rel_id").alias("_r"), F.col("dst").alias("_s"), F.col("src").alias("_d"))
        return back if direction == "in" else out.unionByName(back.where("_s <> _d"))

    def expand(self, rows: DataFrame, source: str, target: str, rel: str | None = None, direction: str = "out", types: Sequence[str] = (), distinct_from: Sequence[str] = ()) -> DataFrame:
        """Bindings with target (and rel); a target that is bound already is a condition. rel differs from the named relationships."""
        e = self.edges(direction, types)
        bound = target in rows.columns
        on = rows[source] == e["_s"]
        if bound:
            on = on & (rows[target] == e["_d"])
        out = rows.join(e, on)
        for other in distinct_from:
            out = out.where(F.col("_r") != F.col(other))
        out = out.drop("_s")
        out = out.drop("_d") if bound else out.withColumnRenamed("_d", target)
        return out.withColumnRenamed("_r", rel) if rel else out.drop("_r")

    def counted(self, rows: DataFrame, source: str, name: str, direction: str = "out", types: Sequence[str] = (), less: int = 0) -> DataFrame:
        """Bindings with `name`, the number of relationships that expand() would follow, for patterns that only count them.

        `less` are those of the pattern's own relationships that are known to be among them. Bindings without any are left out.
        """
        e = self.edges(direction, types).groupBy("_s").agg(F.count(F.lit(1)).alias(name))
        out = rows.join(e, rows[source] == e["_s"]).drop("_s")
        return out.withColumn(name, F.col(name) - less).where(F.col(name) > 0)

    def bounded(self, rows: DataFrame, source: str, target: str, low: int, high: int, path: str | None = None, direction: str = "out", types: Sequence[str] = (), each: Column | None = None) -> DataFrame:
        """Paths of low to high relationships, none twice in a path; path: array of their ids. `each` filters relationships by _r, _s, _d."""
        if not 0 <= low <= high <= MOST_HOPS:
            raise ValueError(f"hops lie in 0 .. {MOST_HOPS}")
        e = self.edges(direction, types)
        if each is not None:
            e = e.where(each)
        kind = dict(self.rels.dtypes)["rel_id"]
        now = rows.withColumn("_at", F.col(source)).withColumn("_path", F.array().cast(f"array<{kind}>"))
        levels = [now] if low == 0 else []
        for hop in range(1, high + 1):
            now = now.join(e, F.col("_at") == F.col("_s")).where(~F.array_contains("_path", F.col("_r")))
            now = now.withColumn("_path", F.concat("_path", F.array("_r"))).withColumn("_at", F.col("_d")).drop("_r", "_s", "_d")
            if hop >= low:
                levels.append(now)
        out = levels[0]
        for x in levels[1:]:
            out = out.unionByName(x)
        out = out.where(F.col("_at") == F.col(target)).drop("_at") if target in rows.columns else out.withColumnRenamed("_at", target)
        return out.withColumnRenamed("_path", path) if path else out.drop("_path")

    def with_properties(self, rows: DataFrame, var: str, names: Sequence[str], how: str = "inner") -> DataFrame:
        """Columns `var.name` of a node variable."""
        cols = self.nodes.select(F.col(self.id).alias("_id"), *(F.col(n).alias(f"{var}.{n}") for n in names))
        return rows.join(cols, rows[var] == cols["_id"], how).drop("_id")

    def with_rel_properties(self, rows: DataFrame, var: str, names: Sequence[str], how: str = "inner") -> DataFrame:
        cols = self.rels.select(F.col("rel_id").alias("_id"), *(F.col(n).alias(f"{var}.{n}") for n in names))
        return rows.join(cols, rows[var] == cols["_id"], how).drop("_id")


def shared_join(left: DataFrame, right: DataFrame, residual: Column | None = None, how: str = "inner") -> DataFrame:
    """Equality on all shared variables; without one, a product, which is what the pattern asks for."""
    on = [c for c in left.columns if c in right.columns]
    out = left.join(right, on, how) if on else left.join(right, F.lit(True), how)
    return out.where(residual) if residual is not None else out


def optional(rows: DataFrame, pattern: DataFrame, on: Sequence[str]) -> DataFrame:
    """OPTIONAL MATCH: the pattern, with its predicate already applied, or nulls."""
    return rows.join(pattern, list(on), "left")


def exists(rows: DataFrame, pattern: DataFrame, on: Sequence[str], negated: bool = False) -> DataFrame:
    return rows.join(pattern.select(*on), list(on), "left_anti" if negated else "left_semi")


class IntegrityError(ValueError):
    """A node that relationships still touch would go, or a relationship would lose an end."""


@dataclass
class Mutable:
    """Mutations as new DataFrames; the input of a statement is frozen before its writes, as both are lazy values."""

    graph: Graph

    def create_nodes(self, rows: DataFrame) -> Graph:
        return Graph(self.graph.nodes.unionByName(rows, allowMissingColumns=True), self.graph.rels, self.graph.id)

    def create_relationships(self, rows: DataFrame) -> Graph:
        ids = self.graph.nodes.select(F.col(self.graph.id).alias("_id"))
        for end in ("src", "dst"):
            if not rows.join(ids, rows[end] == ids["_id"], "left_anti").isEmpty():
                raise IntegrityError(f"a relationship's {end} isn't a node")
        return Graph(self.graph.nodes, self.graph.rels.unionByName(rows, allowMissingColumns=True), self.graph.id)

    def set_property(self, targets: DataFrame, name: str) -> Graph:
        """targets (id, value): a null value removes the property."""
        new = targets.select(F.col("id").alias("_id"), F.col("value").alias("_v"), F.lit(True).alias("_hit"))
        g = self.graph
        base = g.nodes if name in g.nodes.columns else g.nodes.withColumn(name, F.lit(None).cast(targets.schema["value"].dataType))
        out = base.join(new, base[g.id] == new["_id"], "left").withColumn(name, F.when(F.col("_hit"), F.col("_v")).otherwise(F.col(name)))
        return Graph(out.select(*base.columns), g.rels, g.id)

    def set_rel_property(self, targets: DataFrame, name: str) -> Graph:
        """targets (rel_id, value): a null value removes the property."""
        if name in ("rel_id", "src", "dst", "type"):
            raise IntegrityError(f"{name} of a relationship can't be set")
        new = targets.select(F.col("rel_id").alias("_id"), F.col("value").alias("_v"), F.lit(True).alias("_hit"))
        g = self.graph
        base = g.rels if name in g.rels.columns else g.rels.withColumn(name, F.lit(None).cast(targets.schema["value"].dataType))
        out = base.join(new, base["rel_id"] == new["_id"], "left").withColumn(name, F.when(F.col("_hit"), F.col("_v")).otherwise(F.col(name)))
        return Graph(g.nodes, out.select(*base.columns), g.id)

    def set_label(self, targets: DataFrame, label: str, on: bool = True) -> Graph:
        g = self.graph
        hit = targets.select(F.col("id").alias("_id"), F.lit(True).alias("_hit")).distinct()
        changed = F.array_union("labels", F.array(F.lit(label))) if on else F.array_except("labels", F.array(F.lit(label)))
        out = g.nodes.join(hit, g.nodes[g.id] == hit["_id"], "left").withColumn("labels", F.when(F.col("_hit"), changed).otherwise(F.col("labels")))
        return Graph(out.select(*g.nodes.columns), g.rels, g.id)

    def delete_nodes(self, targets: DataFrame, detach: bool = False, cascade_types: Sequence[str] = ()) -> Graph:
        """A plain delete is refused while relationships of other than the cascading types touch a target."""
        g = self.graph
        ids = targets.select(F.col("id").alias("_id")).distinct()
        touching = g.rels.join(ids, g.rels["src"] == ids["_id"], "left_semi").unionByName(g.rels.join(ids, g.rels["dst"] == ids["_id"], "left_semi"))
        held = touching.where(~F.col("type").isin(*cascade_types)) if cascade_types else touching
        if not detach and not held.isEmpty():
            raise IntegrityError("a node still has relationships")
        return Graph(g.nodes.join(ids, g.nodes[g.id] == ids["_id"], "left_anti"), g.rels.join(touching.select("rel_id").distinct(), "rel_id", "left_anti").select(*g.rels.columns), g.id)

    def delete_relationships(self, targets: DataFrame) -> Graph:
        return Graph(self.graph.nodes, self.graph.rels.join(targets.select("rel_id").distinct(), "rel_id", "left_anti").select(*self.graph.rels.columns), self.graph.id)


def apply_keyed(keys: DataFrame, batch: DataFrame) -> DataFrame:
    """Outcome of each change of a keyed batch against keys (kind, namespace, key, entity_id, revision, deleted).

    batch (kind, namespace, key, op, entity_id, revision, expected): op is create, put, recreate or delete.
    Outcomes: created, updated, recreated, deleted, replayed (the exact change was made before), refused.
    """
    known = keys.select("kind", "namespace", "key", F.col("entity_id").alias("_id"), F.col("revision").alias("_rev"), F.col("deleted").alias("_gone"))
    rows = batch.join(known, ["kind", "namespace", "key"], "left")
    same = (F.col("_id") == F.col("entity_id")) & (F.col("_rev") == F.col("revision"))
    absent, live = F.col("_id").isNull(), F.col("_id").isNotNull() & ~F.col("_gone")
    outcome = (
        F.when((F.col("op") == "delete") & F.col("_gone") & (F.col("_rev") == F.col("revision")), "replayed")
        .when((F.col("op") != "delete") & live & same, "replayed")
        .when((F.col("op") == "create") & absent, "created")
        .when((F.col("op") == "put") & live & (F.col("_id") == F.col("expected")) & (F.col("revision") > F.col("_rev")), "updated")
        .when((F.col("op") == "recreate") & F.col("_gone") & (F.col("_rev") == F.col("expected")), "recreated")
        .when((F.col("op") == "delete") & live & (F.col("revision") > F.col("_rev")), "deleted")
        .otherwise("refused")
    )
    return rows.withColumn("outcome", outcome).drop("_id", "_rev", "_gone")


KEY = ["kind", "namespace", "key"]
#: Changes in one keyed batch; a larger one is refused.
MOST_CHANGES = 1_000_000


@dataclass
class KeyedGraph:
    """Entities by external key: entities (kind, namespace, key, entity_id, revision, deleted, and their properties), live and deleted."""

    entities: DataFrame

    @classmethod
    def empty(cls, spark, properties: str) -> KeyedGraph:
        return cls(spark.createDataFrame([], f"kind string, namespace string, key string, entity_id long, revision long, deleted boolean, {properties}"))

    def live(self) -> DataFrame:
        return self.entities.where("not deleted")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The live entities of the keys in wanted (kind, namespace, key)."""
        return self.live().join(wanted.select(*KEY).distinct(), KEY, "left_semi")

    def apply(self, batch: DataFrame, most: int = MOST_CHANGES) -> KeyedGraph:
        """All of the batch or nothing: one refused change, or a key given twice, refuses it. Replays change nothing.

        batch: as apply_keyed takes it, with the properties of what is created, put or recreated. A deleted entity keeps its key and revision.
        """
        from ..sources.storage import stored

        marked = stored(apply_keyed(self.entities, batch), "keyed")
        counts = marked.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*KEY).alias("keys"), F.sum((F.col("outcome") == "refused").cast("long")).alias("refused")).first()
        if counts.n > most:
            raise IntegrityError(f"a batch has at most {most} changes")
        if counts.refused or counts["keys"] < counts.n:
            raise IntegrityError(f"{counts.refused or 0} changes refused, {counts.n - counts['keys']} keys given more than once")
        changed = marked.where("outcome <> 'replayed'")
        properties = [c for c in self.entities.columns if c not in (*KEY, "entity_id", "revision", "deleted")]
        gone = F.col("outcome") == "deleted"
        kinds = dict(self.entities.dtypes)
        new = changed.select(*KEY, "entity_id", F.col("revision").cast("long").alias("revision"), gone.alias("deleted"), *((F.when(~gone, F.col(p)) if p in changed.columns else F.lit(None)).cast(kinds[p]).alias(p) for p in properties))
        kept = self.entities.join(changed.select(*KEY), KEY, "left_anti").select(*self.entities.columns)
        return KeyedGraph(kept.unionByName(new.select(*self.entities.columns)))
