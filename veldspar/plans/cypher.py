"""Compiles the Cypher profile to DataFrames over a Graph; Catalyst does the rest.

A variable is a column that holds its id; a property is joined in when an expression first reads it.
Logic is three-valued, as Spark's own. Writes give a new Graph.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Graph, Mutable
from .syntax import CypherError, parse, walk

Search = Callable[[list[Any], DataFrame | None], DataFrame]


def conjuncts(e: tuple | None) -> list[tuple]:
    if e is None:
        return []
    return conjuncts(e[1]) + conjuncts(e[2]) if e[0] == "and" else [e]


def variables(tree) -> set[str]:
    return {n[1] for n in walk(tree) if n and n[0] in ("var", "haslabels") and isinstance(n[1], str)}


@dataclass
class Rows:
    df: DataFrame
    kinds: dict[str, str] = field(default_factory=dict)  # variable -> node, rel, path, value
    weight: str | None = None  # the column that says how many rows a row stands for


class Compiler:
    def __init__(self, graph: Graph, params: dict[str, Any] | None = None, searches: dict[str, Search] | None = None):
        self.graph, self.params, self.searches = graph, params or {}, searches or {}
        self.fresh = (f"_v{i}" for i in count())
        self.used: set[str] = set()
        self.ahead: dict[str, list[str]] = {}

    # expressions

    def load(self, rows: Rows, *trees) -> Rows:
        """Join in the properties that the trees read, and evaluate their pattern predicates."""
        wanted: dict[str, list[str]] = {}
        for tree in trees:
            for n in walk(tree):
                if n and n[0] == "prop" and len(n) == 3 and n[1][:1] == ("var",):
                    wanted.setdefault(n[1][1], []).append(n[2])
                elif n and n[0] == "haslabels":
                    wanted.setdefault(n[1], []).append("labels")
                elif n and n[0] == "call" and n[1] in ("labels", "type", "stored_text") and n[2] and n[2][0][0] == "var":
                    wanted.setdefault(n[2][0][1], []).append({"stored_text": "text"}.get(n[1], n[1]))
        df = rows.df
        for var, names in wanted.items():
            kind = rows.kinds.get(var)
            if kind not in ("node", "rel"):
                continue
            table = self.graph.nodes if kind == "node" else self.graph.rels
            new = [n for n in dict.fromkeys(names) if f"{var}.{n}" not in df.columns]
            there = [n for n in new if n in table.columns]
            if there:
                join = self.graph.with_properties if kind == "node" else self.graph.with_rel_properties
                df = join(df, var, there, "left")
            for n in new:
                if n not in there:  # a property that nothing has is null
                    df = df.withColumn(f"{var}.{n}", F.lit(None).cast("string"))
        rows = Rows(df, rows.kinds, rows.weight)
        for tree in trees:
            for n in walk(tree):
                if n and n[0] == "pattern" and self.flag(n) not in rows.df.columns:
                    rows = self.witness(rows, n)
        return rows

    @staticmethod
    def flag(tree) -> str:
        return f"_p{abs(hash(repr(tree)))}"

    def witness(self, rows: Rows, tree) -> Rows:
        """A pattern predicate as a left join with the distinct bindings that have a match: row counts stay."""
        nodes, rels = tree[1]
        bound = [v for v, *_ in (*nodes, *rels) if v and v in rows.kinds]
        if not bound:
            raise CypherError("a pattern predicate needs a bound variable")
        keys = Rows(rows.df.select(*bound).distinct(), {v: rows.kinds[v] for v in bound})
        found = self.match(keys, [tree[1]], None).df.select(*bound).distinct().withColumn(self.flag(tree), F.lit(True))
        return Rows(rows.df.join(found, bound, "left"), rows.kinds, rows.weight)

    def value(self, name: str) -> Any:
        if name not in self.params:
            raise CypherError(f"missing parameter ${name}")
        self.used.add(name)
        return self.params[name]

    def expr(self, e: tuple, rows: Rows, local: dict[str, Column] | None = None) -> Column:
        local = local or {}
        go = lambda x: self.expr(x, rows, local)
        kind = e[0]
        if kind == "lit":
            return self.literal(e[1])
        if kind == "param":
            v = self.value(e[1])
            return F.array(*map(self.literal, v)) if isinstance(v, list | tuple) else self.literal(v)
        if kind == "var":
            if e[1] in local:
                return local[e[1]]
            if e[1] not in rows.kinds:
                raise CypherError(f"unknown variable {e[1]}")
            return F.col(f"`{e[1]}`")
        if kind == "prop":
            if e[1][0] == "var" and rows.kinds.get(e[1][1]) in ("node", "rel") and e[1][1] not in local:
                return F.col(f"`{e[1][1]}.{e[2]}`")
            if e[1][0] == "map":
                return go(e[1][1][e[2]]) if e[2] in e[1][1] else F.lit(None)
            return go(e[1])[e[2]]
        if kind in ("and", "or"):
            a, b = go(e[1]), go(e[2])
            return a & b if kind == "and" else a | b
        if kind == "xor":
            a, b = go(e[1]), go(e[2])
            return (a & ~b) | (~a & b)
        if kind == "not":
            return ~go(e[1])
        if kind == "null":
            return go(e[1]).isNull()
        if kind == "cmp":
            return self.compare(e[1], go(e[2]), go(e[3]), self.real(e[2], rows) or self.real(e[3], rows))
        if kind in ("+", "-", "*", "/", "%"):
            a, b = go(e[1]), go(e[2])
            if kind == "/" and not (self.real(e[1], rows) or self.real(e[2], rows)):
                return F.call_function("div", a, b)
            return {"+": lambda: F.concat(a, b) if self.textual(e[1], rows) or self.textual(e[2], rows) else a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}[kind]()
        if kind == "neg":
            return -go(e[1])
        if kind == "in":
            if e[2][0] == "list":
                return go(e[1]).isin(*[go(x) for x in e[2][1]]) if e[2][1] else F.lit(False)
            return F.array_contains(go(e[2]), go(e[1]))
        if kind in ("starts", "ends", "contains"):
            a, b = go(e[1]), go(e[2])
            return {"starts": a.startswith, "ends": a.endswith, "contains": a.contains}[kind](b)
        if kind == "haslabels":
            out = F.lit(True)
            for label in e[2]:
                out = out & F.array_contains(F.col(f"`{e[1]}.labels`"), label)
            return out
        if kind == "case":
            out = None
            for c, v in e[1]:
                out = F.when(go(c), go(v)) if out is None else out.when(go(c), go(v))
            return out.otherwise(go(e[2]))
        if kind == "list":
            return F.array(*[go(x) for x in e[1]])
        if kind == "map":
            return F.struct(*[go(v).alias(k) for k, v in e[1].items()])
        if kind == "index":
            i = go(e[2])
            return F.try_element_at(go(e[1]), F.when(i >= 0, i + 1).otherwise(i).cast("int"))
        if kind == "comprehension":
            _, var, source, where, out = e
            items = go(source)
            if where is not None:
                items = F.filter(items, lambda x: self.expr(where, rows, {**local, var: x}))
            return F.transform(items, lambda x: self.expr(out, rows, {**local, var: x}))
        if kind == "pattern":
            return F.coalesce(F.col(self.flag(e)), F.lit(False))
        if kind == "call":
            return self.call(e[1], e[2], rows, go)
        if kind == "agg":
            raise CypherError("aggregates stand alone in a projection")
        raise CypherError(f"unexpected {kind}")

    def real(self, e: tuple, rows: Rows) -> bool:
        """Whether an expression is known to be a float."""
        if e[0] == "lit":
            return isinstance(e[1], float)
        if e[0] == "param":
            return isinstance(self.params.get(e[1]), float)
        if e[0] == "call":
            return e[1] in ("tofloat", "floor", "round") or e[1] == "abs" and self.real(e[2][0], rows)
        if e[0] in ("+", "-", "*", "/", "%", "neg"):
            return any(self.real(x, rows) for x in e[1:])
        name = f"{e[1][1]}.{e[2]}" if e[0] == "prop" and e[1][0] == "var" else e[1] if e[0] == "var" else None
        return dict(rows.df.dtypes).get(name) in ("double", "float")

    @staticmethod
    def literal(v: Any) -> Column:
        """Integers are 64 bits wide."""
        return F.lit(v).cast("long") if isinstance(v, int) and not isinstance(v, bool) else F.lit(v)

    @staticmethod
    def text(e: tuple) -> bool:
        return e[0] == "lit" and isinstance(e[1], str)

    def textual(self, e: tuple, rows: Rows) -> bool:
        """Whether an expression is known to be a string or a list, for which + joins."""
        if e[0] == "param":
            return isinstance(self.params.get(e[1]), str | list | tuple)
        if e[0] == "+":
            return self.textual(e[1], rows) or self.textual(e[2], rows)
        if e[0] in ("list", "comprehension") or self.text(e):
            return True
        kind = dict(rows.df.dtypes).get(self.column(e)) or ""
        return kind == "string" or kind.startswith("array")

    @staticmethod
    def compare(op: str, a: Column, b: Column, real: bool) -> Column:
        out = {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        if not real:
            return out
        # NaN equals nothing, differs from everything and has no order
        nan = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
        return F.when(a.isNull() | b.isNull(), None).when(nan, F.lit(op == "<>")).otherwise(out)

    def call(self, f: str, args: list, rows: Rows, go) -> Column:
        if f == "coalesce":
            return F.coalesce(*map(go, args))
        if len(args) != 1:
            raise CypherError(f"{f} takes one argument")
        if f in ("labels", "type", "stored_text"):
            return F.col(f"`{args[0][1]}.{ {'stored_text': 'text'}.get(f, f)}`")
        x = go(args[0])
        if f in ("node_id", "relationship_id"):
            return F.lpad(F.lower(F.hex(x.cast("long"))), 32, "0")
        if f == "size":
            return F.char_length(x).cast("long") if self.text(args[0]) or dict(rows.df.dtypes).get(self.column(args[0])) == "string" else F.size(x).cast("long")
        if f == "tointeger":
            exact = F.trim(x.cast("string")).try_cast("decimal(38,18)")
            return F.floor(F.abs(exact)).cast("long") * F.signum(exact.cast("double")).cast("long")
        if f == "tofloat":
            out = F.trim(x.cast("string")).try_cast("double")
            return F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out)
        if f == "floor":
            return F.floor(x).cast("double")
        if f == "round":
            return F.floor(x + F.lit(0.5)).cast("double")
        if f == "abs":
            return F.abs(x)
        return F.try_element_at(x, F.lit(1 if f == "head" else -1))

    @staticmethod
    def column(e: tuple) -> str | None:
        return f"{e[1][1]}.{e[2]}" if e[0] == "prop" and e[1][0] == "var" else e[1] if e[0] == "var" else None

    # patterns

    def match(self, rows: Rows, patterns: list, where: tuple | None, counted: bool = False) -> Rows:
        """All patterns of one clause; none of its relationships is used twice.

        Each condition holds as soon as its variables are bound, before what follows multiplies the rows. A pattern that
        doesn't begin at a bound variable is matched by itself and joined on what it shares. With `counted` the last step only counts.
        """
        rels: list[tuple[str, bool]] = []
        tests = conjuncts(where)
        rows, tests = self.ready(rows, tests)
        for i, (nodes, steps) in enumerate(patterns):
            names = {v for v, *_ in (*nodes, *steps) if v}
            inline = [v for x in (*nodes, *steps) for v in x[2].values()]
            if i + 1 == len(patterns) and counted:
                rows, tests, rels = self.walked(rows, nodes, steps, tests, rels, True)
            elif not rows.df.columns or nodes[0][0] in rows.kinds or any(v in rows.kinds for v, *_ in steps) or not variables(inline) <= names:
                rows, tests, rels = self.walked(rows, nodes, steps, tests, rels)
            else:
                own, tests, new = self.walked(Rows(self.graph.unit(), {}), nodes, steps, tests, [])
                shared = [v for v in own.kinds if v in rows.kinds]
                side = own.df.drop(*(c for c in own.df.columns if c in rows.df.columns and c not in shared))
                df = rows.df.join(side, shared) if shared else rows.df.join(side, F.lit(True))
                for name, many in new:
                    df = self.unlike(df, name, many, rels)
                rows, rels = Rows(df, rows.kinds | own.kinds), rels + new
                rows, tests = self.ready(rows, tests)
        return self.filtered(rows, tests) if tests else rows

    def walked(self, rows: Rows, nodes: list, steps: list, tests: list, rels: list, counted: bool = False) -> tuple[Rows, list, list]:
        """One pattern along its steps, the conditions that are left, and the clause's relationships so far."""
        here, rows = self.bind(rows, nodes[0])
        rows, tests = self.ready(rows, tests)
        for i, ((var, types, props, direction, hops), node) in enumerate(zip(steps, nodes[1:], strict=True)):
            if counted and i + 1 == len(steps):
                name = next(self.fresh)
                return Rows(self.graph.counted(rows.df, here, name, direction, types, len(steps) - 1), rows.kinds, name), tests, rels
            target = node[0] or next(self.fresh)
            name = var or next(self.fresh)
            known = target in rows.kinds
            if hops:
                df = self.graph.bounded(rows.df, here, target, *hops, path=name, direction=direction, types=types)
            else:
                df = self.graph.expand(rows.df, here, target, rel=name, direction=direction, types=types)
            df = self.unlike(df, name, bool(hops), rels)
            rels = [*rels, (name, bool(hops))]
            rows = Rows(df, rows.kinds | {name: "path" if hops else "rel", target: "node"})
            if props:
                rows = self.filtered(rows, [("cmp", "=", ("prop", ("var", name), k), v) for k, v in props.items()])
            rows = self.conditions(rows, (target, node[1], node[2]), known)
            rows, tests = self.ready(rows, tests)
            here = target
        return rows, tests, rels

    @staticmethod
    def unlike(df: DataFrame, name: str, many: bool, rels: list) -> DataFrame:
        a = F.col(f"`{name}`")
        for other, others in rels:
            b = F.col(f"`{other}`")
            df = df.where(~F.arrays_overlap(a, b) if many and others else ~F.array_contains(a, b) if many else ~F.array_contains(b, a) if others else a != b)
        return df

    def ready(self, rows: Rows, tests: list) -> tuple[Rows, list]:
        """The conditions whose variables are bound, applied, and those that are left. A pattern's predicate waits for the whole clause."""
        now = [t for t in tests if variables(t) and variables(t) <= rows.kinds.keys() and not any(n and n[0] == "pattern" for n in walk(t))]
        return (self.filtered(rows, now), [t for t in tests if t not in now]) if now else (rows, tests)

    def only_counted(self, c: tuple, rows: Rows, after: tuple) -> bool:
        """Whether the last step of a MATCH only adds to count(*): one step back over the relationship type by which its start was reached."""
        if c[0] != "match" or c[1] or after[0] not in ("with", "return") or after[1] or not after[2] or rows.weight:
            return False
        (nodes, steps), others = c[2][-1], c[2][:-1]
        if others or len(steps) != 2 or any(s[2] or s[4] for s in steps) or nodes[-1][1] or nodes[-1][2] or rows.df.columns:
            return False
        back = {"out": "in", "in": "out", "both": "both"}
        if steps[1][3] != back[steps[0][3]] or not set(steps[0][1]) or set(steps[0][1]) != set(steps[1][1]):
            return False
        items = [e for e, *_ in after[2]]
        if not any(e[:2] == ("agg", "count*") for e in items) or any(e[0] == "agg" and e[1] != "count*" for e in items):
            return False
        free = {v for v in (nodes[-1][0], steps[-1][0]) if v}
        read = [x for x in (c[3], *items, *(e for e, _ in after[3]), after[6]) if x is not None]
        if any(n and n[0] == "pattern" for n in walk(read)):
            return False
        used = variables(read)
        return not free & (used | {v for v, *_ in (*nodes[:-1], *steps[:-1])})

    def bind(self, rows: Rows, node: tuple) -> tuple[str, Rows]:
        var = node[0] or next(self.fresh)
        if var in rows.kinds:
            return var, self.conditions(rows, (var, node[1], node[2]), True)
        # what the statement reads of it comes with it, while it is one row a node
        scan = self.graph.scan(var, node[1], [n for n in self.ahead.get(var, []) if n in self.graph.nodes.columns])
        df = scan if not rows.df.columns else rows.df.join(scan, F.lit(True))
        rows = Rows(df, rows.kinds | {var: "node"})
        return var, self.conditions(rows, (var, [], node[2]), True)

    def conditions(self, rows: Rows, node: tuple, _known: bool) -> Rows:
        var, labels, props = node
        tests = [("haslabels", var, labels)] if labels else []
        tests += [("cmp", "=", ("prop", ("var", var), k), v) for k, v in props.items()]
        return self.filtered(rows, tests) if tests else rows

    def filtered(self, rows: Rows, tests: list) -> Rows:
        rows = self.load(rows, *tests)
        df = rows.df
        for t in tests:
            df = df.where(self.expr(t, rows))
        return Rows(df, rows.kinds, rows.weight)

    def optional(self, rows: Rows, patterns: list, where: tuple | None) -> Rows:
        used = {v for nodes, steps in patterns for v, *_ in (*nodes, *steps) if v}
        used |= {n[1] for n in walk(where) if n and n[0] == "var"} if where is not None else set()
        keys = [v for v in rows.kinds if v in used]
        base = Rows(rows.df.select(*keys).distinct() if keys else self.graph.unit(), {v: rows.kinds[v] for v in keys})
        found = self.match(base, patterns, where)
        new = {k: v for k, v in found.kinds.items() if k not in keys and not k.startswith("_v")}
        side = found.df.select(*keys, *new)
        return Rows(rows.df.join(side, keys, "left") if keys else rows.df.join(side, F.lit(True), "left"), rows.kinds | new)

    # projections

    def aggregate(self, e: tuple, rows: Rows) -> Column:
        _, f, distinct, arg = e
        if f == "count*":
            return F.count(F.lit(1)) if rows.weight is None else F.coalesce(F.sum(rows.weight), F.lit(0))
        x = self.expr(arg, rows)
        if f == "count":
            return F.count_distinct(x) if distinct else F.count(x)
        if f == "sum":
            return F.coalesce(F.sum_distinct(x) if distinct else F.sum(x), F.lit(0))
        if f == "avg":
            return F.sum_distinct(x).cast("double") / F.count_distinct(x) if distinct else F.avg(x)
        if f == "collect":
            return F.collect_set(x) if distinct else F.collect_list(x)
        return F.min(x) if f == "min" else F.max(x)

    def project(self, rows: Rows, clause: tuple) -> Rows:
        word, distinct, items, order, skip, limit, where = clause
        if items is None:
            items = [(("var", v), None, v) for v in rows.kinds if not v.startswith("_v")]
        named = [(e, alias or (e[1] if e[0] == "var" else text)) for e, alias, text in items]
        if len({a for _, a in named}) < len(named):
            raise CypherError("two columns of one name")
        for e, _ in named:
            if e[0] != "agg" and any(n and n[0] == "agg" for n in walk(e)):
                raise CypherError("aggregates stand alone in a projection")
        rows = self.load(rows, [e for e, _ in named], [e for e, _ in order])
        aliases = {a for _, a in named}
        same = {repr(e): a for e, a in named}
        sort, hidden = [], []
        grouped = any(e[0] == "agg" for e, _ in named)
        for e, down in order:
            name = same.get(repr(e)) or (e[1] if e[0] == "var" and e[1] in aliases else None)
            if name is None:
                refers = {n[1] for n in walk(e) if n and n[0] == "var"}
                if grouped or distinct:
                    if not refers <= aliases:
                        raise CypherError("ORDER BY reads what the projection drops")
                    name = None
                else:
                    name = next(self.fresh)
                    hidden.append((self.expr(e, rows), name))
            sort.append((name, e, down))
        if grouped:
            keys = [self.expr(e, rows).alias(a) for e, a in named if e[0] != "agg"]
            made = [self.aggregate(e, rows).alias(a) for e, a in named if e[0] == "agg"]
            df = (rows.df.groupBy(*keys).agg(*made) if keys else rows.df.agg(*made)).select(*(F.col(f"`{a}`") for _, a in named))
        else:
            df = rows.df.select(*(self.expr(e, rows).alias(a) for e, a in named), *(c.alias(n) for c, n in hidden))
        kinds = {a: rows.kinds.get(e[1], "value") if e[0] == "var" else "value" for e, a in named}
        if distinct:
            df = df.distinct()
        out = Rows(df, kinds)
        if sort:
            cols = [F.col(f"`{n}`") if n else self.expr(e, out) for n, e, _ in sort]
            df = df.orderBy(*(c.desc_nulls_first() if down else c.asc_nulls_last() for c, (_, _, down) in zip(cols, sort, strict=True)))
        if skip is not None:
            df = df.offset(self.constant(skip))
        if limit is not None:
            df = df.limit(self.constant(limit))
        out = Rows(df.drop(*(n for _, n in hidden)), kinds)
        return self.filtered(out, [where]) if where is not None else out

    def constant(self, e: tuple) -> int:
        v = e[1] if e[0] == "lit" else self.value(e[1]) if e[0] == "param" else None
        if not isinstance(v, int) or isinstance(v, bool) or v < 0:
            raise CypherError("SKIP and LIMIT take a literal or parameter of at least 0")
        return v

    def search(self, rows: Rows, clause: tuple) -> Rows:
        _, proc, args, yields = clause
        if proc not in self.searches:
            raise CypherError(f"unknown procedure {proc}")
        eligible, values = None, []
        for a in args:
            if a[0] == "var":  # a collected list of nodes: what may be found
                if a[1] not in rows.kinds:
                    raise CypherError(f"unknown variable {a[1]}")
                eligible = rows.df.select(F.explode(F.col(f"`{a[1]}`")).alias("doc_id")).distinct()
            else:
                values.append(self.value(a[1]) if a[0] == "param" else a[1] if a[0] == "lit" else [x[1] for x in a[1]])
        hits = self.searches[proc](values, eligible).select(F.col("doc_id").alias("node"), "score")
        hits = hits.select(*(F.col(n).alias(a or n) for n, a in yields))
        kinds = {(a or n): "node" if n == "node" else "value" for n, a in yields}
        df = hits if not rows.df.columns or eligible is not None else rows.df.join(hits, F.lit(True))
        return Rows(df, (rows.kinds if eligible is None else {}) | kinds)

    # statements

    def read(self, text: str) -> DataFrame:
        clauses = parse(text)
        if clauses[-1][0] != "return":
            raise CypherError("a write: use write()")
        df = self.clauses(clauses).df
        if extra := set(self.params) - self.used:
            raise CypherError(f"unused parameters: {sorted(extra)}")
        return df

    def clauses(self, clauses: list) -> Rows:
        rows = Rows(self.graph.unit(), {})
        self.ahead = {}
        for n in walk(clauses):
            if n and n[0] == "prop" and len(n) == 3 and n[1][:1] == ("var",) and n[2] not in self.ahead.setdefault(n[1][1], []):
                self.ahead[n[1][1]].append(n[2])
        for i, c in enumerate(clauses):
            if c[0] == "match":
                counted = i + 1 < len(clauses) and self.only_counted(c, rows, clauses[i + 1])
                rows = self.optional(rows, c[2], c[3]) if c[1] else self.match(rows, c[2], c[3], counted)
            elif c[0] in ("with", "return"):
                rows = self.project(rows, c)
            elif c[0] == "call":
                rows = self.search(rows, c)
        return rows

    def write(self, text: str) -> Graph:
        """The graph after the statement. The rows that it writes for are those before any of its writes."""
        from ..sources.storage import stored

        clauses = parse(text)
        reads = [c for c in clauses if c[0] in ("match", "with")]
        rows = self.clauses(reads)
        writes = [c for c in clauses if c[0] not in ("match", "with", "return")]
        if reads:
            rows = self.load(rows, *writes)
            frozen = rows.df.select(*(F.col(f"`{c}`").alias(c.replace(".", "__dot__")) for c in rows.df.columns))
            back = stored(frozen, "eager")
            rows = Rows(back.select(*(F.col(c).alias(c.replace("__dot__", ".")) for c in back.columns)), rows.kinds)
        g = self.graph
        for c in writes:
            if c[0] in ("set", "remove"):
                for t in c[1]:
                    if rows.kinds.get(t[1]) not in ("node", "rel"):
                        raise CypherError(f"{t[1]} is neither a node nor a relationship")
                    if rows.kinds[t[1]] == "rel":
                        if t[0] == "label":
                            raise CypherError("a relationship has no labels")
                        value, kind = self.expr(t[3], rows), dict(g.rels.dtypes).get(t[2])
                        targets = rows.df.select(F.col(f"`{t[1]}`").alias("rel_id"), (value.cast(kind) if kind else value).alias("value"))
                        g = Mutable(g).set_rel_property(targets.where("rel_id is not null").dropDuplicates(["rel_id"]), t[2])
                        continue
                    ids = rows.df.select(F.col(f"`{t[1]}`").alias("id")).where("id is not null")
                    if t[0] == "label":
                        g = Mutable(g).set_label(ids, t[2], c[0] == "set")
                    else:
                        value = self.expr(t[3], rows)
                        kind = dict(g.nodes.dtypes).get(t[2])
                        targets = rows.df.select(F.col(f"`{t[1]}`").alias("id"), (value.cast(kind) if kind else value).alias("value")).where("id is not null").dropDuplicates(["id"])
                        g = Mutable(g).set_property(targets, t[2])
            elif c[0] == "delete":
                rels = [v for v in c[2] if rows.kinds.get(v) == "rel"]
                for v in rels:
                    g = Mutable(g).delete_relationships(rows.df.select(F.col(f"`{v}`").alias("rel_id")))
                for v in c[2]:
                    if v not in rels:
                        g = Mutable(g).delete_nodes(rows.df.select(F.col(f"`{v}`").alias("id")), c[1])
            elif c[0] == "create":
                g = self.create(g, rows, c[1])
        return g

    def create(self, g: Graph, rows: Rows, patterns: list) -> Graph:
        """New ids follow the largest in use, in the order of the frozen rows' hash."""
        for nodes, steps in patterns:
            here = {}
            top = g.nodes.agg(F.max(g.id)).first()[0] or 0
            base = rows.df if rows.df.columns else rows.df.withColumn("_one", F.lit(1))
            # ids unique and dense enough: partition and row number within it, above the largest id
            made = base.withColumn("_n", F.monotonically_increasing_id() * len(nodes))
            for i, (var, labels, props) in enumerate(nodes):
                if var and var in rows.kinds:
                    here[i] = F.col(f"`{var}`")
                    continue
                here[i] = F.col("_n") + top + 1 + i
                cols = [here[i].alias(g.id), F.array(*map(F.lit, labels)).cast("array<string>").alias("labels")]
                cols += [self.expr(v, rows).alias(k) for k, v in props.items()]
                g = Mutable(g).create_nodes(made.select(*cols))
            for i, (_, types, props, direction, hops) in enumerate(steps):
                if hops or direction == "both" or len(types) != 1:
                    raise CypherError("CREATE takes one directed relationship of one type")
                a, b = (here[i], here[i + 1]) if direction == "out" else (here[i + 1], here[i])
                last = g.rels.agg(F.max("rel_id")).first()[0] or 0
                cols = [(F.col("_n") + last + 1 + i).alias("rel_id"), a.alias("src"), b.alias("dst"), F.lit(types[0]).alias("type")]
                cols += [self.expr(v, rows).alias(k) for k, v in props.items()]
                g = Mutable(g).create_relationships(made.select(*cols))
        return g


def run(graph: Graph, text: str, params: dict[str, Any] | None = None, searches: dict[str, Search] | None = None) -> DataFrame:
    return Compiler(graph, params, searches).read(text)


def apply(graph: Graph, text: str, params: dict[str, Any] | None = None) -> Graph:
    return Compiler(graph, params).write(text)
