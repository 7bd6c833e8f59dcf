"""Lexer and parser of the Cypher profile. The syntax tree is plain tuples: (kind, ...)."""

from __future__ import annotations

import re

REFUSED = {"UNION", "USE", "START", "LOAD", "BEGIN", "COMMIT", "ROLLBACK", "EXPLAIN", "PROFILE", "MERGE", "UNWIND", "FOREACH", "DROP", "ALTER"}
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}
FUNCTIONS = {"labels", "type", "size", "coalesce", "tointeger", "tofloat", "floor", "round", "abs", "head", "last", "exists", "node_id", "relationship_id", "stored_text"}
TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*)|(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)|(?P<int>\d+)|(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")
    |(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<param>\$\w+)|(?P<op><>|<=|>=|\.\.|->|<-|[-+*/%=<>(){}\[\],.:|])""",
    re.X,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


class CypherError(ValueError):
    """The statement isn't in the profile, or doesn't fit its variables."""


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise CypherError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    def __init__(self, text: str):
        self.t, self.i = tokenize(text), 0

    def word(self, ahead: int = 0) -> str:
        kind, v = self.t[min(self.i + ahead, len(self.t) - 1)]
        return v.upper() if kind == "name" else v if kind == "op" else ""

    def take(self, *words: str) -> bool:
        if all(self.word(k) == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise CypherError(f"expected {' '.join(words)} before {self.t[self.i][1]!r}")

    def name(self) -> str:
        kind, v = self.t[self.i]
        if kind != "name":
            raise CypherError(f"expected a name before {v!r}")
        self.i += 1
        return v.strip("`")

    # clauses

    def statement(self) -> list[tuple]:
        clauses, wrote, searched = [], False, False
        while self.t[self.i][0] != "end":
            w = self.word()
            if w in REFUSED:
                raise CypherError(f"{w} is not supported")
            if w in ("OPTIONAL", "MATCH"):
                if wrote:
                    raise CypherError("reads after writes are not supported")
                optional = self.take("OPTIONAL")
                self.need("MATCH")
                patterns = self.patterns()
                clauses.append(("match", optional, patterns, self.expr() if self.take("WHERE") else None))
            elif w == "CREATE":
                self.i += 1
                clauses.append(("create", self.patterns()))
                wrote = True
            elif w in ("SET", "REMOVE"):
                self.i += 1
                clauses.append((w.lower(), self.listed(self.assignment if w == "SET" else self.removal)))
                wrote = True
            elif w in ("DETACH", "DELETE"):
                detach = self.take("DETACH")
                self.need("DELETE")
                clauses.append(("delete", detach, self.listed(self.name)))
                wrote = True
            elif w == "CALL":
                self.i += 1
                clauses.append(self.call())
                searched = True
            elif w in ("WITH", "RETURN"):
                self.i += 1
                clauses.append(self.projection(w))
                if w == "RETURN" and self.t[self.i][0] != "end":
                    raise CypherError("RETURN ends a statement" if self.word() not in REFUSED else f"{self.word()} is not supported")
            else:
                raise CypherError(f"unexpected {self.t[self.i][1]!r}")
        if not clauses:
            raise CypherError("an empty statement")
        if wrote and searched:
            raise CypherError("a statement can't search and write")
        if clauses[-1][0] not in ("return", "create", "set", "remove", "delete"):
            raise CypherError("a statement ends with RETURN or a write")
        return clauses

    def listed(self, one) -> list:
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    def assignment(self) -> tuple:
        var = self.name()
        if self.take(":"):
            return ("label", var, self.name())
        self.need(".")
        prop = self.name()
        self.need("=")
        return ("prop", var, prop, self.expr())

    def removal(self) -> tuple:
        var = self.name()
        if self.take(":"):
            return ("label", var, self.name())
        self.need(".")
        return ("prop", var, self.name(), ("lit", None))

    def call(self) -> tuple:
        self.name()
        self.need(".")
        proc = self.name().lower()
        self.need("(")
        args = [] if self.word() == ")" else self.listed(self.expr)
        self.need(")")
        self.need("YIELD")
        yields = self.listed(lambda: (self.name(), self.name() if self.take("AS") else None))
        return ("call", proc, args, yields)

    def projection(self, w: str) -> tuple:
        distinct = self.take("DISTINCT")
        items = []
        if self.take("*"):
            items = None
        else:
            for k in self.listed(self.item):
                if w == "WITH" and k[1] is None and k[0][0] != "var":
                    raise CypherError("WITH needs an alias for an expression")
                items.append(k)
        order = []
        if self.take("ORDER", "BY"):
            order = self.listed(lambda: (self.expr(), self.take("DESC") or self.take("DESCENDING") or (self.take("ASC") or self.take("ASCENDING")) and False))
        skip = self.expr() if self.take("SKIP") else None
        limit = self.expr() if self.take("LIMIT") else None
        where = self.expr() if w == "WITH" and self.take("WHERE") else None
        return (w.lower(), distinct, items, order, skip, limit, where)

    def item(self) -> tuple:
        start = self.i
        e = self.expr()
        text = "".join(v if k != "name" else v for k, v in self.t[start : self.i])
        return (e, self.name() if self.take("AS") else None, text)

    # patterns: (nodes, rels) with node (var, labels, props), rel (var, types, props, direction, hops)

    def patterns(self) -> list[tuple]:
        return self.listed(self.pattern)

    def pattern(self) -> tuple:
        nodes, rels = [self.node()], []
        while self.word() in ("-", "<-"):
            rels.append(self.rel())
            nodes.append(self.node())
        return nodes, rels

    def node(self) -> tuple:
        self.need("(")
        var = self.name() if self.t[self.i][0] == "name" else None
        labels = []
        while self.take(":"):
            labels.append(self.name())
        props = self.map() if self.word() == "{" else {}
        self.need(")")
        return var, labels, props

    def rel(self) -> tuple:
        back = self.take("<-")
        if not back:
            self.need("-")
        var, types, props, hops = None, [], {}, None
        if self.take("["):
            var = self.name() if self.t[self.i][0] == "name" else None
            if self.take(":"):
                types.append(self.name())
                while self.take("|"):
                    self.take(":")
                    types.append(self.name())
            if self.take("*"):
                low = self.int() if self.t[self.i][0] == "int" else None
                if self.take(".."):
                    hops = (1 if low is None else low, self.int())
                elif low is None:
                    raise CypherError("a variable length needs an upper bound")
                else:
                    hops = (low, low)
                if hops[1] > 16:
                    raise CypherError("at most 16 hops")
            props = self.map() if self.word() == "{" else {}
            self.need("]")
        if back:
            self.need("-")
            return var, types, props, "in", hops
        return var, types, props, "out" if self.take("->") else "both" if self.take("-") else self.need("->"), hops

    def int(self) -> int:
        kind, v = self.t[self.i]
        if kind != "int":
            raise CypherError("expected an integer")
        self.i += 1
        return int(v)

    def map(self) -> dict:
        self.need("{")
        out = {}
        while not self.take("}"):
            k = self.name()
            self.need(":")
            out[k] = self.expr()
            self.take(",")
        return out

    # expressions, loosest first

    def expr(self) -> tuple:
        return self.chain(self.xor, {"OR": "or"})

    def xor(self) -> tuple:
        return self.chain(self.conj, {"XOR": "xor"})

    def conj(self) -> tuple:
        return self.chain(self.neg, {"AND": "and"})

    def chain(self, below, words: dict) -> tuple:
        out = below()
        while self.word() in words:
            op = words[self.word()]
            self.i += 1
            out = (op, out, below())
        return out

    def neg(self) -> tuple:
        return ("not", self.neg()) if self.take("NOT") else self.comparison()

    def comparison(self) -> tuple:
        left, parts = self.sum(), []
        while True:
            w = self.word()
            if w in ("=", "<>", "<", "<=", ">", ">="):
                self.i += 1
                right = self.sum()
                parts.append(("cmp", w, left, right))
                left = right
            elif w == "IN":
                self.i += 1
                left = ("in", left, self.sum())
            elif w == "STARTS" and self.take("STARTS", "WITH"):
                left = ("starts", left, self.sum())
            elif w == "ENDS" and self.take("ENDS", "WITH"):
                left = ("ends", left, self.sum())
            elif w == "CONTAINS":
                self.i += 1
                left = ("contains", left, self.sum())
            elif self.take("IS", "NOT", "NULL"):
                left = ("not", ("null", left))
            elif self.take("IS", "NULL"):
                left = ("null", left)
            else:
                break
        out = parts[0] if parts else left
        for p in parts[1:]:
            out = ("and", out, p)
        return out

    def sum(self) -> tuple:
        return self.chain(self.product, {"+": "+", "-": "-"})

    def product(self) -> tuple:
        return self.chain(self.unary, {"*": "*", "/": "/", "%": "%"})

    def unary(self) -> tuple:
        if self.take("-"):
            return ("neg", self.unary())
        return self.unary() if self.take("+") else self.postfix()

    def postfix(self) -> tuple:
        out = self.atom()
        while True:
            if self.take("."):
                out = ("prop", out, self.name())
            elif self.take("["):
                out = ("index", out, self.expr())
                self.need("]")
            elif out[0] == "var" and self.word() == ":":
                labels = []
                while self.take(":"):
                    labels.append(self.name())
                out = ("haslabels", out[1], labels)
            else:
                return out

    def atom(self) -> tuple:
        kind, v = self.t[self.i]
        w = self.word()
        if kind == "int":
            self.i += 1
            if int(v) >= 2**63:
                raise CypherError("integer out of range")
            return ("lit", int(v))
        if kind == "float":
            self.i += 1
            return ("lit", float(v))
        if kind == "string":
            self.i += 1
            return ("lit", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), v[1:-1]))
        if kind == "param":
            self.i += 1
            return ("param", v[1:])
        if w in ("TRUE", "FALSE", "NULL"):
            self.i += 1
            return ("lit", {"TRUE": True, "FALSE": False, "NULL": None}[w])
        if w == "CASE":
            return self.case()
        if w == "[":
            return self.list()
        if w == "{":
            return ("map", self.map())
        if w == "(":
            at = self.i
            try:
                nodes, rels = self.pattern()
                if rels:
                    return ("pattern", (nodes, rels))
            except CypherError:
                pass
            self.i = at + 1
            out = self.expr()
            self.need(")")
            return out
        name = self.name()
        if self.word() == "." and self.word(2) == "(" and name.lower() not in ("",) and self.t[self.i + 1][1].lower() in FUNCTIONS:
            self.i += 1
            name = self.name()
        if self.take("("):
            f = name.lower()
            if f not in FUNCTIONS | AGGREGATES:
                raise CypherError(f"unknown function {name}")
            if f == "count" and self.take("*"):
                self.need(")")
                return ("agg", "count*", False, None)
            if f == "exists" and self.word() == "(":
                p = self.pattern()
                self.need(")")
                return ("pattern", p)
            distinct = f in AGGREGATES and self.take("DISTINCT")
            args = [] if self.word() == ")" else self.listed(self.expr)
            self.need(")")
            return ("agg", f, distinct, args[0]) if f in AGGREGATES else ("call", f, args)
        return ("var", name)

    def case(self) -> tuple:
        self.need("CASE")
        subject = None if self.word() == "WHEN" else self.expr()
        branches = []
        while self.take("WHEN"):
            c = self.expr()
            self.need("THEN")
            branches.append((c if subject is None else ("cmp", "=", subject, c), self.expr()))
        other = self.expr() if self.take("ELSE") else ("lit", None)
        self.need("END")
        return ("case", branches, other)

    def list(self) -> tuple:
        self.need("[")
        if self.t[self.i][0] == "name" and self.word(1) == "IN":
            var = self.name()
            self.need("IN")
            source = self.expr()
            where = self.expr() if self.take("WHERE") else None
            out = self.expr() if self.take("|") else ("var", var)
            self.need("]")
            return ("comprehension", var, source, where, out)
        items = [] if self.word() == "]" else self.listed(self.expr)
        self.need("]")
        return ("list", items)


def parse(text: str) -> list[tuple]:
    return Parser(text).statement()


def walk(node):
    """All tuples of a tree."""
    if isinstance(node, tuple):
        yield node
        for x in node:
            yield from walk(x)
    elif isinstance(node, list):
        for x in node:
            yield from walk(x)
    elif isinstance(node, dict):
        for x in node.values():
            yield from walk(x)
