import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.operators import documents as D
from veldspar.operators import graph as G
from veldspar.operators import predicates as P
from veldspar.operators.documents import StaleRevision
from veldspar.plans import cypher
from veldspar.plans.syntax import CypherError, parse
from veldspar.sources import store as S
from veldspar.streaming import ingest


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(1, ["P"], "ann", 30), (2, ["P"], "bob", None), (3, ["P", "Q"], "cy", 20)], "id long, labels array<string>, name string, age long")
    rels = spark.createDataFrame([(10, 1, 2, "K", 1.0), (11, 2, 3, "K", 2.0), (12, 3, 3, "K", 3.0), (13, 1, 3, "L", 4.0)], "rel_id long, src long, dst long, type string, weight double")
    return G.Graph(nodes, rels)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MATCH (a)-[:K]->(b) RETURN a.name AS a, b.name AS b", [("ann", "bob"), ("bob", "cy"), ("cy", "cy")]),
        ("MATCH (a {name: 'cy'})-[r]-(b) RETURN b.name AS b", [("ann",), ("bob",), ("cy",)]),
        ("MATCH (a)-[:K]->(b)-[:K]->(c) RETURN a.name AS a, c.name AS c", [("ann", "cy"), ("bob", "cy")]),
        ("MATCH (a:P:Q) RETURN a.name AS n", [("cy",)]),
        ("MATCH (a) WHERE NOT (a.age > 25) RETURN a.name AS n", [("cy",)]),
        ("MATCH (a) WHERE a.age IS NULL RETURN a.name AS n", [("bob",)]),
        ("MATCH (a) WHERE (a)-[:L]->() OR a.name = 'bob' RETURN a.name AS n", [("ann",), ("bob",)]),
        ("MATCH (a) WHERE NOT exists((a)-[:L]->()) RETURN a.name AS n", [("bob",), ("cy",)]),
        ("MATCH (a) OPTIONAL MATCH (a)-[:L]->(b) RETURN a.name AS a, b.name AS b", [("ann", "cy"), ("bob", None), ("cy", None)]),
        ("MATCH (a) RETURN sum(a.age) AS s, avg(a.age) AS m, count(a.age) AS c, count(*) AS n", [(50, 25.0, 2, 3)]),
        ("MATCH (a) RETURN a.age AS x ORDER BY x DESC LIMIT 1", [(None,)]),
        ("MATCH p = 1 RETURN 1 AS x", None),
        ("MATCH (a)-[r:K*1..3]->(b) WHERE a.name = 'ann' RETURN b.name AS b, size(r) AS n", [("bob", 1), ("cy", 2), ("cy", 3)]),
        ("MATCH (a:P) WITH a.name AS n ORDER BY n SKIP 1 LIMIT 1 RETURN n", [("bob",)]),
        ("RETURN 1 < 2 < 3 AS a, 1 IN [1, null] AS b, 'abc' CONTAINS 'b' AS c, toInteger('x') AS d, head([7, 8]) AS e, last([7, 8]) AS f, -7 / 2 AS g", [(True, True, True, None, 7, 8, -3)]),
        ("MATCH (a) RETURN labels(a) AS l, id.node_id(a) AS i ORDER BY i LIMIT 1", [(["P"], "0" * 31 + "1")]),
        ("MATCH (a) RETURN a.missing AS x LIMIT 1", [(None,)]),
    ],
)
def test_cypher(graph, text, want):
    if want is None:
        with pytest.raises(CypherError):
            cypher.run(graph, text)
    else:
        assert rows(cypher.run(graph, text)) == want


@pytest.mark.parametrize(
    "text",
    ["", "MATCH (a) UNION MATCH (b)", "MERGE (a) RETURN a", "UNWIND [1] AS x RETURN x", "MATCH (a)-[*]->(b) RETURN a", "MATCH (a)-[*1..17]->(b) RETURN a", "MATCH (a) RETURN b", "MATCH (a) RETURN 1 + count(a) AS x", "MATCH (a) RETURN foo(a) AS x", "MATCH (a) RETURN a.name AS x, a.age AS x", "MATCH (a) WITH a.name RETURN 1 AS x", "MATCH (a) RETURN a.name AS n LIMIT 1.5", "MATCH (a) RETURN $p AS x", "MATCH (a)", "CREATE (a:X) MATCH (b) RETURN b", "LOAD CSV FROM 'x' RETURN 1"],
)
def test_cypher_refusals(graph, text):
    with pytest.raises(CypherError):
        cypher.run(graph, text)


def test_unused_parameters(graph):
    with pytest.raises(CypherError):
        cypher.run(graph, "MATCH (a) RETURN a.name AS n", {"x": 1})
    assert parse("RETURN 'it\\'s' AS x")[0][2][0][0] == ("lit", "it's")


def test_writes(graph):
    g = cypher.apply(graph, "MATCH (a:P) WHERE a.age IS NULL SET a.age = 7, a:Young")
    assert rows(cypher.run(g, "MATCH (a:Young) RETURN a.name AS n, a.age AS x")) == [("bob", 7)]
    g = cypher.apply(g, "MATCH (a:Young) REMOVE a:Young, a.age")
    assert rows(cypher.run(g, "MATCH (a:P) WHERE a.age IS NULL RETURN a.name AS n")) == [("bob",)]
    g = cypher.apply(g, "CREATE (x:R {name: 'dee'})-[:K]->(y:R {name: 'eve'})")
    assert rows(cypher.run(g, "MATCH (x:R)-[:K]->(y) RETURN x.name AS x, y.name AS y")) == [("dee", "eve")]
    with pytest.raises(G.IntegrityError):
        cypher.apply(g, "MATCH (a) WHERE a.name = 'ann' DELETE a")
    g = cypher.apply(g, "MATCH (a) WHERE a.name = 'ann' DETACH DELETE a")
    assert rows(cypher.run(g, "MATCH ()-[r]->() RETURN count(r) AS n")) == [(3,)]
    g = cypher.apply(g, "MATCH (a)-[r:K]->(b) WHERE a.name = 'cy' DELETE r")
    assert rows(cypher.run(g, "MATCH ()-[r]->() RETURN count(r) AS n")) == [(2,)]


def test_relationships_need_ends(spark, graph):
    with pytest.raises(G.IntegrityError):
        G.Mutable(graph).create_relationships(spark.createDataFrame([(99, 1, 77, "K", 1.0)], graph.rels.schema))


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType(), False), T.StructField("revision", T.LongType(), False), T.StructField("ts", T.LongType(), False), T.StructField("text", T.StringType())])


def test_store(spark, tmp_path):
    s = S.Store.create(spark, f"file://{tmp_path}/s", SCHEMA, "e1")
    batch = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    s.ingest(batch((1, 1, 10, "a"), (2, 1, 20, "b"), (3, 1, 30, "c")))
    first = s.generation
    old = S.Store(spark, f"file://{tmp_path}/s", read_only=True)
    s.ingest(batch((2, 2, 25, "B"), (4, 1, 40, "d")), "e1")
    assert s.ingest(batch((2, 2, 25, "again"))) == s.generation
    assert rows(s.live().select("doc_id", "text")) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    assert rows(old.live().select("text")) == [("a",), ("b",), ("c",)] == rows(S.Store(spark, f"file://{tmp_path}/s", generation=first).live().select("text"))
    with pytest.raises(StaleRevision):
        s.ingest(batch((2, 1, 1, "x"), (9, 1, 1, "y")))
    with pytest.raises(S.EpochMismatch):
        s.ingest(batch((9, 1, 1, "y")), "e2")
    with pytest.raises(PermissionError):
        old.delete(spark.range(1).withColumnRenamed("id", "doc_id"))
    pages = list(s.pages(3))
    assert [r.doc_id for p in pages for r in p] == [1, 2, 3, 4]
    page, cursor = s.scan(2)
    mark = cursor(page.collect()[-1])
    s.apply_retention(20, 45)
    assert rows(s.live().select("doc_id")) == [(2,), (3,), (4,)]
    with pytest.raises(S.StaleCursor):
        s.scan(2, cursor=mark)
    s.drop_partition(30, 40)
    s.delete_where(P.Eq("text", "d"))
    s.seal()
    s.add_column("extra", T.DoubleType())
    with pytest.raises(S.SchemaError):
        s.add_column("extra", T.DoubleType())
    assert rows(s.live()) == [(2, 2, 25, "B", None)] and s.count() == 1
    assert s.verify() == {"rows": 1, "repeated": 0, "no_key": 0, "no_ts": 0}
    s.write_snapshot(f"file://{tmp_path}/copy")
    assert S.Store(spark, f"file://{tmp_path}/copy").count() == 1
    assert [r.found for r in s.get([2, 5]).collect()] == [True, False]


def test_store_purges_and_keeps_sets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MOST_SETS", 3)
    s = S.Store.create(spark, f"file://{tmp_path}/s", SCHEMA)
    batch = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "doc_id long")
    s.ingest(batch((1, 1, 10, "secret"), (2, 1, 20, "b"), (3, 1, 30, "c")))
    s.ingest(batch((2, 2, 21, "bb")))
    assert [k for _, k in s.state["files"]] == ["new", "newer"]
    s.delete(ids(3, 99))
    assert s.delete(ids(99)) == s.generation and [k for _, k in s.state["files"]] == ["new", "newer", "gone"]
    s.ingest(batch((3, 1, 31, "back")))
    assert rows(s.live().select("doc_id", "text")) == [(1, "secret"), (2, "bb"), (3, "back")]
    with pytest.raises(StaleRevision):
        s.delete_if(spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, expected long"))
    s.delete_if(spark.createDataFrame([(2, 2)], "doc_id long, expected long"))
    other = S.Store(spark, f"file://{tmp_path}/s")
    s.purge(ids(1))
    with pytest.raises(S.StaleCursor):
        other.ingest(batch((8, 1, 1, "late")))
    kept = [spark.read.parquet(str(p)).collect() for p in (tmp_path / "s" / "data").iterdir()]
    assert [(r.doc_id, r.text) for t in kept for r in t] == [(3, "back")] and len(list((tmp_path / "s" / "generations").glob("*.json"))) == 1
    assert S.Store(spark, f"file://{tmp_path}/s").health()["ok"]
    page, cursor = s.scan_ordered("revision", 1)
    assert page.count() == 1 and s.scan(5, "storage", columns=["text"])[0].columns == ["doc_id", "ts", "text"]
    with pytest.raises(ValueError):
        s.scan(5, "no such order")
    for i in range(5):
        s.ingest(batch((3, 2 + i, 31, f"v{i}")))
    assert len(s.state["files"]) <= 4 and rows(s.live().select("text")) == [("v4",)]


def test_namespaces_commit_together(spark, tmp_path):
    n = S.Namespaces(spark, f"file://{tmp_path}/n")
    n.create("a", SCHEMA)
    n.create("b", SCHEMA)
    batch = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    n.batch({"a": lambda s: s.ingest(batch((1, 1, 1, "x"))), "b": lambda s: s.ingest(batch((2, 1, 1, "y")))})

    def fails(s):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        n.batch({"a": lambda s: s.ingest(batch((9, 1, 1, "lost"))), "b": fails})
    assert rows(n.open("a").live().select("doc_id")) == [(1,)] and rows(n.open("b").live().select("doc_id")) == [(2,)]
    n.batch({"a": lambda s: s.delete(spark.createDataFrame([(1,)], "doc_id long"))})
    assert n.open("a").count() == 0
    n.drop("b")
    assert n.names() == ["a"]
    with pytest.raises(FileNotFoundError):
        n.open("b")


def test_texts_in_a_store(spark, tmp_path):
    schema = SCHEMA.add("parent_id", T.LongType())
    s = S.Store.create(spark, f"file://{tmp_path}/s", schema)
    texts = lambda *r: spark.createDataFrame(list(r), "parent_id long, revision long, ts long, text string")
    s.ingest_text(texts((1, 1, 5, "red fox jumps over lazy dogs"), (2, 1, 6, "blue whales sing")), longest=4, overlap=1)
    assert s.count() == 3
    assert [(r.doc_id, r.text) for r in s.query_text("blue whales", k=5).collect()] == [(2 << 20, "blue whales sing")]
    s.ingest_text(texts((1, 2, 7, "red fox")), longest=4, overlap=1)
    assert rows(s.live().select("text")) == [("blue whales sing",), ("red fox",)]
    assert s.query_text("lazy").count() == 0 and s.query_text("fox").count() == 1
    s.delete_text(spark.createDataFrame([(1,)], "parent_id long"))
    assert rows(s.live().select("parent_id")) == [(2,)]


def test_cascades(spark):
    t = {"a": spark.createDataFrame([(1,), (2,)], "k long"), "b": spark.createDataFrame([(10, 1), (11, 2)], "k long, a long"), "c": spark.createDataFrame([(100, 10, None), (101, 11, 1), (102, 11, 2)], "k long, b long, a long")}
    rules = [("a", "b", "a"), ("b", "c", "b"), ("a", "c", "a")]
    gone = D.cascade_by_rules(t, dict.fromkeys(t, "k"), rules, "a", spark.createDataFrame([(1,)], "k long"))
    assert rows(gone["b"]) == [(10,)] and rows(gone["c"]) == [(100,), (101,)]
    with pytest.raises(D.CycleError):
        D.check_rules([*rules, ("c", "a", "c")])
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "parent long, child long")
    roots = spark.createDataFrame([(1,)], "id long")
    assert rows(D.cascade_closure(edges, roots)) == [(1,), (2,), (3,), (4,)]
    with pytest.raises(D.CycleError):
        D.cascade_closure(edges, roots, refuse_cycles=True)
    assert D.cascade_closure(edges.where("child <> 1"), roots, refuse_cycles=True).count() == 4


def test_writes_to_relationships(graph):
    g = cypher.apply(graph, "MATCH (a)-[r:K]->(b) WHERE b.name = 'cy' SET r.weight = 9.0, r.note = 'n'")
    assert rows(cypher.run(g, "MATCH ()-[r]->() WHERE r.weight = 9.0 RETURN r.note AS n, count(r) AS c")) == [("n", 2)]
    assert rows(g.nodes) == rows(graph.nodes)
    g = cypher.apply(g, "MATCH ()-[r:L]->() REMOVE r.weight")
    assert rows(cypher.run(g, "MATCH ()-[r]->() RETURN count(r.weight) AS c")) == [(3,)]
    for text in ("MATCH ()-[r:K]->() SET r:Label", "MATCH ()-[r:K]->() SET r.src = 1"):
        with pytest.raises((CypherError, G.IntegrityError)):
            cypher.apply(graph, text)
    assert rows(cypher.run(graph, "MATCH (a) WHERE a.name + a.name = 'cycy' RETURN a.name + '!' AS n, toFloat('inf') AS f")) == [("cy!", None)]


def test_keyed_changes(spark):
    kinds = "kind string, namespace string, key string, op string, entity_id long, revision long, expected long, name string"
    put = lambda *r: spark.createDataFrame([("node", "n", *x) for x in r], kinds)
    g = G.KeyedGraph.empty(spark, "name string").apply(put(("a", "create", 1, 1, None, "x"), ("b", "create", 2, 1, None, "y")))
    again = g.apply(put(("a", "create", 1, 1, None, "other")))
    assert rows(again.live().select("key", "name")) == [("a", "x"), ("b", "y")]
    with pytest.raises(G.IntegrityError):
        g.apply(put(("a", "put", 1, 2, 1, "z"), ("b", "create", 5, 9, None, "w")))
    with pytest.raises(G.IntegrityError):
        g.apply(put(("c", "create", 3, 1, None, "z"), ("c", "create", 4, 1, None, "w")))
    g = g.apply(put(("a", "put", 1, 2, 1, "z"), ("b", "delete", 2, 2, None, None)))
    assert rows(g.live().select("key", "revision", "name")) == [("a", 2, "z")]
    g = g.apply(put(("b", "recreate", 7, 3, 2, "new")))
    assert rows(g.lookup(spark.createDataFrame([("node", "n", "b")], "kind string, namespace string, key string")).select("entity_id", "name")) == [(7, "new")]


def test_streams(spark, tmp_path):
    s = S.Store.create(spark, f"file://{tmp_path}/s", SCHEMA)
    spark.createDataFrame([(1, 1, 10, "a"), (1, 2, 11, "b"), (2, 1, 12, "c")], SCHEMA).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest.ingest_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), s, f"{tmp_path}/ck").awaitTermination()
    assert rows(s.refresh().live().select("doc_id", "text")) == [(1, "b"), (2, "c")]
    spark.createDataFrame([("2024-01-01 00:00:01", "x", 1.0), ("2024-01-01 00:00:02", "x", 2.0), ("2024-01-01 02:00:00", "y", 3.0)], "ts string, event_type string, value double").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(f"{tmp_path}/ev")
    q = ingest.windowed_counts(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/ev"), "1 hour", "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("w").select("event_type", "n", "total")) == [("x", 2, 3.0), ("y", 1, 3.0)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def pairs(spark):
    """Nodes 1 to 6 of two kinds, all IN 9, one of them twice, and a loop."""
    nodes = spark.createDataFrame([(i, ["A" if i < 4 else "B"], float(i)) for i in range(1, 7)] + [(9, ["N"], 0.0)], "id long, labels array<string>, w double")
    rels = spark.createDataFrame([(10 + i, i, 9, "IN") for i in range(1, 7)] + [(20, 1, 9, "IN"), (21, 9, 9, "IN")], "rel_id long, src long, dst long, type string")
    return G.Graph(nodes, rels)


@pytest.mark.parametrize("pattern", ["(a)-[:IN]->(n)<-[:IN]-(b)", "(n)<-[:IN]-(a)-[:IN]->(b)", "(a)-[:IN]-(n)-[:IN]-(b)", "(a)<-[:IN]-(n)-[:IN]->(b)"])
def test_cypher_counts_a_last_step_without_its_rows(pairs, pattern):
    counted = cypher.run(pairs, f"MATCH {pattern} WHERE a.w > 1.0 RETURN count(*) AS n")
    listed = cypher.run(pairs, f"MATCH {pattern} WHERE a.w > 1.0 RETURN a.id AS a, b.id AS b")
    assert counted.first().n == listed.count()
    by = cypher.run(pairs, f"MATCH {pattern} RETURN a.id AS a, count(*) AS n")
    assert sorted(by.collect()) == sorted(cypher.run(pairs, f"MATCH {pattern} RETURN a.id AS a, count(b) AS n").collect())
    assert "_r" not in _plan(counted).split("Join")[0] and "count(1)" in _plan(counted)


def test_cypher_filters_before_it_multiplies(pairs):
    found = cypher.run(pairs, "MATCH (a:A)-[:IN]->(n), (b:B)-[:IN]->(n) WHERE a.w > 2.0 AND b.w < 6.0 AND a.w < b.w RETURN a.w AS a, b.w AS b")
    assert sorted(found.collect()) == [(3.0, 4.0), (3.0, 5.0)]
    plan = _plan(found)
    assert "Join Cross" not in plan and plan.count("Join") == 3  # one for each relationship and one for n: no product, no property is joined in


def test_cypher_relationships_of_two_patterns_differ(pairs):
    both = cypher.run(pairs, "MATCH (a)-[r:IN]->(n), (b)-[s:IN]->(n) RETURN a.id AS a, b.id AS b")
    assert both.count() == 8 * 7
    assert cypher.run(pairs, "MATCH (a:A), (b:B) WHERE a.w + 3.0 = b.w RETURN a.w AS a").count() == 3
