"""Queries over the property graph, by operators and by Cypher; both have the same SQL to match."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion as H
from ..operators import graph as G
from ..operators import lexical as L
from ..operators import vector as V
from ..sources import tables as T
from . import cypher
from .retrieval import QUERY, TERMS, VALUES, D2, bm25_sql, text_index

queries: dict = {}
sql: dict[str, str] = {}
NAT, CUS, ORD, REG, PART = T.NATION, T.CUSTOMER, T.ORDER, T.REGION, T.PART


def query(oracle: str | None = None, name: str | None = None):
    def keep(f):
        queries[name or f.__name__] = f
        if oracle:
            sql[name or f.__name__] = oracle
        return f

    return keep


def twin(name: str, oracle: str, text: str, operators=None, params: dict | None = None, turns: bool = False):
    """Register cypher_<name> and, if given, graph_<name>."""
    make = T.turn_graph if turns else T.business_graph
    query(oracle, f"cypher_{name}")(lambda spark, d: cypher.run(make(spark, d), text, params))
    if operators:
        query(oracle, f"graph_{name}")(lambda spark, d: operators(make(spark, d)))


twin("scan_label", "select n_name as name from nation", "MATCH (n:Nation) RETURN n.name AS name", lambda g: g.with_properties(g.scan("n", ["Nation"]), "n", ["name"]).select(F.col("`n.name`").alias("name")))
twin("lookup", "select c_name as name, c_acctbal as balance from customer where c_custkey = 7", f"MATCH (c) WHERE c.id = {CUS + 7} RETURN c.name AS name, c.balance AS balance", lambda g: g.with_properties(g.lookup("c", CUS + 7), "c", ["name", "balance"]).select(F.col("`c.name`").alias("name"), F.col("`c.balance`").alias("balance")))
twin("count_all", "select (select count(*) from region) + (select count(*) from nation) + (select count(*) from customer) + (select count(*) from orders) + (select count(*) from supplier) + (select count(*) from part) as n", "MATCH (n) RETURN count(*) AS n", lambda g: g.scan("n").agg(F.count(F.lit(1)).alias("n")))
twin("count_rels", "select count(*) n from customer", "MATCH ()-[r:IN_NATION]->() RETURN count(r) AS n", lambda g: g.edges("out", ["IN_NATION"]).agg(F.count(F.lit(1)).alias("n")))
twin(
    "expand_out", "select c_name as customer, n_name as nation from customer join nation on c_nationkey = n_nationkey where c_acctbal > 9000",
    "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WHERE c.balance > 9000.0 RETURN c.name AS customer, n.name AS nation",
    lambda g: g.with_properties(g.with_properties(g.expand(g.scan("c", ["Customer"]), "c", "n", types=["IN_NATION"]), "c", ["name", "balance"]).where("`c.balance` > 9000"), "n", ["name"]).select(F.col("`c.name`").alias("customer"), F.col("`n.name`").alias("nation")),
)
twin("expand_in", "select n_name as nation, count(*) as n from nation join customer on c_nationkey = n_nationkey group by 1", "MATCH (n:Nation)<-[:IN_NATION]-(c) RETURN n.name AS nation, count(c) AS n", lambda g: g.with_properties(g.expand(g.scan("n", ["Nation"]), "n", "c", direction="in", types=["IN_NATION"]), "n", ["name"]).groupBy(F.col("`n.name`").alias("nation")).agg(F.count("c").alias("n")))
twin(
    "expand_either", "with e as (select n_nationkey k, 'r' t from nation union all select c_nationkey, 'c' from customer union all select s_nationkey, 's' from supplier) select k::bigint as key, count(*) as n from e group by 1",
    "MATCH (n:Nation)-[r:IN_REGION|IN_NATION|LOCATED]-(x) RETURN n.key AS key, count(*) AS n",
    lambda g: g.with_properties(g.expand(g.scan("n", ["Nation"]), "n", "x", "r", "both", ["IN_REGION", "IN_NATION", "LOCATED"]), "n", ["key"]).groupBy(F.col("`n.key`").alias("key")).agg(F.count(F.lit(1)).alias("n")),
)
twin("two_hop", "select r_name as region, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1", "MATCH (c:Customer)-[:IN_NATION]->(:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(*) AS n", lambda g: g.with_properties(g.expand(g.expand(g.scan("c", ["Customer"]), "c", "n", types=["IN_NATION"]), "n", "r", types=["IN_REGION"]), "r", ["name"]).groupBy(F.col("`r.name`").alias("region")).agg(F.count(F.lit(1)).alias("n")))

TURN = "with recursive t as (select conv_id * 1000 + turn id, role from conversations), e as (select a.id src, b.id dst from t a join t b on b.id = a.id + 1), "
twin(
    "bounded_1_3", TURN + "p(a, b, h) as (select src, dst, 1 from e union all select p.a, e.dst, h + 1 from p join e on p.b = e.src where h < 3) select a, b from p",
    "MATCH (a:Turn)-[:NEXT*1..3]->(b) RETURN a.id AS a, b.id AS b", lambda g: g.bounded(g.scan("a", ["Turn"]), "a", "b", 1, 3, types=["NEXT"]).select("a", "b"), turns=True,
)
twin(
    "zero_hop", TURN + "p(a, b, h) as (select id, id, 0 from t where role = 'user' union all select p.a, e.dst, h + 1 from p join e on p.b = e.src where h < 2) select a, b, h::bigint as hops from p",
    "MATCH (a:Turn {role: 'user'})-[r:NEXT*0..2]->(b) RETURN a.id AS a, b.id AS b, size(r) AS hops",
    lambda g: g.bounded(g.with_properties(g.scan("a"), "a", ["role"]).where("`a.role` = 'user'"), "a", "b", 0, 2, path="r", types=["NEXT"]).select("a", "b", F.size("r").cast("long").alias("hops")), turns=True,
)
twin(
    "bounded_undirected", TURN + "w as (select src a, dst b from e union all select dst, src from e) select x.a, y.b, count(*) n from w x join w y on x.b = y.a and least(x.a, x.b) <> least(y.a, y.b) where x.a % 1000 = 0 group by 1, 2",
    "MATCH (a:Turn)-[:NEXT*2]-(b) WHERE a.turn = 0 RETURN a.id AS a, b.id AS b, count(*) AS n", turns=True,
)
twin(
    "optional", "select c_custkey::bigint as key, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey and o_totalprice > 400000 group by 1",
    "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o) WHERE o.balance > 400000.0 RETURN c.key AS key, count(o) AS n",
    lambda g: g.with_properties(G.optional(g.scan("c", ["Customer"]), g.with_properties(g.expand(g.scan("c", ["Customer"]), "c", "o", types=["PLACED"]), "o", ["balance"]).where("`o.balance` > 400000"), ["c"]), "c", ["key"]).groupBy(F.col("`c.key`").alias("key")).agg(F.count("o").alias("n")),
)
twin("exists", "select c_custkey::bigint as key from customer where exists (select 1 from orders where o_custkey = c_custkey)", "MATCH (c:Customer) WHERE (c)-[:PLACED]->() RETURN c.key AS key", lambda g: g.with_properties(G.exists(g.scan("c", ["Customer"]), g.expand(g.scan("c"), "c", "o", types=["PLACED"]), ["c"]), "c", ["key"]).select(F.col("`c.key`").alias("key")))
twin("not_exists", "select c_custkey::bigint as key from customer where not exists (select 1 from orders where o_custkey = c_custkey)", "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->() RETURN c.key AS key", lambda g: g.with_properties(G.exists(g.scan("c", ["Customer"]), g.expand(g.scan("c"), "c", "o", types=["PLACED"]), ["c"], True), "c", ["key"]).select(F.col("`c.key`").alias("key")))
twin(
    "shared_slot_join", "select c_custkey::bigint as c, s_suppkey::bigint as s from customer join supplier on c_nationkey = s_nationkey where c_acctbal > 9500",
    "MATCH (c:Customer)-[:IN_NATION]->(n), (s:Supplier)-[:LOCATED]->(n) WHERE c.balance > 9500.0 RETURN c.key AS c, s.key AS s",
    lambda g: G.shared_join(g.expand(g.scan("c", ["Customer"], ["balance", "key"]).where("`c.balance` > 9500"), "c", "n", types=["IN_NATION"]), g.expand(g.scan("s", ["Supplier"], ["key"]), "s", "n", types=["LOCATED"])).select(F.col("`c.key`").alias("c"), F.col("`s.key`").alias("s")),
)
twin("cross", "select a.r_name as a, b.r_name as b from region a, region b where a.r_name < b.r_name", "MATCH (a:Region), (b:Region) WHERE a.name < b.name RETURN a.name AS a, b.name AS b", lambda g: g.with_properties(g.with_properties(G.shared_join(g.scan("a", ["Region"]), g.scan("b", ["Region"])), "a", ["name"]), "b", ["name"]).where("`a.name` < `b.name`").select(F.col("`a.name`").alias("a"), F.col("`b.name`").alias("b")))
twin(
    "uniqueness", "select count(*) as n from customer a join customer b on a.c_nationkey = b.c_nationkey and a.c_custkey <> b.c_custkey where a.c_acctbal > 9000",
    "MATCH (a:Customer)-[:IN_NATION]->(n)<-[:IN_NATION]-(b) WHERE a.balance > 9000.0 RETURN count(*) AS n",
    # b is only counted: r is one of the relationships that lead to n
    lambda g: g.counted(g.expand(g.scan("a", ["Customer"], ["balance"]).where("`a.balance` > 9000"), "a", "n", "r", types=["IN_NATION"]), "n", "bs", "in", ["IN_NATION"], 1).agg(F.coalesce(F.sum("bs"), F.lit(0)).alias("n")),
)
twin("rel_property", "select o_orderstatus as status, sum(w) as quantity from (select l_orderkey, l_partkey, sum(l_quantity) w from lineitem group by 1, 2) join orders on l_orderkey = o_orderkey where w >= 45 group by 1", "MATCH (o:Order)-[r:CONTAINS]->() WHERE r.weight >= 45.0 RETURN o.name AS status, sum(r.weight) AS quantity")
twin("group_aggregates", "select c_mktsegment as segment, count(*) as n, count(distinct c_nationkey) as nations, round(min(c_acctbal), 2) as low, round(max(c_acctbal), 2) as high from customer group by 1", "MATCH (c:Customer)-[:IN_NATION]->(n) RETURN c.segment AS segment, count(*) AS n, count(DISTINCT n) AS nations, min(c.balance) AS low, max(c.balance) AS high")
twin("aggregate_empty", "select 0::bigint as n, 0.0::double as total, cast(null as double) as mean", "MATCH (c:Customer) WHERE c.balance > 99999999.0 RETURN count(*) AS n, sum(c.balance) AS total, avg(c.balance) AS mean")
twin("distinct", "select distinct c_mktsegment as segment from customer", "MATCH (c:Customer) RETURN DISTINCT c.segment AS segment", lambda g: g.with_properties(g.scan("c", ["Customer"]), "c", ["segment"]).select(F.col("`c.segment`").alias("segment")).distinct())
twin("topk", "select c_custkey::bigint as key, c_acctbal as balance from customer order by c_acctbal desc, c_custkey limit 15", "MATCH (c:Customer) RETURN c.key AS key, c.balance AS balance ORDER BY balance DESC, key LIMIT 15", lambda g: g.with_properties(g.scan("c", ["Customer"]), "c", ["key", "balance"]).select(F.col("`c.key`").alias("key"), F.col("`c.balance`").alias("balance")).orderBy(F.desc("balance"), "key").limit(15))
twin("skip_limit", "select c_custkey::bigint as key from customer order by c_acctbal, c_custkey limit 10 offset 20", "MATCH (c:Customer) RETURN c.key AS key ORDER BY c.balance, c.key SKIP 20 LIMIT $n", params={"n": 10})
twin("with_having", "select n_name as nation, n from (select c_nationkey, count(*) n from customer group by 1 having count(*) > 60) join nation on c_nationkey = n_nationkey", "MATCH (c:Customer)-[:IN_NATION]->(n) WITH n, count(*) AS n2 WHERE n2 > 60 RETURN n.name AS nation, n2 AS n")
twin("with_chain", "select r_name as region, n from (select c_nationkey, count(*) n from customer group by 1) join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where n > 55", "MATCH (c:Customer)-[:IN_NATION]->(x) WITH x, count(*) AS n MATCH (x)-[:IN_REGION]->(r) WHERE n > 55 RETURN r.name AS region, n")
twin("case", "select c_custkey::bigint as key, case when c_acctbal < 0 then 'debt' when c_acctbal >= 5000 then 'rich' else 'fair' end as class from customer", "MATCH (c:Customer) RETURN c.key AS key, CASE WHEN c.balance < 0.0 THEN 'debt' WHEN c.balance >= 5000.0 THEN 'rich' ELSE 'fair' END AS class")
twin("strings", "select c_custkey::bigint as key from customer where starts_with(c_mktsegment, 'B') or suffix(c_mktsegment, 'Y') or contains(c_mktsegment, 'HOLD')", "MATCH (c:Customer) WHERE c.segment STARTS WITH 'B' OR c.segment ENDS WITH 'Y' OR c.segment CONTAINS 'HOLD' RETURN c.key AS key")
twin("params_in", "select c_custkey::bigint as key from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_acctbal >= 100", "MATCH (c:Customer) WHERE c.segment IN $s AND c.balance >= $low RETURN c.key AS key", params={"s": ["BUILDING", "MACHINERY"], "low": 100.0})
twin(
    "scalar_pack",
    "select 3::bigint as quotient, 1::bigint as rest, 3.5::double as ratio, 3::bigint as last_item, cast(null as bigint) as beyond, 2::bigint as length, true as either, cast(null as boolean) as unknown, 190::bigint as parsed, -2.0::double as rounded, 3.0::double as up, 'yes' as picked, [4, 6]::bigint[] as evens, 3::bigint as filled",
    """RETURN 7 / 2 AS quotient, 7 % 2 AS rest, 7.0 / 2 AS ratio, [1, 2, 3][-1] AS last_item, [1][5] AS beyond, size('é!') AS length, true XOR false AS either, null AND true AS unknown,
       toInteger('1.9e2') AS parsed, round(-2.5) AS rounded, round(2.5) AS up, CASE 2 WHEN 1 THEN 'no' WHEN 2 THEN 'yes' END AS picked, [x IN [1, 2, 3] WHERE x > 1 | x * 2] AS evens, coalesce(null, 3) AS filled""",
)


def searches(spark, d) -> dict:
    """Procedures for CALL: each takes the call's values and the eligible ids. Only nodes of the graph are ranked."""
    nodes = T.read(spark, d, "documents").select("doc_id")
    vectors = T.vectors(spark, d).join(nodes, "doc_id", "left_semi")
    keep = lambda df, ids: df if ids is None else df.join(ids, "doc_id", "left_semi")

    def vector(values, ids):
        return V.top_k(keep(vectors, ids), V.literal(values[0]), values[1], digits=6).select("doc_id", "score")

    def text(values, ids):
        return L.top_k(L.scores(text_index(spark, d), L.weights(values[0].split()), ids), values[1], 6)

    def hybrid(values, ids):
        v = V.scored(keep(vectors, ids), V.literal(values[1])).select("doc_id", "score")
        x = L.scores(text_index(spark, d), L.weights(values[0].split()), ids)
        return H.top_k(H.fuse_store(v, x, V.ceiling(vectors, values[1]), 0.7), values[2], 6).select("doc_id", "score")

    return {"vector_search": vector, "text_search": text, "hybrid_search": hybrid}


def _documents(spark, d) -> G.Graph:
    """Documents and their sources as nodes, and FROM relationships with the length as weight."""
    docs = T.read(spark, d, "documents")
    source = F.xxhash64("source").bitwiseOR(F.lit(-(2**63)))  # below all ids of documents
    nodes = docs.select(F.col("doc_id").alias("id"), F.array(F.lit("Document")).alias("labels"), "lang", "text", F.lit(None).cast("string").alias("name"))
    made = docs.where("source is not null").select(source.alias("id"), F.array(F.lit("Source")).alias("labels"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("text"), F.col("source").alias("name")).distinct()
    rels = docs.where("source is not null").select(F.col("doc_id").alias("rel_id"), F.col("doc_id").alias("src"), source.alias("dst"), F.lit("FROM").alias("type"), F.col("n_chars").cast("double").alias("weight"))
    return G.Graph(nodes.unionByName(made), rels)


def _search(name: str, oracle: str, text: str, params: dict):
    query(oracle, f"cypher_{name}")(lambda spark, d: cypher.run(_documents(spark, d), text, params, searches(spark, d)))


_search("vector_search", f"with h as (select vec_id, round(-{D2}, 6) score from embeddings where vec_id in (select doc_id from documents) order by score desc, vec_id limit 12) select vec_id as id, lang, score from h join documents on doc_id = vec_id", "CALL db.vector_search($q, 12) YIELD node, score RETURN node.id AS id, node.lang AS lang, score", {"q": QUERY})
_search("text_search", bm25_sql(VALUES) + ", h as (select doc_id, round(score, 6) score from bm order by round(score, 6) desc, doc_id limit 12) select doc_id as id, lang, score from h join documents using (doc_id)", "CALL db.text_search($t, 12) YIELD node AS n, score RETURN n.id AS id, n.lang AS lang, score", {"t": " ".join(TERMS)})
_search("eligible_search", f"with h as (select vec_id, round(-{D2}, 6) score from embeddings where vec_id in (select doc_id from documents where lang = 'de') order by score desc, vec_id limit 5) select vec_id as id, score from h", "MATCH (n:Document) WHERE n.lang = 'de' WITH collect(DISTINCT n) AS ids CALL db.vector_search($q, 5, ids) YIELD node, score RETURN node.id AS id, score", {"q": QUERY})
_search("search_expand", f"with h as (select vec_id, round(-{D2}, 6) score from embeddings where vec_id in (select doc_id from documents) order by score desc, vec_id limit 12) select vec_id as id, source, n_chars::double as size, score from h join documents on doc_id = vec_id where source is not null", "CALL db.vector_search($q, 12) YIELD node, score MATCH (node)-[r:FROM]->(s:Source) RETURN node.id AS id, s.name AS source, r.weight AS size, score", {"q": QUERY})
_search("search_group", bm25_sql(VALUES) + ", h as (select doc_id, round(score, 6) score from bm order by round(score, 6) desc, doc_id limit 40) select source, count(*) as n from h join documents using (doc_id) where source is not null group by 1", "CALL db.text_search($t, 40) YIELD node AS n, score MATCH (n)-[:FROM]->(s) RETURN s.name AS source, count(n) AS n", {"t": " ".join(TERMS)})
_search(
    "hybrid_search",
    bm25_sql(VALUES) + f""", c as (select pow(max(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))) + {sum(x * x for x in QUERY) ** 0.5!r}, 2) ceil from embeddings where vec_id in (select doc_id from documents)),
    t as (select max(score) top from bm), v as (select vec_id doc_id, {D2} d2 from embeddings where vec_id in (select doc_id from documents)),
    f as (select doc_id, {H.store_alpha(0.7)!r} * coalesce(1 - d2 / ceil, 0) + (1 - {H.store_alpha(0.7)!r}) * coalesce(score, 0) / top s from (select coalesce(v.doc_id, bm.doc_id) doc_id, d2, score from v full join bm on v.doc_id = bm.doc_id), c, t)
    select doc_id as id, round(s, 6) score from f order by round(s, 6) desc, doc_id limit 12""",
    "CALL db.hybrid_search($t, $q, 12) YIELD node, score RETURN node.id AS id, score", {"t": " ".join(TERMS), "q": QUERY},
)


def _after(name: str, oracle: str, text: str, read: str, params: dict | None = None):
    query(oracle, f"cypher_{name}")(lambda spark, d: cypher.run(cypher.apply(T.business_graph(spark, d), text, params), read))


_after("set_property", "select c_custkey::bigint as key, case when c_acctbal < 0 then 'DEBT' else c_mktsegment end as segment from customer", "MATCH (c:Customer) WHERE c.balance < 0.0 SET c.segment = 'DEBT'", "MATCH (c:Customer) RETURN c.key AS key, c.segment AS segment")
_after("remove_property", "select c_custkey::bigint as key, case when c_acctbal < 0 then null else c_mktsegment end as segment from customer", "MATCH (c:Customer) WHERE c.balance < 0.0 REMOVE c.segment", "MATCH (c:Customer) RETURN c.key AS key, c.segment AS segment")
_after("set_rel_property", "select n_name as name, count(*) as n from customer join nation on c_nationkey = n_nationkey where c_acctbal > 5000 group by 1", "MATCH (c:Customer)-[r:IN_NATION]->(n) WHERE c.balance > 5000.0 SET r.weight = 1.5", "MATCH (c)-[r:IN_NATION]->(n) WHERE r.weight = 1.5 RETURN n.name AS name, count(r) AS n")
_after("remove_rel_property", "select count(*) filter (o_totalprice <= 200000) as n, count(*) as rels from orders", "MATCH (c)-[r:PLACED]->(o) WHERE r.weight > 200000.0 REMOVE r.weight", "MATCH ()-[r:PLACED]->() RETURN count(r.weight) AS n, count(r) AS rels")
_after("set_rel_keeps_nodes", "select count(*) as n from customer where c_acctbal > 0", "MATCH (c:Customer)-[r:IN_NATION]->() SET r.balance = -1.0", "MATCH (c:Customer) WHERE c.balance > 0.0 RETURN count(c) AS n")
_after("set_label", "select c_custkey::bigint as key from customer where c_acctbal > 9000", "MATCH (c:Customer) WHERE c.balance > 9000.0 SET c:Rich", "MATCH (c:Rich) RETURN c.key AS key")
_after("detach_delete", "select count(*) as n from customer join orders on o_custkey = c_custkey where c_nationkey <> 3", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WHERE n.key = 3 DETACH DELETE c", "MATCH (:Customer)-[r:PLACED]->() RETURN count(r) AS n")
_after("create", "select n_name as name, count(*) as n from nation join customer on n_nationkey = c_nationkey where c_acctbal > 9900 group by 1", "MATCH (c:Customer)-[:IN_NATION]->(n) WHERE c.balance > 9900.0 CREATE (n)-[:HOSTS]->(:Note {name: 'rich'})", "MATCH (n:Nation)-[:HOSTS]->(x:Note {name: 'rich'}) RETURN n.name AS name, count(x) AS n")


@query("select case when o_orderkey % 4 = 0 then 'created' when o_orderkey % 4 = 1 then 'replayed' when o_orderkey % 4 = 2 then 'updated' else 'refused' end as outcome, count(*) as n from orders group by 1")
def graph_apply_outcomes(spark, d):
    o = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    text = F.col("k").cast("string")
    keys = o.where("k % 4 <> 0").select(F.lit("node").alias("kind"), F.lit("ns").alias("namespace"), text.alias("key"), F.col("k").alias("entity_id"), F.lit(3).alias("revision"), F.lit(False).alias("deleted"))
    op = F.when(F.col("k") % 4 < 2, "create").otherwise("put")
    batch = o.select(F.lit("node").alias("kind"), F.lit("ns").alias("namespace"), text.alias("key"), op.alias("op"), F.col("k").alias("entity_id"), F.when(F.col("k") % 4 == 2, 4).otherwise(3).alias("revision"), F.when(F.col("k") % 4 == 3, -1).otherwise(F.col("k")).alias("expected"))
    batch = batch.withColumn("revision", F.when(F.col("entity_id") % 4 == 3, 2).otherwise(F.col("revision")))
    return G.apply_keyed(keys, batch).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("with i as (select unnest([3, 1, 9999999, 3])::bigint k, unnest([0, 1, 2, 3])::bigint pos) select pos, o_totalprice as weight, o_orderkey is not null as found from i left join orders on o_orderkey = k")
def graph_get_relationships(spark, d):
    return T.business_graph(spark, d).get_relationships([T.PLACED + k for k in (3, 1, 9_999_999, 3)]).select("pos", "weight", "found")


@query("select o_custkey::bigint as customer, o_orderkey::bigint as placed from orders where o_orderkey = 7")
def graph_lookup_relationship(spark, d):
    found = T.business_graph(spark, d).lookup_relationship("r", T.PLACED + 7, "c", "o")
    return found.select((F.col("c") - T.CUSTOMER).alias("customer"), (F.col("o") - T.ORDER).alias("placed"))


KEYED = """with k as (select n_nationkey::bigint i from nation), a as (
    select i, 'nation-' || i as key, case when i % 3 = 1 then 2 else 1 end::bigint as revision, case when i % 3 = 1 then 'renamed' else 'first' end as name from k where i % 3 <> 2
    union all select i + 100, 'new-' || i, 1, 'fresh' from k where i % 5 = 0)"""


@query(KEYED + " select key, revision, name from a")
def graph_apply_keyed(spark, d):
    """A batch of keyed changes applied to a keyed graph, then read by key: of the nations a third is renamed and a third deleted; some are new."""
    k = T.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"))
    at = lambda rows, op, key, rev, name, expected="i": rows.select(F.lit("node").alias("kind"), F.lit("ns").alias("namespace"), F.concat(F.lit(key), F.col("i").cast("string")).alias("key"), F.lit(op).alias("op"), F.col("i").alias("entity_id"), F.lit(rev).cast("long").alias("revision"), F.col(expected).cast("long").alias("expected"), F.array(F.lit("Place")).alias("labels"), F.lit(name).alias("name"))
    empty = G.KeyedGraph.empty(spark, "labels array<string>, name string")
    first = empty.apply(at(k, "create", "nation-", 1, "first"))
    fresh = k.where("i % 5 = 0").withColumn("i", F.col("i") + 100)
    changes = at(k.where("i % 3 = 1"), "put", "nation-", 2, "renamed").unionByName(at(k.where("i % 3 = 2"), "delete", "nation-", 2, None))
    changes = changes.unionByName(at(fresh, "create", "x", 1, "fresh").withColumn("key", F.concat(F.lit("new-"), (F.col("entity_id") - 100).cast("string"))))
    return first.apply(changes).live().select("key", "revision", "name")


@query("select c_custkey::bigint as key from customer where c_custkey in (1, 5, 9)")
def graph_lookup_keys(spark, d):
    """LookupKey: a table of (namespace, key) against the keys of the nodes."""
    c = T.read(spark, d, "customer").select(F.lit("node").alias("kind"), F.lit("crm").alias("namespace"), F.col("c_name").alias("key"), F.col("c_custkey").alias("entity_id"), F.lit(1).cast("long").alias("revision"), F.lit(False).alias("deleted"))
    wanted = T.read(spark, d, "customer").where("c_custkey in (1, 5, 9)").select(F.lit("node").alias("kind"), F.lit("crm").alias("namespace"), F.col("c_name").alias("key"))
    return G.KeyedGraph(c).lookup(wanted).select(F.col("entity_id").alias("key"))
