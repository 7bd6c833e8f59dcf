"""Queries over requests, batches of query vectors, codes, analysis and the rest of the lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import analyzer, bit4, phonetic, snippets
from ..operators import documents as D
from ..operators import graph as G
from ..operators import lexical as L
from ..operators import predicates as P
from ..operators import requests as R
from ..operators import vector as V
from ..sources import tables as T
from .retrieval import BEST, D2, QUERY, TOK, VALUES, bm25_sql, q, text_index

queries: dict = {}
sql: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        queries[f.__name__] = f
        if oracle:
            sql[f.__name__] = oracle
        return f

    return keep


ROUNDED = "round(score, 6) as score"


@query("""with qv as (select vec_id query_id, embedding q from embeddings where vec_id % 50 = 0),
    s as (select query_id, vec_id doc_id, round(-list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))), 6) score from embeddings, qv),
    r as (select *, row_number() over (partition by query_id order by score desc, doc_id) nth from s)
    select query_id, doc_id, score, nth from r where nth <= 5""")
def vec_batch_topk(spark, d):
    rows = T.vectors(spark, d).select("doc_id", "vector")
    asked = rows.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query"))
    return V.batch_top_k(rows, asked, 5, digits=6).select("query_id", "doc_id", "score", F.col("nth").cast("long").alias("nth"))


@query("""with s as (select vec_id, embedding, (list_max(embedding)::double - list_min(embedding)::double) / 254 sc, (list_max(embedding)::double + list_min(embedding)::double) / 2 o from embeddings)
    select vec_id as doc_id, round(sc, 9) as scale, round(o, 9) as offset_, list_sum(list_transform(embedding, lambda x: case when sc = 0 then 0 else greatest(-127, least(127, round((x::double - o) / sc))) end))::bigint as code_sum from s""")
def vec_int8_codes(spark, d):
    codes, scale, offset = V.quantize_int8(F.col("vector"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda t, c: t + c)
    return T.vectors(spark, d).select("doc_id", F.round(scale, 9).alias("scale"), F.round(offset, 9).alias("offset_"), total.alias("code_sum"))


@query("select vec_id % 7 as group_, count(*) as n, bit_xor(vec_id) as folded, sum(bit_count(xor(vec_id, label::bigint)))::bigint as distance from embeddings group by 1")
def vec_hamming(spark, d):
    rows = T.vectors(spark, d).select("doc_id", (F.col("doc_id") % 7).alias("group_"), V.hamming(F.col("doc_id"), F.col("label").cast("long")).alias("h"))
    return rows.groupBy("group_").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("doc_id").alias("folded"), F.sum("h").cast("long").alias("distance"))


@query()
def vec_bit4_codes(spark, d):
    """No SQL: the grid search is held against its definition in the tests."""
    return T.vectors(spark, d).select("doc_id", bit4.encode_udf()("vector").alias("b")).select("doc_id", "b.codes", "b.correction")


@query(f"select vec_id as doc_id, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) between 0.9995 and 1.0005 as unit, list_bool_and(list_transform(embedding, lambda x: isfinite(x))) as finite from embeddings")
def vec_checks(spark, d):
    n = V.norm(F.col("vector"))
    return T.vectors(spark, d).select("doc_id", n.between(0.9995, 1.0005).alias("unit"), V.finite(F.col("vector")).alias("finite"))


def _live(spark, d):
    return T.read(spark, d, "documents").select("doc_id", "text", "lang").join(T.vectors(spark, d).select("doc_id", "vector"), "doc_id", "left")


def _lexical(spark, d, request):
    return L.top_k(R.lexical_scores(text_index(spark, d), request), 10, 6)


@query(bm25_sql("select 'of', 1.0 union all select 'the', 1.0", f"po.doc_id in (with t as (select doc_id, {TOK} w from documents), p as (select doc_id, unnest(range(1, len(w) + 1)) i, w from t) select doc_id from p where w[i] = 'of' and w[i + 1] = 'the')") + f" select doc_id, {ROUNDED} from bm order by round(score, 6) desc, doc_id limit 10")
def search_phrase(spark, d):
    return _lexical(spark, d, R.Phrase(("of", "the")))


@query(bm25_sql("select 'the', 1.0 union all select * from (with v as (select term, count(distinct doc_id) df from (select doc_id, unnest(" + TOK + ") term from documents) group by 1), k as (select term from v where starts_with(term, 'thor') or term = 'tho' order by df desc, term limit 32) select term, floor(1000 / (select count(*) from k)) / 1000.0 from k)") + f" select doc_id, {ROUNDED} from bm order by round(score, 6) desc, doc_id limit 10")
def search_typeahead(spark, d):
    return _lexical(spark, d, R.TermsWithPrefix(("the",), "thor"))


@query()
def search_phonetic(spark, d):
    """No SQL: the codes are tested by known names."""
    return _lexical(spark, d, R.Phonetic("worthless"))


@query(f"select vec_id as doc_id, round(-{D2}, 6) as score from embeddings join documents on doc_id = vec_id where lang = 'en' and vec_id in (select doc_id from labels) order by 2 desc, 1 limit 10")
def search_vector_filtered(spark, d):
    ids = T.read(spark, d, "labels").select("doc_id")
    return R.search(_live(spark, d), 10, QUERY, predicate=P.Eq("lang", "en"), eligible=ids).select("doc_id", F.round("score", 6).alias("score"))


@query(bm25_sql(VALUES, "po.doc_id in (select doc_id from documents where lang = 'de')") + f" select doc_id, {ROUNDED} from bm order by round(score, 6) desc, doc_id limit 10")
def search_text_filtered(spark, d):
    from .retrieval import TERMS

    docs = T.read(spark, d, "documents").select("doc_id", "text", "lang")  # a search by text alone reads no vectors
    return R.search(docs, 10, text=R.Terms(tuple(TERMS)), index=text_index(spark, d), predicate=P.Eq("lang", "de")).select("doc_id", F.round("score", 6).alias("score"))


@query()
def search_snippets(spark, d):
    """The best documents of a text search with their snippets. No SQL for the windows; they are tested by hand."""
    docs = T.read(spark, d, "documents").select("doc_id", "text")
    best = L.top_k(L.scores(text_index(spark, d), L.weights(["worthless", "idiot"])), 20, 6)
    cut = snippets.snippet_udf(["worthless", "idiot"], config=analyzer.CODE)
    return docs.join(F.broadcast(best), "doc_id").select("doc_id", "score", cut("text").alias("s")).select("doc_id", "score", "s.window", "s.marks")  # best: 20 rows


@query(bm25_sql(VALUES) + f", h as ({BEST}) select h.doc_id, h.score, d.lang, length(d.text)::bigint as n_text from h join documents d using (doc_id)")
def search_with_text(spark, d):
    from .retrieval import TERMS

    docs = T.read(spark, d, "documents").select("doc_id", "text", "lang")
    best = L.top_k(L.scores(text_index(spark, d), L.weights(TERMS)), 10, 6)
    return docs.join(F.broadcast(best), "doc_id").select("doc_id", "score", "lang", F.char_length("text").cast("long").alias("n_text"))  # best: 10 rows


@query()
def text_analysis(spark, d):
    """Terms of the full analyzer, counted. No SQL; the analyzer is tested by its golden tokens."""
    return _term_counts(T.read(spark, d, "documents").select("doc_id", "text"))


def _term_counts(docs):
    """(term, n, df). Terms are counted where a document is read; rows that share a doc_id are one document."""
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id")
    again = not repeated.isEmpty()
    alone = docs.join(repeated, "doc_id", "left_anti") if again else docs
    out = alone.select("doc_id", "text").mapInArrow(analyzer.term_counts(), "term string, n long, df long")
    if again:
        rows = docs.join(repeated, "doc_id", "left_semi").select("doc_id", F.explode(analyzer.terms_udf()("text")).alias("term"))
        out = out.unionByName(rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("df")))
    return out.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


@query()
def text_sounds(spark, d):
    """Phonetic codes of the vocabulary. No SQL; tested by known names."""
    words = text_index(spark, d).vocabulary()
    return words.select("term", "df", phonetic.code_udf()("term").alias("code"))


STOP = ", ".join(f"'{w}'" for w in sorted(analyzer.STOPWORDS))


@query(f"select doc_id, len({TOK})::bigint as n_all, len(list_filter({TOK}, lambda w: w not in ({STOP})))::bigint as n_kept from documents")
def text_stopwords(spark, d):
    words = L.ascii_tokens(F.coalesce("text", F.lit("")))
    kept = F.filter(words, lambda w: ~w.isin(*sorted(analyzer.STOPWORDS)))
    return T.read(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("n_all"), F.size(kept).cast("long").alias("n_kept"))


@query("select o_orderkey as doc_id, case when o_orderkey % 2 = 0 then 6 else 5 end::bigint as revision from orders union all select o_orderkey + 1000000000, 1 from orders where o_orderkey % 5 = 0")
def doc_upsert_if(spark, d):
    live = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(5).cast("long").alias("revision"))
    newer = live.where("doc_id % 2 = 0").select("doc_id", F.lit(6).cast("long").alias("revision"), F.lit(5).cast("long").alias("expected"))
    fresh = live.where("doc_id % 5 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.lit(1).cast("long").alias("revision"), F.lit(None).cast("long").alias("expected"))
    return D.conditional_upsert(live, newer.unionByName(fresh), "expected")


@query("with recursive e as (select conv_id * 1000 + turn p, conv_id * 1000 + turn + 1 c from conversations), r as (select conv_id * 1000 id from conversations where turn = 0 and conv_id % 3 = 0), w as (select id from r union select e.c from w join e on e.p = w.id) select id from w")
def cascade_closure(spark, d):
    t = T.read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("parent"))
    roots = T.read(spark, d, "conversations").where("turn = 0 and conv_id % 3 = 0").select((F.col("conv_id") * 1000).alias("id"))
    return D.cascade_closure(t.select("parent", (F.col("parent") + 1).alias("child")), roots)


@query("with i as (select unnest([3, 1, 99, 3])::bigint k, unnest([0, 1, 2, 3])::bigint pos) select pos, n_name as name, n_nationkey is not null as found from i left join nation on n_nationkey = k")
def graph_get_nodes(spark, d):
    nodes = T.nodes(spark, d).where(F.array_contains("labels", "Nation")).select("id", "name")
    return D.get(nodes, [T.NATION + k for k in (3, 1, 99, 3)], "id").select("pos", "name", "found")


@query("select (select count(*) from customer where c_nationkey <> 4) as customers, (select count(*) from orders join customer on c_custkey = o_custkey where c_nationkey <> 4) as placed")
def graph_cascade_delete(spark, d):
    g = T.business_graph(spark, d)
    gone = g.expand(g.lookup("n", T.NATION + 4), "n", "c", direction="in", types=["IN_NATION"]).select(F.col("c").alias("id"))
    after = G.Mutable(g).delete_nodes(gone, detach=True)
    left = after.scan("c", ["Customer"]).agg(F.count(F.lit(1)).alias("customers"))
    return left.join(after.edges("out", ["PLACED"]).agg(F.count(F.lit(1)).alias("placed")))  # two single rows
