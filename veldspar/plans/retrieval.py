"""Queries over documents and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import fusion as H
from ..operators import lexical as L
from ..operators import predicates as P
from ..operators import vector as V
from ..sources import lexicon
from ..sources import tables as T

QUERY = [((i * 37) % 17 - 8) / 8.0 for i in range(64)]
TERMS = ["the", "of", "ntrea", "idiot"]
Q_SQL = "cast([" + ",".join(map(str, QUERY)) + "] as float[])"
D2 = f"list_sum(list_transform(list_zip(embedding, {Q_SQL}), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))"
DOT = f"list_sum(list_transform(list_zip(embedding, {Q_SQL}), lambda p: p[1]::double * p[2]::double))"
TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"

queries: dict = {}
sql: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        queries[f.__name__] = f
        if oracle:
            sql[f.__name__] = oracle
        return f

    return keep


def q():
    return V.literal(QUERY)


@query(f"select vec_id as doc_id, round(-{D2}, 6) as score from embeddings order by score desc, doc_id limit 10")
def vec_topk_exact(spark, d):
    return V.top_k(T.vectors(spark, d), q(), 10, digits=6).select("doc_id", "score")


@query(f"select vec_id as doc_id, round(-{D2}, 6) as score from embeddings where label = 1 order by score desc, doc_id limit 10")
def vec_topk_filtered(spark, d):
    rows = P.where(T.vectors(spark, d), P.Eq("label", 1))
    return V.top_k(rows, q(), 10, digits=6).select("doc_id", "score")


@query(f"select vec_id as doc_id, round(-{D2}, 6) as score from embeddings where vec_id in (select doc_id from labels where quality = 1) order by score desc, doc_id limit 10")
def vec_topk_eligible(spark, d):
    ids = T.read(spark, d, "labels").where("quality = 1").select("doc_id")
    return V.top_k(P.where(T.vectors(spark, d), eligible=ids), q(), 10, digits=6).select("doc_id", "score")


@query(f"select vec_id as doc_id, round({DOT}, 6) as score from embeddings order by score desc, doc_id limit 10")
def vec_topk_dot(spark, d):
    return V.top_k(T.vectors(spark, d), q(), 10, metric="dot", digits=6).select("doc_id", "score")


@query(f"select label, doc_id, score, nth from (select *, row_number() over (partition by label order by score desc, doc_id) nth from (select label, vec_id doc_id, round(-{D2}, 6) score from embeddings)) where nth <= 3")
def vec_topk_per_label(spark, d):
    return V.top_k_by_group(T.vectors(spark, d), q(), 3, "label", digits=6).select("label", "doc_id", "score", F.col("nth").cast("long").alias("nth"))


@query(f"select doc_id, score from (select vec_id doc_id, round({DOT}, 1) score, rank() over (order by round({DOT}, 1) desc) r from embeddings) where r <= 10")
def vec_topk_ties(spark, d):
    return V.top_k_with_ties(T.vectors(spark, d), q(), 10, metric="dot", digits=1).select("doc_id", "score")


@query(
    f"""with s as (select vec_id, embedding, (list_max(embedding)::double - list_min(embedding)::double) / 254 sc, (list_max(embedding)::double + list_min(embedding)::double) / 2 o from embeddings),
    c as (select vec_id, embedding, list_sum(list_transform(list_zip(embedding, {Q_SQL}), lambda p: pow(case when sc = 0 then o else greatest(-127, least(127, round((p[1]::double - o) / sc))) * sc + o end - p[2]::double, 2))) coarse from s),
    k as (select * from c order by coarse, vec_id limit 40)
    select vec_id doc_id, round(-{D2}, 6) score from k order by score desc, doc_id limit 10"""
)
def vec_quantized_rescore(spark, d):
    return V.rescored_top_k(T.vectors(spark, d), q(), 10, 4, digits=6).select("doc_id", "score")


@query(f"select round(max(n), 6) max_norm, round(pow(max(n) + {sum(x * x for x in QUERY) ** 0.5!r}, 2), 6) ceiling from (select sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) n from embeddings)")
def vec_norm_ceiling(spark, d):
    return V.ceiling(T.vectors(spark, d), QUERY).select(F.round("max_norm", 6).alias("max_norm"), F.round("ceiling", 6).alias("ceiling"))


def _labelled(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(T.read(spark, d, "labels"), "doc_id", "left")


LABELLED = "(select d.doc_id, lang, source, n_chars, quality, toxic from documents d left join labels using (doc_id))"


def _filter(name: str, predicate, condition: str):
    def run(spark, d):
        return P.where(_labelled(spark, d), predicate).select("doc_id", "lang", "quality")

    run.__name__ = name
    query(f"select doc_id, lang, quality from {LABELLED} where {condition}")(run)


_filter("filter_eq", P.Eq("lang", "de"), "lang = 'de'")
_filter("filter_in", P.In("source", ["src1", "src3"]), "source in ('src1', 'src3')")
_filter("filter_in_empty", P.In("source", []), "false")
_filter("filter_range", P.Range("n_chars", P.Bound(500), P.Bound(1500, False)), "n_chars >= 500 and n_chars < 1500")
_filter("filter_exists", P.Exists("quality"), "quality is not null")
_filter("filter_isnull", P.IsNull("quality"), "quality is null")
_filter("filter_and", P.And([P.Eq("quality", 1), P.Eq("toxic", 0)]), "quality = 1 and toxic = 0")
_filter("filter_and_empty", P.And([]), "true")
_filter("filter_or", P.Or([P.Eq("quality", 0), P.Eq("lang", "fr")]), "quality = 0 or lang = 'fr'")
_filter("filter_or_empty", P.Or([]), "false")
_filter("filter_not", P.Not(P.Eq("quality", 1)), "not coalesce(quality = 1, false)")
_filter("filter_not_nested", P.Not(P.Or([P.Eq("toxic", 1), P.Range("n_chars", P.Bound(1000))])), "not (coalesce(toxic = 1, false) or n_chars >= 1000)")
_filter("filter_not_eq", P.not_eq("toxic", 1), "not coalesce(toxic = 1, false)")
_filter("filter_not_in", P.not_in("quality", [0]), "not coalesce(quality in (0), false)")

MICROS = "epoch_us(ts)"


@query(f"select event_id, {MICROS} as ts, user_id from events, (select min(ts) lo from events) where ts >= lo + interval 1 hour and ts < lo + interval 30 hour")
def filter_ts_range(spark, d):
    e = T.events(spark, d)
    low = e.agg(F.min("ts")).first()[0]
    return P.where(e, ts_range=(low + 3_600_000_000, low + 30 * 3_600_000_000)).select("event_id", "ts", "user_id")


@query(f"select user_id, event_id, {MICROS} as ts, value from (select *, row_number() over (partition by user_id order by event_id desc) r from events) where r = 1 and event_type <> 'purchase'")
def doc_live_view(spark, d):
    e = T.events(spark, d).select("user_id", "event_id", "ts", "value", (F.col("event_type") == "purchase").alias("deleted"))
    return D.live_view(e, "user_id", "event_id").select("user_id", "event_id", "ts", "value")


@query("select outcome, count(*) n from (select case when o_orderkey % 3 = 0 then 'stale' when o_orderkey % 3 = 1 then 'replayed' else 'applied' end outcome from orders) group by outcome")
def doc_batch_outcomes(spark, d):
    orders = T.read(spark, d, "orders")
    live = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(5).cast("long").alias("revision"))
    batch = orders.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 3 + 4).cast("long").alias("revision"))
    return D.classify_batch(live, batch).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey doc_id, case when o_orderkey % 2 = 0 then 6 else 5 end::bigint revision, o_orderstatus from orders union all select o_orderkey + 1000000000, 1, 'new' from orders where o_orderkey % 10 = 0")
def doc_upsert(spark, d):
    orders = T.read(spark, d, "orders")
    live = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(5).cast("long").alias("revision"), "o_orderstatus")
    newer = live.where("doc_id % 2 = 0").withColumn("revision", F.lit(6).cast("long"))
    fresh = live.where("doc_id % 10 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.lit(1).cast("long").alias("revision"), F.lit("new").alias("o_orderstatus"))
    return D.upsert(live, newer.unionByName(fresh))


@query("select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def doc_delete(spark, d):
    gone = T.read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return D.delete(T.read(spark, d, "customer"), gone, "c_custkey").select("c_custkey", "c_mktsegment")


@query("select c_custkey, c_acctbal from customer where not (c_mktsegment = 'BUILDING' and c_acctbal < 0)")
def doc_delete_matching(spark, d):
    kept, _ = D.delete_matching(T.read(spark, d, "customer"), P.And([P.Eq("c_mktsegment", "BUILDING"), P.Range("c_acctbal", None, P.Bound(0.0, False))]))
    return kept.select("c_custkey", "c_acctbal")


@query("with i as (select unnest([5, 3, 999999999, 5, 1]) doc_id, unnest([0, 1, 2, 3, 4])::bigint pos) select i.pos, i.doc_id::bigint doc_id, d.lang, d.doc_id is not null as found from i left join documents d on d.doc_id = i.doc_id")
def doc_get_ordered(spark, d):
    return D.get(T.read(spark, d, "documents").select("doc_id", "lang"), [5, 3, 999999999, 5, 1]).select("pos", "doc_id", "lang", "found")


@query(f"with e as (select event_id, {MICROS} ts from events), p as (select ts, event_id from e order by ts, event_id limit 1 offset 99) select e.event_id, e.ts from e, p where e.ts > p.ts or (e.ts = p.ts and e.event_id > p.event_id) order by e.ts, e.event_id limit 100")
def doc_scan_ts_page2(spark, d):
    e = T.events(spark, d).select("event_id", "ts")
    last = D.scan_page(e, 100, key="event_id").collect()[-1]
    return D.scan_page(e, 100, after=(last.ts, last.event_id), key="event_id")


@query(f"select doc_id, quality from {LABELLED} order by quality is null, quality desc, doc_id limit 450")
def doc_scan_attr_nulls_last(spark, d):
    return D.scan_ordered(_labelled(spark, d), "quality", 450, True).select("doc_id", "quality")


@query("select count(*) n from documents where lang = 'en' and n_chars >= 100")
def doc_count(spark, d):
    return D.count(T.read(spark, d, "documents"), P.And([P.Eq("lang", "en"), P.Range("n_chars", P.Bound(100))]))


@query(f"select quality as value, count(*) n from {LABELLED} group by 1")
def doc_count_grouped(spark, d):
    return D.count_grouped(_labelled(spark, d), "quality", 10)


@query(f"with e as (select event_id, {MICROS} ts from events) select event_id, ts from e where ts >= (select max(ts) from e) - 86400000000")
def retention_apply(spark, d):
    e = T.events(spark, d).select("event_id", "ts")
    return D.retain(e, 86_400_000_000, e.agg(F.max("ts")).first()[0])


@query(f"with e as (select event_id, {MICROS} ts from events), m as (select min(ts) lo from e) select event_id, ts from e, m where ts < lo + 3600000000 or ts >= lo + 7200000000")
def drop_partition(spark, d):
    e = T.events(spark, d).select("event_id", "ts")
    low = e.agg(F.min("ts")).first()[0]
    return D.drop_range(e, low + 3_600_000_000, low + 7_200_000_000)


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3))")
def cascade_delete(spark, d):
    customers = T.read(spark, d, "customer").where("c_nationkey = 3").select("c_custkey")
    orders = D.cascade(customers, [(T.read(spark, d, "orders"), "o_custkey", "o_orderkey")])[0]
    return D.delete(T.read(spark, d, "lineitem"), orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").select("l_orderkey", "l_linenumber")


@query(f"with t as (select doc_id, {TOK} w from documents), c as (select doc_id, w, unnest(range(0, greatest(1, cast(ceil((len(w) - 64) / 48.0) as bigint) + 1))) i from t where len(w) > 0) select doc_id, i * 48 as start, len(w[i * 48 + 1 : i * 48 + 64])::bigint n_tokens, w[i * 48 + 1] as first_token from c")
def chunk_tokens(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id", F.explode(D.chunks(L.ascii_tokens(F.coalesce("text", F.lit(""))), 64, 16)).alias("c"))
    return docs.select("doc_id", F.col("c.start").cast("long").alias("start"), F.size("c.tokens").cast("long").alias("n_tokens"), F.element_at("c.tokens", 1).alias("first_token"))


def text_index(spark, d):
    """The stored index of the documents' texts."""
    return lexicon.of_table(spark, f"{d}/documents.parquet", T.read(spark, d, "documents").select("doc_id", "text"))


_index = text_index


@query(f"select count(*) n, sum(len({TOK}))::bigint tokens, round(sum(len({TOK})) / count(*), 6) avgdl from documents")
def lex_stats(spark, d):
    return _index(spark, d).stats.select("n", "tokens", F.round("avgdl", 6).alias("avgdl"))


@query(f"select term, count(distinct doc_id) df from (select doc_id, unnest({TOK}) term from documents) group by 1")
def lex_df(spark, d):
    return _index(spark, d).vocabulary()


def bm25_sql(terms: str, where: str = "true", k1: float = 1.2, b: float = 0.75) -> str:
    """CTEs that end in `bm(doc_id, score)`; terms: rows (term, weight)."""
    return f"""with qt(term, weight) as ({terms}),
    tk as (select doc_id, {TOK} w from documents),
    ln as (select doc_id, len(w) l from tk), st as (select count(*) n, sum(l) / count(*) avgdl from ln),
    po as (select term, doc_id, count(*) tf from (select doc_id, unnest(w) term from tk) where term in (select term from qt) group by 1, 2),
    df as (select term, count(*) df from po group by 1),
    bm as (select po.doc_id, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * l / avgdl))) score
           from po join df using (term) join qt using (term) join ln using (doc_id), st where {where} group by 1)"""


VALUES = "select term, sum(w) from (values " + ", ".join(f"('{t}', 1.0)" for t in TERMS) + ") t(term, w) group by 1"
BEST = "select doc_id, round(score, 6) as score from bm order by score desc, doc_id limit 10"


@query(f"{bm25_sql(VALUES)} select doc_id, round(score, 6) as score from bm order by round(score, 6) desc, doc_id limit 10")
def lex_bm25_topk(spark, d):
    return L.top_k(L.scores(_index(spark, d), L.weights(TERMS)), 10, 6)


@query(bm25_sql(VALUES.replace("values ", "values ('idiot', 1.0), ")) + " select doc_id, round(score, 6) as score from bm order by round(score, 6) desc, doc_id limit 10")
def lex_bm25_dup_terms(spark, d):
    return L.top_k(L.scores(_index(spark, d), L.weights([*TERMS, "idiot"])), 10, 6)


@query(bm25_sql(VALUES, "po.doc_id in (select doc_id from documents where lang = 'fr')") + " select doc_id, round(score, 6) as score from bm order by round(score, 6) desc, doc_id limit 10")
def lex_bm25_filtered(spark, d):
    french = T.read(spark, d, "documents").where("lang = 'fr'").select("doc_id")
    return L.top_k(L.scores(_index(spark, d), L.weights(TERMS), french), 10, 6)


@query(
    f"""with qt(term) as (values ('src1'), ('en'), ('the')),
    f as (select doc_id, w, unnest(t) term from (select doc_id, 1.0 w, {TOK} t from documents union all select doc_id, 2.5, regexp_extract_all(lower(source || ' ' || lang), '[a-z0-9]+') from documents)),
    po as (select term, doc_id, sum(w) tf from f where term in (select term from qt) group by 1, 2),
    ln as (select doc_id, sum(w * n) l from (select doc_id, 1.0 w, len({TOK}) n from documents union all select doc_id, 2.5, len(regexp_extract_all(lower(source || ' ' || lang), '[a-z0-9]+')) from documents) group by 1),
    st as (select count(*) n, avg(l) avgdl from ln), df as (select term, count(*) df from po group by 1),
    bm as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avgdl))) score from po join df using (term) join ln using (doc_id), st group by 1)
    select doc_id, round(score, 6) as score from bm order by round(score, 6) desc, doc_id limit 10"""
)
def lex_bm25_fields(spark, d):
    docs = T.read(spark, d, "documents")
    body = _index(spark, d)
    head = lexicon.of_table(spark, f"{d}/documents.parquet", docs.select("doc_id", F.concat_ws(" ", "source", "lang").alias("text")), "head")
    return L.top_k(L.field_scores({"text": (body, 1.0), "head": (head, 2.5)}, L.weights(["src1", "en", "the"])), 10, 6)


PHRASE = ["of", "the"]


@query(f"with t as (select doc_id, {TOK} w from documents), p as (select doc_id, unnest(range(1, len(w) + 1)) i, w from t) select distinct doc_id from p where w[i] = 'of' and w[i + 1] = 'the'")
def lex_phrase_slop0(spark, d):
    return L.phrase_documents(_index(spark, d), PHRASE)


@query(f"with t as (select doc_id, {TOK} w from documents), p as (select doc_id, unnest(range(1, len(w) + 1)) i, unnest(w) term from t) select distinct a.doc_id from p a join p b on a.doc_id = b.doc_id and a.term = 'of' and b.term = 'and' and b.i >= a.i and abs(b.i - a.i - 1) <= 2")
def lex_phrase_slop2(spark, d):
    return L.phrase_documents(_index(spark, d), ["of", "and"], 2)


def _words(condition: str, weight: str = "1.0") -> str:
    return f"select term, {weight} from (select distinct unnest({TOK}) term from documents) where {condition}"


@query(bm25_sql(_words("starts_with(term, 'thor')")) + " select doc_id, round(score, 6) as score from bm order by round(score, 6) desc, doc_id limit 10")
def lex_prefix(spark, d):
    ix = _index(spark, d)
    return L.top_k(L.scores(ix, L.prefix_terms(ix, "thor")), 10, 6)


@query(
    f"""with v as (select term, count(distinct doc_id) df from (select doc_id, unnest({TOK}) term from documents) group by 1),
    k as (select term from v where starts_with(term, 'thor') or term in ('tho') order by df desc, term limit 32),
    g as (select term, floor(1000 / (select count(*) from k)) / 1000.0 w from k union all select 'the', 1.0)
    select term, round(sum(w), 6)::double weight from g group by 1"""
)
def lex_typeahead(spark, d):
    return L.typeahead_terms(_index(spark, d), ["the"], "thor").select("term", F.round("weight", 6).alias("weight"))


@query(bm25_sql(_words("levenshtein(term, 'worthless') <= 2", "case levenshtein(term, 'worthless') when 0 then 1.0 when 1 then 0.5 else 0.25 end")) + " select doc_id, round(score, 6) as score from bm order by round(score, 6) desc, doc_id limit 10")
def lex_fuzzy(spark, d):
    ix = _index(spark, d)
    return L.top_k(L.scores(ix, L.fuzzy_terms(ix, "worthless")), 10, 6)


def _legs(spark, d):
    vector = V.scored(T.vectors(spark, d), q()).select("doc_id", "score")
    lexical = L.scores(_index(spark, d), L.weights(TERMS))
    return vector, lexical


LEGS = bm25_sql(VALUES) + f""", lx as (select doc_id, score from bm), vx as (select vec_id doc_id, -{D2} score from embeddings)"""


@query(LEGS + """, p as (select doc_id, 1.0 / (60 + row_number() over (order by score desc, doc_id)) s from lx union all select doc_id, 1.0 / (60 + row_number() over (order by score desc, doc_id)) from vx)
    select doc_id, round(sum(s), 6)::double score from p group by 1 order by round(sum(s), 6) desc, doc_id limit 20""")
def fuse_rrf(spark, d):
    return H.top_k(H.rrf(*_legs(spark, d)), 20, 6)


@query(LEGS + """, p as (select doc_id, 0.7 * (score - (select min(score) from vx)) / ((select max(score) from vx) - (select min(score) from vx)) s from vx
      union all select doc_id, (1 - 0.7) * (score - (select min(score) from lx)) / ((select max(score) from lx) - (select min(score) from lx)) from lx)
    select doc_id, round(sum(s), 6)::double score from p group by 1 order by round(sum(s), 6) desc, doc_id limit 20""")
def fuse_convex(spark, d):
    return H.top_k(H.fuse(*_legs(spark, d)), 20, 6)


def _store_legs(spark, d):
    vector = V.scored(T.vectors(spark, d), q()).select("doc_id", "score")
    return vector, L.scores(_index(spark, d), L.weights(TERMS)), V.ceiling(T.vectors(spark, d), QUERY)


NORM = sum(x * x for x in QUERY) ** 0.5
A = H.store_alpha(0.7)


@query(bm25_sql(VALUES) + f""", c as (select pow(max(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))) + {NORM!r}, 2) ceil from embeddings),
    t as (select max(score) top from bm), v as (select vec_id doc_id, {D2} d2 from embeddings),
    f as (select doc_id, {A!r} * coalesce(1 - d2 / ceil, 0) + (1 - {A!r}) * coalesce(score, 0) / top s, d2, score from (select coalesce(v.doc_id, bm.doc_id) doc_id, d2, score from v full join bm on v.doc_id = bm.doc_id), c, t)
    select doc_id, round(s, 6) score, round(d2, 6) vector_squared_l2, round(score, 6) lexical_bm25 from f order by round(s, 6) desc, doc_id limit 20""")
def fuse_store_policy(spark, d):
    out = H.top_k(H.fuse_store(*_store_legs(spark, d), 0.7), 20, 6)
    return out.select("doc_id", "score", F.round("vector_squared_l2", 6).alias("vector_squared_l2"), F.round("lexical_bm25", 6).alias("lexical_bm25"))
