from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.functions import analyzer, bit4, phonetic, snippets, stemmer
from veldspar.operators import documents as D
from veldspar.operators import fusion as H
from veldspar.operators import lexical as L
from veldspar.operators import predicates as P
from veldspar.operators import requests as R
from veldspar.operators import vector as V
from veldspar.plans import extras
from veldspar.sources import lexicon


def ids(df, column="x"):
    return sorted((r[column] for r in df.collect()), key=lambda v: (v is None, v))


def test_two_valued_not(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert ids(P.where(df, P.Not(P.Eq("x", 1)))) == [2, None]
    assert len(ids(P.where(df, P.And([])))) == 3
    assert ids(P.where(df, P.Or([]))) == [] == ids(P.where(df, P.In("x", [])))


def test_nan_ranges(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert ids(P.where(df, P.Range("x", P.Bound(0.0)))) == [1.0]
    assert ids(P.where(df, P.Range("x", P.Bound(float("nan"))))) == []
    assert ids(P.where(df, P.Eq("x", float("nan")))) == []


@pytest.mark.parametrize("bad", [P.Eq("y", 1), P.Eq("x", "a"), P.Eq("x", 1.0), P.Range("s", P.Bound("a")), P.Not(P.Eq("x", True)), "x = 1"])
def test_predicates_are_validated(spark, bad):
    with pytest.raises(P.PredicateError):
        P.where(spark.createDataFrame([(1, "a")], "x int, s string"), bad)


def test_predicate_cardinalities(spark):
    rows = [(i, None if i % 7 == 0 else i % 10) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, x int")
    for p, f in ((P.Eq("x", 3), lambda v: v == 3), (P.In("x", [1, 2]), lambda v: v in (1, 2)), (P.Range("x", P.Bound(2, False), P.Bound(5)), lambda v: v is not None and 2 < v <= 5), (P.not_eq("x", 3), lambda v: v != 3), (P.not_in("x", [3]), lambda v: v not in (3,))):
        assert P.where(df, p).count() == sum(1 for _, v in rows if f(v))


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    q = rng.normal(size=8).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<float>")
    want = np.argsort(((x.astype(float) - q.astype(float)) ** 2).sum(1), kind="stable")[:5].tolist()
    assert [r.doc_id for r in V.top_k(df, V.literal(q), 5).collect()] == want
    assert [r.doc_id for r in V.rescored_top_k(df, V.literal(q), 5, 8).collect()] == want
    near = V.batch_top_k(df, df.where("doc_id < 3").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query")), 1)
    assert sorted((r.query_id, r.doc_id) for r in near.collect()) == [(0, 0), (1, 1), (2, 2)]
    with pytest.raises(ValueError):
        V.check_query([1.0, float("nan")])
    with pytest.raises(ValueError):
        V.check_query([1.0, 1.0], unit=True)


def test_int8_constant_row(spark):
    codes, scale, offset = V.quantize_int8(F.col("v"))
    r = spark.createDataFrame([([2.0, 2.0],)], "v array<float>").select(codes.alias("c"), scale.alias("s"), offset.alias("o")).first()
    assert (r.c, r.s, r.o) == ([0, 0], 0.0, 2.0)


def test_bit4():
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=64), rng.normal(size=64)
    codes, c = bit4.encode(v)
    assert codes.min() >= 0 and codes.max() <= 15
    assert abs(bit4.estimate(codes, c, v) - v @ v) < 1e-9
    assert abs(bit4.estimate(codes, c, q) - v @ q) < 0.15 * np.linalg.norm(v) * np.linalg.norm(q)
    assert bit4.encode(np.zeros(4))[1] == 0


def test_batch_top_k_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(90, 6)), 1).astype(np.float32)
    x[40:60] = x[:20]  # ties
    x[60:] *= 1e4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<float>")
    queries = df.where("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query"))
    pairs = df.crossJoin(queries).withColumn("score", F.round(-V.squared_l2(F.col("vector"), F.col("query")), 6))
    want = {}
    for r in pairs.collect():
        want.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    want = sorted((q, d, -s, i + 1) for q, v in want.items() for i, (s, d) in enumerate(sorted(v)[:5]))
    near = V.batch_top_k(df, queries, 5, digits=6)
    assert sorted(map(tuple, near.select("query_id", "doc_id", "score", "nth").collect())) == want
    assert "zip_with" not in near._jdf.queryExecution().toString()  # pairs are blocks, not rows


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a a a b c"), (2, "a d e f g"), (3, "h i j k l"), (4, "m n o p q")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in L.scores(L.build(docs), L.query_terms(spark, ["a"])).collect()}
    assert got[1] == pytest.approx(np.log(2) * 6.6 / 4.2, abs=1e-9)
    twice = {r.doc_id: r.score for r in L.scores(L.build(docs), L.query_terms(spark, ["a", "a"])).collect()}
    assert twice[1] == pytest.approx(2 * got[1])


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "quick fox"), (2, "quick x fox"), (3, "fox quick"), (4, None)], "doc_id long, text string")
    ix = L.build(docs)
    assert ids(L.phrase_documents(ix, ["quick", "fox"]), "doc_id") == [1]
    assert ids(L.phrase_documents(ix, ["quick", "fox"], 1), "doc_id") == [1, 2]
    with pytest.raises(ValueError):
        L.prefix_terms(ix, "")


ODD = [(1, "a A b, a"), (2, "\u212aa x\u00e9a \u0130a 7"), (3, None), (4, "  "), (5, "b a"), (None, "a"), (6, "tail")]


@pytest.mark.parametrize("analyze", [L.ascii_tokens, lambda c: F.split(c, " ")])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_stored_index_is_that_of_the_rows(spark, tmp_path, monkeypatch, analyze, kind):
    monkeypatch.setattr(lexicon, "BLOCK_BYTES", 8)
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    rows = lambda df, *c: sorted(map(repr, df.select(*c).collect()))
    want, got = L.build(docs, analyze=analyze), lexicon.write(docs, f"file://{tmp_path}/ix", analyze=analyze)
    c = ["term", "doc_id", "tf", "positions"]
    assert rows(got.postings, *c) == rows(want.postings.where("doc_id is not null"), *c) and rows(got.hits(), *c[:3]) == rows(got.postings, *c[:3])
    assert rows(got.lengths, "doc_id", "len") == rows(want.lengths, "doc_id", "len") and got.stats.first() == want.stats.first()
    assert rows(got.vocabulary(), "term", "df") == rows(want.postings.where("doc_id is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term", "df")


def test_stored_index_counts_a_repeated_document_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    ix = lexicon.write(docs, f"file://{tmp_path}/ix")
    assert {r.term: r.df for r in ix.vocabulary().collect()} == {"a": 2, "b": 1}
    assert sorted((r.term, r.doc_id, r.tf, r.len, r.positions) for r in ix.postings.collect()) == [("a", 1, 2, 1, [0, 0]), ("a", 1, 2, 2, [0, 0]), ("a", 2, 1, 1, [0]), ("b", 1, 1, 1, [1]), ("b", 1, 1, 2, [1])]


def test_stored_index_groups_a_block_where_it_is_read(spark, tmp_path):
    lexicon.write(spark.range(50).selectExpr("id as doc_id", "concat('the w', id % 5) as text").coalesce(1), f"file://{tmp_path}/ix")
    assert spark.read.parquet(f"file://{tmp_path}/ix/postings").count() == 6  # a row a term, not an entry


def test_fusion(spark):
    leg = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, score double")
    a, b = leg((1, 3.0), (2, 2.0), (3, 1.0)), leg((1, 9.0), (4, 3.0))
    rrf = {r.doc_id: r.score for r in H.rrf(a, b).collect()}
    assert rrf[1] == pytest.approx(2 / 61)
    assert [r.doc_id for r in H.top_k(H.fuse(a, b, 1.0), 3).collect()] == [1, 2, 3]
    assert [r.doc_id for r in H.top_k(H.fuse(a, b, 0.0), 2).collect()][0] == 1
    shifted = a.withColumn("score", F.col("score") * 5 + 7)
    assert H.fuse(a, b).sort("doc_id").collect() == H.fuse(shifted, b).sort("doc_id").collect()
    assert {r.doc_id: r.score for r in H.fuse(leg((1, 1.0)), b).collect()} == {r.doc_id: r.score for r in H.rrf(leg((1, 1.0)), b).collect()}
    assert (H.store_alpha(0.5), H.store_alpha(0), H.store_alpha(1)) == (pytest.approx(16 / 16.5), 0, 1)
    with pytest.raises(ValueError):
        H.fuse(a, b, 1.5)


def test_lifecycle(spark):
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", False), (2, 2, "d", True)], "doc_id long, revision long, v string, deleted boolean")
    assert [(r.doc_id, r.v) for r in D.live_view(log).collect()] == [(1, "b")]
    live = spark.createDataFrame([(1, 2, "b")], "doc_id long, revision long, v string")
    with pytest.raises(D.StaleRevision):
        D.upsert(live, spark.createDataFrame([(1, 1, "x"), (5, 1, "y")], live.schema))
    assert sorted((r.doc_id, r.v) for r in D.upsert(live, spark.createDataFrame([(1, 2, "replay"), (5, 1, "y")], live.schema)).collect()) == [(1, "b"), (5, "y")]
    with pytest.raises(D.StaleRevision):
        D.conditional_upsert(live, spark.createDataFrame([(1, 3, "x", 1)], "doc_id long, revision long, v string, expected long"), "expected")
    ts = spark.createDataFrame([(3, 20), (2, 10), (1, 20), (4, 30)], "doc_id long, ts long")
    assert [r.doc_id for r in D.scan_page(ts, 10).collect()] == [2, 1, 3, 4]
    assert [r.doc_id for r in D.scan_page(ts, 10, after=(20, 1)).collect()] == [3, 4]
    with pytest.raises(D.TooManyGroups):
        D.count_grouped(ts, "doc_id", 3)
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "parent long, child long")
    assert ids(D.cascade_closure(edges, spark.createDataFrame([(1,)], "id long")), "id") == [1, 2, 3]


def test_chunks(spark):
    df = spark.createDataFrame([(list("abcdefg"),), ([],), (["a"],)], "t array<string>").select(D.chunks(F.col("t"), 3, 1).alias("c"))
    assert [[(c.start, "".join(c.tokens)) for c in r.c] for r in df.collect()] == [[(0, "abc"), (2, "cde"), (4, "efg")], [], [(0, "a")]]


def terms(text, **options):
    return [(t.term, t.position, t.flags) for t in analyzer.tokens(text, analyzer.Config(**options))]


def test_analyzer():
    assert terms("Don't stop") == [("don", 0, 0), ("don't", 0, 1), ("dont", 0, 3), ("stop", 2, 0)]
    assert terms("getUserID42") == [("get", 0, 0), ("getuserid42", 0, 1), ("user", 1, 0), ("id", 2, 0), ("42", 3, 1)]
    assert terms("use C++ now") == [("use", 0, 0), ("c++", 1, 1), ("now", 2, 0)]
    assert terms("汉字文") == [("汉字", 0, 1), ("字文", 1, 1)]
    assert terms("the cats") == [("cat", 1, 0)]
    assert ("25", 0, 3) in terms("twenty five boxes") and ("200", 0, 3) in terms("two hundred")
    assert ("car", 0, 3) in terms("motor vehicle", vocabulary={("motor", "vehicle"): ("car",)})
    assert terms("") == [] == terms(None)
    assert analyzer.TEXT.epoch() != analyzer.CODE.epoch()


def test_stemmer_and_sounds():
    assert [stemmer.stem(w) for w in ("running", "flies", "hoped", "consistency", "skies", "lazy")] == ["run", "fli", "hope", "consist", "sky", "lazi"]
    assert phonetic.code("Smith") == phonetic.code("Smyth") == "SM0"
    assert (phonetic.code("Knight"), phonetic.code("O'Brien"), phonetic.code("123")) == ("NT", phonetic.code("OBrien"), "")


def test_snippets():
    text = "é nothing here. " * 4 + "the fox met a dog near the fox"
    window, marks = snippets.snippet(text, {"fox", "dog"}, 20)
    raw = window.encode()
    assert [raw[a:b].decode() for a, b in marks] == ["fox", "dog"]
    assert snippets.snippet(None, {"a"}) == ("", [])


def test_columns_of_functions(spark):
    df = spark.createDataFrame([(1, "running dogs"), (2, None)], "doc_id long, text string")
    ix = L.build(df, analyze=analyzer.terms_udf())
    assert ids(ix.postings, "term") == ["dog", "run"]
    assert df.select(analyzer.tokens_udf()("text").alias("t")).first().t[0].term == "run"
    assert df.select(snippets.snippet_udf(["dog"])("text").alias("s")).first().s.window == "dogs"
    assert ids(L.phonetic_terms(L.build(spark.createDataFrame([(1, "smyth jones")], "doc_id long, text string")), "smith"), "term") == ["smyth"]
    assert df.select(bit4.encode_udf()(F.array(F.lit(1.0), F.lit(-1.0)).cast("array<float>")).alias("b")).first().b.codes == [12, 3]


COUNTED = ["one two and three", "The 25 x1 KVCache C++ c# a-b. two", "two hundred five-six 007 Two", "\u6f22\u5b57\u304c \u30ab caf\u00e9 \u212a \u0130x ne\u0301e\u2019s", "and five and", "", None]


@pytest.mark.parametrize("config", [analyzer.TEXT, analyzer.CODE, analyzer.Config(vocabulary={("two",): ("pair",)})])
def test_counted_terms_are_those_of_the_tokens(config):
    count = analyzer.counter(config)
    for text in [*COUNTED, " ".join(filter(None, COUNTED)), "x".join(filter(None, COUNTED))]:
        assert count(text) == Counter(t.term for t in analyzer.tokens(text, config))


def test_term_counts_of_a_table(spark):
    docs = spark.createDataFrame([(1, "a dog dogs"), (1, "dog"), (2, "dog two"), (None, "dog"), (3, None)], "doc_id long, text string")
    for rows in (docs, docs.dropDuplicates(["doc_id"])):
        want = rows.select("doc_id", F.explode(analyzer.terms_udf()("text")).alias("term")).groupBy("term").agg(F.count(F.lit(1)), F.count_distinct("doc_id"))
        assert sorted(extras._term_counts(rows).collect()) == sorted(want.collect())
    # no row of a document and a term is dealt out
    assert "Expand" not in extras._term_counts(docs.where("doc_id > 1"))._jdf.queryExecution().toString()


def test_chunks_make_the_tokens_once(spark):
    df = spark.createDataFrame([("a b c d e f g",)], "t string").select(D.chunks(F.split("t", " "), 3, 1).alias("c"))
    assert [(c.start, c.tokens) for c in df.first().c] == [(0, ["a", "b", "c"]), (2, ["c", "d", "e"]), (4, ["e", "f", "g"])]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_phonetic_terms_filter_a_stored_index(spark, tmp_path):
    ix = lexicon.write(spark.createDataFrame([(1, "smyth jones"), (2, "smith")], "doc_id long, text string"), f"file://{tmp_path}/ix")
    found = R.lexical_scores(ix, R.Phonetic("smith"))
    assert ids(found, "doc_id") == [1, 2] and "smyth" in found._jdf.queryExecution().optimizedPlan().toString()  # named, not joined to all postings


def test_a_search_by_text_reads_no_vectors(spark):
    assert not [f for f in extras.search_text_filtered(spark, "/root/testdata/sf0.001").inputFiles() if "embeddings" in f]


def test_requests(spark):
    docs = spark.createDataFrame([(1, "quick brown fox", [1.0, 0.0], "a"), (2, "quick smith", [0.0, 1.0], "b"), (3, "smyth", [0.9, 0.1], "a"), (4, None, None, None)], "doc_id long, text string, vector array<float>, tag string")
    ix = L.build(docs)
    hits = lambda r, **o: [x.doc_id for x in L.top_k(R.lexical_scores(ix, r, **o), 10).collect()]
    assert hits(R.Terms(("smith",))) == [2] and hits(R.Phrase(("quick", "fox"), 1)) == [1] and hits(R.Phrase(("quick", "fox"))) == []
    assert sorted(hits(R.Prefix("sm"))) == [2, 3] and sorted(hits(R.TermsWithPrefix(("fox",), "smi"))) == [1, 2]
    assert hits(R.Fuzzy("smoth", 1))[0] in (2, 3) and sorted(hits(R.Phonetic("smith"))) == [2, 3]
    assert hits(R.Prefix("sm"), eligible=docs.where("doc_id = 3").select("doc_id")) == [3]
    found = R.search(docs, 2, [1.0, 0.0], predicate=P.Eq("tag", "a"))
    assert [(r.doc_id, r.lexical_bm25) for r in found.collect()] == [(1, None), (3, None)]
    assert [r.doc_id for r in R.search(docs, 5, text=R.Terms(("quick",)), predicate=P.Not(P.Eq("tag", "a"))).collect()] == [2]
    both = R.search(docs, 3, [0.0, 1.0], R.Terms(("smith",))).collect()
    assert both[0].doc_id == 2 and both[0].score == pytest.approx(H.store_alpha(0.7) + 1 - H.store_alpha(0.7)) and both[0].vector_squared_l2 == 0
    for bad in ({}, {"query": [1.0, 0.0], "k": 0}, {"query": [1.0, 0.0], "tier": "x"}, {"text": "fox"}):
        with pytest.raises(ValueError):
            R.search(docs, **bad)


GOLDEN = {
    "She said twenty five boxes arrived with the two hundred more and then 25 again": [
        ("she", 0, 0, 3, 0), ("said", 1, 4, 8, 0), ("twenti", 2, 9, 15, 0), ("25", 2, 9, 20, 3), ("twentyfive", 2, 9, 20, 3), ("five", 3, 16, 20, 0), ("box", 4, 21, 26, 0), ("arriv", 5, 27, 34, 0),
        ("two", 8, 44, 47, 0), ("200", 8, 44, 55, 3), ("twohundred", 8, 44, 55, 3), ("hundr", 9, 48, 55, 0), ("more", 10, 56, 60, 0), ("25", 13, 70, 72, 1), ("twentyfive", 13, 70, 72, 3), ("again", 14, 73, 78, 0),
    ],
    "ticket I-485 blocks GPT-5.6": [
        ("ticket", 0, 0, 6, 0), ("i-485", 1, 7, 12, 1), ("i485", 1, 7, 12, 3), ("485", 2, 9, 12, 1), ("block", 3, 13, 19, 0),
        ("gpt", 4, 20, 23, 0), ("gpt-5.6", 4, 20, 27, 1), ("gpt56", 4, 20, 27, 3), ("5", 5, 24, 25, 1), ("6", 6, 26, 27, 1),
    ],
    "fn put_if_match KVCache": [
        ("fn", 0, 0, 2, 0), ("put", 1, 3, 6, 0), ("put_if_match", 1, 3, 15, 1), ("putifmatch", 1, 3, 15, 3), ("match", 3, 10, 15, 0), ("kv", 4, 16, 18, 0), ("kvcache", 4, 16, 23, 1), ("cach", 5, 18, 23, 0),
    ],
}


@pytest.mark.parametrize("text", GOLDEN)
def test_golden_tokens(text):
    assert [tuple(t) for t in analyzer.tokens(text)] == GOLDEN[text]


def test_numbers_in_words_and_digits():
    assert [analyzer.spelled(n) for n in (0, 19, 25, 205, 1_000_000, 2_000_300)] == ["zero", "nineteen", "twentyfive", "twohundredfive", "onemillion", "twomillionthreehundred"]
    assert analyzer.spoken("two hundred and five".split()) == 205 and analyzer.spoken(["and", "five"]) is None and analyzer.spoken(["thousand"]) is None and analyzer.spoken(["hundred"]) == 100
    both = lambda t: {(x.term, x.position) for x in analyzer.tokens(t)}
    assert both("twenty five") & both("25") == {("25", 0), ("twentyfive", 0)}


def test_profiles_have_their_own_epochs():
    assert len({c.epoch() for c in (analyzer.TEXT, analyzer.CODE, analyzer.VOICE)}) == 3


@pytest.mark.parametrize(
    ("name", "want"),
    list({"Smith": "SM0", "Schmidt": "XMT", "Schneider": "XNTR", "Thompson": "TMPS", "Knight": "NT", "Wright": "RT", "Gnome": "NM", "Psycho": "SX", "Philip": "FLP", "Christopher": "KRST", "Church": "XRX", "Robertson": "RPRT", "Ghost": "KST", "Through": "0R", "Fitzgerald": "FTSJ", "Xavier": "SFR", "Quinn": "KN", "Zimmerman": "SMRM", "chad": "KT", "Aesop": "SP"}.items()),
)
def test_phonetic_codes(name, want):
    assert phonetic.code(name) == want


def test_rrf_of_whole_lists(spark, monkeypatch):
    from veldspar.operators import fusion as H

    monkeypatch.setattr(H, "RANGE_ROWS", 7)
    legs = [[(i, float((i * k) % 11)) for i in range(40)] for k in (3, 5)]
    got = {r.doc_id: r.score for r in H.rrf(*(spark.createDataFrame(x, "doc_id long, score double") for x in legs)).collect()}
    want = {}
    for leg in legs:
        for n, (i, _) in enumerate(sorted(leg, key=lambda r: (-r[1], r[0])), 1):
            want[i] = want.get(i, 0) + 1 / (60 + n)
    assert got == pytest.approx(want)


def test_rules_of_fusion():
    from veldspar.operators import fusion as H

    assert H.effective_alpha(0.5, H.Signals(True)) == (0.5, []) and H.effective_alpha() == (0.7, [])
    assert H.effective_alpha(None, H.Signals(True, 3, True)) == (0.4, ["quoted_phrase", "rare_exact_token", "identifier_token"])
    assert H.effective_alpha(None, H.Signals(False, 6, False)) == (0.7, []) and H.is_identifier("abc-1") and not H.is_identifier("abc")
