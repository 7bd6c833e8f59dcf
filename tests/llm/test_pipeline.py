import gc
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from veldspar.llm import common, decontaminate, minhash, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got = queries.queries()[name](spark, DATA)
    want = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["op2_language", "op7_bpe", "op8_toxicity", "op9_quality"])
def test_query_has_a_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert queries.queries()[name](spark, DATA).select("doc_id").exceptAll(docs.select("doc_id")).isEmpty()
    assert queries.queries()[name](spark, DATA).count() == docs.count()


def test_all_are_registered(spark):
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in entry.queries()} and "pipeline" in entry.queries()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    draw = random.Random(3)
    word = lambda: draw.choice("river stone light house green paper walk often".split()) + str(draw.randint(0, 99))
    rows, labels = [], []
    for i in range(160):
        t = [word() for _ in range(60)]
        if i % 4 == 0:
            t[draw.randrange(60)] = "dolt"
            t[draw.randrange(60)] = "dolt"
        rows.append((i, " ".join(t), "en", "s", len(t)))
        labels.append((i, 1, int(i % 4 == 0)))
    clean = [r for r in rows if r[0] % 4]
    rows += [(500, clean[0][1].upper(), "en", "s", 1), (501, clean[1][1] + " more", "en", "s", 1), (502, clean[2][1] + " more", None, None, None), (503, None, "en", "s", 0), (504, "", "en", "s", 0), (505, " ".join([word() for _ in range(30)] + ["q" + str(k) for k in range(12)]), "en", "s", 1), (505, rows[1][1] + " x y", "en", "s", 1), (506, " ".join([word() for _ in range(30)] + ["q" + str(k) for k in range(12)]), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_words", F.lit(7)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join("q" + str(k) for k in range(12)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in now.collect()]
        after = stage(spark, now, corpus)
        assert after.columns == docs.columns
        rows = [(r.doc_id, r.text) for r in after.collect()]
        if name == "toxicity":
            want = [r for r in before if "dolt" not in (r[1] or "")]
        elif name == "exact dedup":
            last = {}
            for i, t in before:
                k = (t or "").lower()
                last[k] = max(last.get(k, -1), i)
            want = [(i, t) for i, t in before if last[(t or "").lower()] == i]
        elif name == "MinHash near-dedup":
            sets = [(i, set(minhash.shingles_of([(t or "").encode()])[0].tolist())) for i, t in before]
            near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
            gone = {i for i, a in sets for j, b in sets if j < i and near(a, b)}
            want = [r for r in before if r[0] not in gone]
        else:
            bench = decontaminate.windows(" ".join("q" + str(k) for k in range(12)).encode(), 10)
            want = [r for r in before if not any(w in b" ".join(decontaminate.words((r[1] or "").encode())) for w in bench)]
        assert sorted(rows, key=repr) == sorted(want, key=repr), name
        assert len(rows) < len(before), name
        now = after
    assert [r.n_words for r in now.select("n_words").distinct().collect()] == [7]


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kept = {r.doc_id for r in out.collect()}
    assert not {i for i in kept if i < 160 and i % 4 == 0} and 500 in kept and not kept & {505, 506}
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_begin_with_the_heap_given_back(spark, monkeypatch):
    jvm, called = spark._jvm, []
    heap = jvm.java.lang.Runtime.getRuntime()
    held = [spark.sparkContext._gateway.new_array(jvm.long, 1 << 20) for _ in range(60)]
    grown = heap.totalMemory()
    del held
    gc.collect()
    common.release(spark)
    assert heap.totalMemory() < grown
    monkeypatch.setattr(common, "release", called.append)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA)
    assert called == [spark] * len(corpus_pipeline.STAGES)
