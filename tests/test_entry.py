import subprocess
import sys

import pytest
from conftest import ROOT

from veldspar.plans import registry

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 80"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_queries_survive_without_the_libraries_of_llm():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'pipeline' not in q and 'op1_minhash' not in q; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_nothing_else_imports_the_llm_folder():
    import pathlib

    for p in pathlib.Path(ROOT, "veldspar").rglob("*.py"):
        if "llm" not in p.parts:
            assert ".llm" not in p.read_text(), p


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got = registry.queries()[name](spark, DATA)
    rows = got.collect()
    want = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    clean = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    at = [columns.index(c) for c in got.columns]
    assert sorted(map(clean, rows), key=repr) == sorted((clean([r[i] for i in at]) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert registry.flagship(spark, DATA).count() > 0


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
