"""Every registered query beside its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from catalogue import TABLES
from tools.check import rows_of

SF = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 11


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    want, wanted_cols = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert cols == wanted_cols
    assert got == want


def test_queries_run_the_whole_operator():
    import inspect
    import re

    from catalogue import clustering, learning
    from plumbline.operators import cluster

    assert not re.search(r"\b(trees|max_iter|restarts)=", inspect.getsource(learning) + inspect.getsource(clustering))
    assert all(inspect.signature(f).parameters["restarts"].default == 10 for f in (cluster.fit_kmeans, cluster.kmeans_sweep, cluster.discover))


def test_without_the_text_operators_the_rest_runs(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry_module.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__", "llm", "corpus_pipeline.py")])
    code = "import __spark_entry__ as e; from plumbline.plans.session import local_session as s; q = e.queries(); print(len(q), len(e.oracle_sql()), not any(n.startswith('op') or n == 'pipeline' for n in q)); print(q['audit_duplicates'](s(2), '" + SF + "').count())"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert done.stdout.split("\n")[0].endswith("True") and done.stdout.split("\n")[1] == "1", done.stderr[-2000:]
