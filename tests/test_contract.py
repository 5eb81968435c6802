"""The driver's contract, with and without the llm folders."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(x):
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    return str(x)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def library():
    from wicker.plans import catalogue

    return catalogue


@pytest.mark.parametrize("name", sorted(library().ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = library().QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = duck.execute(library().ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(library().QUERIES) - set(library().ORACLES)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert library().QUERIES[name](spark, sf).count() > 0


def test_rest_works_without_the_llm_folders(tmp_path):
    for name in ("wicker", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'callers' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
