"""Registered queries against their SQL, and what must hold when optional parts are gone."""

import os
import shutil
import subprocess
import sys

import pytest

DATA = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def engine():
    from bytelode.plans import queries

    return queries


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(engine().QUERIES))
def test_query(spark, duck, name):
    got = engine().QUERIES[name](spark, DATA)
    want = duck.execute(engine().ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def test_every_query_has_sql():
    assert set(engine().QUERIES) == set(engine().ORACLES)


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_the_rest_stands_alone(tmp_path, gone):
    """Without the optional subpackage, and without the pipeline too, the entry module imports and keeps its other queries."""
    own = tmp_path / "repo"
    shutil.copytree(HERE, own, ignore=shutil.ignore_patterns(".git", *gone, "__pycache__", ".*"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') and k[2:3].isdigit()] and 'pipeline' not in q and set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=own, check=True)
