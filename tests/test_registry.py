"""Every query against its SQL, side by side on the smallest tables; the rest have to run and give rows."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

from lodestone import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def comparable(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    rows = result.fetchall()
    assert sorted(names) == columns
    assert comparable([[r[c] for c in columns] for r in df.collect()]) == comparable([[r[names.index(c)] for c in columns] for r in rows])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_without_the_optional_operators(tmp_path):
    """The library and the entry file work where the folders of the training-data operators are gone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = (
        "import shutil, sys; "
        f"shutil.copytree({root!r} + '/lodestone', {str(tmp_path)!r} + '/lodestone', ignore=shutil.ignore_patterns('llm', '__pycache__')); "
        f"shutil.copy({root!r} + '/__spark_entry__.py', {str(tmp_path)!r}); sys.path.insert(0, {str(tmp_path)!r}); "
        "import __spark_entry__ as e; q = e.queries(); "
        "assert 'knn_exact_topk' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); "
        "assert 'knn_exact_topk' in e.oracle_sql() and not e.HAS_LLM"
    )
    subprocess.run([sys.executable, "-c", script], check=True, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) == {"qid", "rank", "vec_id", "d2"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
