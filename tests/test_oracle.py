"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from glossa.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_as_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    ours = sorted(str([norm(r[c]) for c in names]) for r in df.collect())
    cur = duck.execute(registry.ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    theirs = sorted(str([norm(r[columns.index(c)]) for c in names]) for r in cur.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_without_the_optional_part(tmp_path):
    """When the training-data folders are gone the entry module imports, the other queries run, and the other tests are found."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder in ("glossa", "tests"):
        shutil.copytree(f"{root}/{folder}", tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = f"""
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert "corpus_stats" in e.queries() and not any(n.startswith("op") for n in e.queries()) and e.oracle_sql()
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() and e.queries()["merge_counts"](spark, {SF!r}).count()
"""
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, check=True, env=env, capture_output=True, text=True).stdout
    assert "test_operators.py" in found and "llm" not in found and "error" not in found
