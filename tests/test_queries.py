"""Every query with SQL gives the SQL's rows; the entry point works with and without the training-data operators."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from chronoframe.plans import registry, relations, scalars, speech  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sql, name):
    df, rel = registry.QUERIES[name](spark, SF), sql.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: TYPES[k] for c, k in df.dtypes} == kinds
    assert plain(df.columns, df.collect()) == plain(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_does_not_need_the_training_data_operators(tmp_path):
    """A copy without the llm folders and the pipeline still imports, with its own queries alone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run(["cp", "-r", f"{root}/chronoframe", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/chronoframe/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not [k for k in q if k.startswith('op') or k == 'pipeline'], q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
