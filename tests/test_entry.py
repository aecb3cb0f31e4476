"""The driver's contract: every query runs, agrees with its SQL, and the library stands without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from jobledger.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)[:10] if hasattr(value, "isoformat") else str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, database, name):
    got = __spark_entry__.queries()[name](spark, SMALL)
    found = database.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, SMALL).count() > 0


def test_library_stands_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "jobledger", tmp_path / "jobledger", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(k.startswith('op') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, timeout=120).returncode == 0
