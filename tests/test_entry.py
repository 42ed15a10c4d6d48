"""A sample of the catalogue against DuckDB, and the entry point without the training-data folders."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from tessella.plans import catalogue

DATA, REPO = "/root/testdata/sf0.001", os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _text(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_catalogue(spark, name):
    con = duckdb.connect()
    for t in "customer supplier orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(tuple(map(_text, r)) for r in df.select(*columns).collect())
    cursor = con.execute(catalogue.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert mine == sorted(tuple(_text(r[i]) for i in at) for r in cursor.fetchall())


def test_the_rest_without_training_data_folders(tmp_path):
    """Without both folders the entry offers the engine's queries, and the other tests pass; corpus_pipeline.py may stay."""
    ignore = shutil.ignore_patterns("llm", ".git", "__pycache__", "spark-warehouse")
    shutil.copytree(REPO, tmp_path / "repo", ignore=ignore)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cnf_3x' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)
    tests = ["tests/test_functions.py", "tests/test_estimator.py", "tests/test_engine.py::test_empty_ingest"]
    subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", *tests], cwd=tmp_path / "repo", check=True, timeout=600)


def test_a_missing_dependency_of_an_operator_leaves_the_engine(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    with open(tmp_path / "repo" / "tessella" / "llm" / "bpe.py", "a") as f:
        f.write("\nimport no_such_library\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cnf_3x' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)
