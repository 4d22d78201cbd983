"""The driver's contract, with and without the llm subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_and_sql():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 140
    assert all(callable(q) for q in queries.values())


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert "event_id" in df.columns
    assert df.count() > 0


def test_import_without_llm(tmp_path):
    shutil.copytree(os.path.join(ROOT, "lanewise"), tmp_path / "lanewise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'op4_neardup' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    count, has = said.stdout.split()
    assert int(count) > 130
    assert has == "False"
