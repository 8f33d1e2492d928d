"""What the driver calls, and the library without the llm subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.abspath(entry.__file__))


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "hybrid_topk" in entry.queries()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "fts_score", "vector_score", "rank"] and df.count() > 0


def test_without_the_llm_folders(tmp_path):
    for name in ("__spark_entry__.py", "verdigris"):
        source = os.path.join(HERE, name)
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
