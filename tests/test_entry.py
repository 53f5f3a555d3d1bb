import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e


def test_registered():
    queries, sql = e.queries(), e.oracle_sql()
    assert len(queries) > 60 and sql.keys() <= queries.keys()


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["query_id", "candidate_id", "distance", "rank"]
    assert df.filter("split(query_id, '::')[0] = split(candidate_id, '::')[0]").isEmpty() and df.count() == 100


def test_without_the_optional_files(tmp_path):
    """With the optional folders gone, and corpus_pipeline.py there or not, the rest is as it was."""
    repo = Path(e.__file__).parent
    for keep in (True, False):
        shutil.copytree(repo, at := tmp_path / str(keep), ignore=lambda d, names: [n for n in names if n in (".git", "llm", "__pycache__") or n == "corpus_pipeline.py" and not keep])
        code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 60 and 'pipeline' not in q and not any(k.startswith('op1') for k in (*q, *s))"
        subprocess.run([sys.executable, "-c", code], cwd=at, check=True, env={**os.environ, "PYTHONPATH": str(at)})
