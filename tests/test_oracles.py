"""Every registered query of the core against DuckDB."""

import pytest

from sonaris.plans import oracles, queries, step_oracles, step_queries

SQL = oracles.oracle_sql() | step_oracles.oracle_sql()
QUERIES = queries.queries() | step_queries.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, same, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        same(df, SQL[name])
    else:
        assert df.count() > 0


def test_entry_works_without_the_training_package(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "sonaris", tmp_path / "sonaris", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cosine_topk' in q and not any(n.startswith('op') for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)} | {k: v for k, v in __import__("os").environ.items() if k.startswith(("JAVA", "PATH"))})
