import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sonaris.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 4, "6g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        at = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{at}')")
    return con


def _plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="session")
def same(duck):
    """Compare a DataFrame with DuckDB's answer, rows and column names, in any order."""

    def check(df, sql):
        columns = sorted(df.columns)
        got = sorted(str(tuple(_plain(r[c]) for c in columns)) for r in df.collect())
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        want = sorted(str(tuple(_plain(r[i]) for i in at)) for r in result.fetchall())
        assert got == want

    return check
