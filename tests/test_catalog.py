"""Every registered query against its SQL counterpart on the smallest tables."""

from pathlib import Path

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry_module  # noqa: E402

SMALL = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not SMALL.is_dir(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def comparable(df: pd.DataFrame) -> pd.DataFrame:
    def show(value):
        if value is None or (not isinstance(value, (list, dict)) and pd.isna(value)):
            return "null"
        return repr(float(value) + 0.0) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)

    out = pd.DataFrame({c: [show(v) for v in df[c].tolist()] for c in sorted(df.columns)})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    got = entry_module.queries()[name](spark, str(SMALL)).toPandas()
    want = connection.execute(entry_module.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(comparable(got), comparable(want))


def test_every_sql_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_ranks_every_work(spark):
    out = entry_module.entry(spark)
    assert out.columns == ["work_id", "inspection_rank", "risk_score", "flags", "why_flagged", "peer_group"]
    assert out.count() == spark.read.parquet(str(SMALL / "orders.parquet")).count()
