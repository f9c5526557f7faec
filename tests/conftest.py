import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


WORK = dict(
    state="Bihar",
    constituency="Araria",
    mp_name="MP One",
    implementing_district_authority="DA 1",
    implementing_agency="Agency 1",
    vendor_id="v1",
    vendor_name="Vendor 1",
    work_category="Road",
    sanctioned_amount_inr=100.0,
    expenditure_amount_inr=50.0,
    sanction_date="2024-05-01",
    recommendation_date="2024-04-01",
    completion_status="In Progress",
    last_updated="2024-06-01",
    work_description=None,
    activity_name=None,
    tenure="2024-2029",
    work_stage=None,
    completion_date=None,
    has_public_document=None,
    source_rung=1,
)


@pytest.fixture(scope="session")
def make_works(spark):
    """Works from dicts over sensible defaults; ids are w0001, w0002, ..."""
    from worksift.sources.contract import WORKS_SCHEMA

    schema = ", ".join(f"{n} {'string' if k == 'date' else k}" for n, k in WORKS_SCHEMA.items())

    def make(*rows):
        full = [{"work_id": f"w{i:04d}", **WORK, **r} for i, r in enumerate(rows, 1)]
        df = spark.createDataFrame([tuple(r[n] for n in WORKS_SCHEMA) for r in full], schema)
        dates = {n: df[n].cast("date") for n, k in WORKS_SCHEMA.items() if k == "date"}
        return df.withColumns(dates)

    return make


@pytest.fixture(scope="session")
def peers_around(make_works):
    """``n`` works of one peer group around a base amount, plus extra rows."""

    def make(n, *extra, **common):
        return make_works(*[{"sanctioned_amount_inr": 100.0 + i % 5, **common} for i in range(n)], *extra)

    return make
