import datetime
import decimal
import json

import pytest
from pyspark.sql import functions as F

from worksift.functions.text import clean_text
from worksift.plans import driver_tables
from worksift.sources import contract, snapshot, tiles


def documents(spark, *payloads):
    return spark.createDataFrame([(p if isinstance(p, str) else json.dumps(p),) for p in payloads], "document string")


def sanctioned(spark, *rows):
    return tiles.parse_sanctioned(tiles.tile_unwrap(documents(spark, list(rows))))


def test_unwrap_takes_both_shapes_and_drops_the_summary(spark):
    rows = [{"WORK_RECOMMENDATION_DTL_ID": 1}, {"Total_Amt": 5}]
    both = documents(spark, {"Works Sanctioned": json.dumps(rows)}, {"Works Sanctioned": rows}, rows)
    assert [r.row["WORK_RECOMMENDATION_DTL_ID"] for r in tiles.tile_unwrap(both).collect()] == ["1"] * 3


def test_unwrap_refuses_two_keys(spark):
    with pytest.raises(Exception, match="single-key"):
        tiles.tile_unwrap(documents(spark, {"a": [], "b": []})).collect()


def test_tile_files_are_read_whole(spark, tmp_path):
    (tmp_path / "tile.json").write_text(json.dumps({"T": json.dumps([{"WORK_RECOMMENDATION_DTL_ID": 9}])}, indent=1))
    assert tiles.tile_unwrap(tiles.read_tile_documents(spark, str(tmp_path))).count() == 1


def test_public_document_is_three_valued(spark):
    key = "WORK_RECOMMENDATION_DTL_ID"
    out = sanctioned(spark, {key: 1}, {key: 2, "FILE_STATUS": None}, {key: 3, "FILE_STATUS": "Y"}, {key: 4, "FILE_STATUS": ""})
    assert {r.work_id: r.has_public_document for r in out.collect()} == {"1": None, "2": False, "3": True, "4": False}


def test_rollup_picks_name_then_id_within_name(spark):
    pay = spark.createDataFrame(
        [
            ("1", "B", "b1", "X", "2024-01-01", True, 10.0),
            ("1", "B", "b2", "X", "2024-01-02", True, 5.0),
            ("1", "A", "a1", "Y", "2024-03-02", False, 99.0),
            ("1", "A", "a1", None, "2024-02-02", True, 1.0),
            ("2", None, "zz", None, None, False, 7.0),
            (None, "C", "c", "Z", "2024-01-01", True, 1.0),
        ],
        "work_id string, vendor_name string, vendor_id string, implementing_agency string, paid_on string, settled boolean, amount_inr double",
    ).withColumn("paid_on", F.col("paid_on").cast("date"))
    out = {r.work_id: r for r in tiles.payment_rollup(pay).collect()}
    one, two = out["1"], out["2"]
    # A and B tie on two events: A sorts first. X has two events.
    assert (one.vendor_name, one.vendor_id, one.implementing_agency) == ("A", "a1", "X")
    assert (one.expenditure_amount_inr, str(one.last_activity)) == (16.0, "2024-03-02")
    assert (two.vendor_name, two.vendor_id, two.expenditure_amount_inr, two.last_activity) == (None, None, 0.0, None)
    assert set(out) == {"1", "2"}


def test_works_join_statuses_and_last_update(spark):
    key = "WORK_RECOMMENDATION_DTL_ID"
    base = {"SANCTION_DATE": "01-Jan-2024", "STATE_NAME": "S"}
    spine = sanctioned(
        spark,
        {key: 1, "WORK_STAGE": "Sanction", **base},
        {key: 2, "WORK_STAGE": "Time Estimation", **base},
        {key: 3, "WORK_STAGE": "Something new"},
        {"WORK_STAGE": "Sanction"},
    )
    done = tiles.parse_completed(tiles.tile_unwrap(documents(spark, [{key: 1, "ACTUAL_END_DATE": "05-Feb-2024"}, {key: 1, "ACTUAL_END_DATE": "NA"}])))
    pay = tiles.parse_payments(tiles.tile_unwrap(documents(spark, [{key: 2, "EXPENDITURE_DATE": "07-Mar-2024", "WORK_STATUS": "Payment Success", "FUND_DISBURSED_AMT": "-5"}])))
    out = {r.work_id: r for r in tiles.works_join(spine, done, pay, F.lit("2025-01-01").cast("date")).collect()}
    assert {k: r.completion_status for k, r in out.items()} == {"1": "Completed", "2": "Sanctioned", "3": "In Progress"}
    assert {k: str(r.last_updated) for k, r in out.items()} == {"1": "2024-01-01", "2": "2024-03-07", "3": "2025-01-01"}
    assert out["1"].completion_date is None  # the last row wins, and it holds no date
    assert out["2"].expenditure_amount_inr == 0.0


def test_unreadable_dates_are_refused_above_one_percent(spark):
    key = "WORK_RECOMMENDATION_DTL_ID"
    good = [{key: i, "SANCTION_DATE": "01-Jan-2024", "RECOMMENDATION_DATE": "NA"} for i in range(99)]
    none = tiles.parse_completed(tiles.tile_unwrap(documents(spark, [])))
    pay = tiles.parse_payments(tiles.tile_unwrap(documents(spark, [])))
    ok = sanctioned(spark, *good, {key: 99, "SANCTION_DATE": "2024-01-01"})
    row = tiles.source_quality_counts(ok, none, pay).first()
    assert (row.sanction_date_unparseable, row.recommendation_date_supplied) == (1, 0)
    bad = sanctioned(spark, *good[:98], {key: 99, "SANCTION_DATE": "2024-01-01"})
    with pytest.raises(Exception, match="1 of 99"):
        tiles.source_quality_counts(bad, none, pay).collect()


def test_contract_reports_every_broken_rule(make_works):
    good = make_works({})
    assert contract.contract_validate(good).count() == 0
    bad = make_works({"work_category": "Bridge", "tenure": "18th", "sanctioned_amount_inr": -1.0, "mp_name": ""}, {"vendor_id": ""})
    rules = {(r.work_id, r.rule) for r in contract.contract_validate(bad).collect()}
    assert rules == {
        ("w0001", "work_category_enum"),
        ("w0001", "tenure_pattern"),
        ("w0001", "sanctioned_amount_inr_minimum"),
        ("w0001", "mp_name_required"),
        ("w0002", "vendor_id_empty"),
    }
    with pytest.raises(ValueError, match="work_category_enum"):
        contract.require_valid(bad)


def test_normalize_project(make_works):
    raw = make_works({}).drop("last_updated", "work_stage").withColumn("sanctioned_amount_inr", F.lit("x"))
    row = contract.normalize_project(raw, 2, F.lit("2024-01-02").cast("date")).first()
    assert (row.source_rung, row.sanctioned_amount_inr, str(row.last_updated), row.work_stage) == (2, None, "2024-01-02", None)
    with pytest.raises(ValueError):
        contract.normalize_project(raw, 6)


def test_snapshots(spark, make_works, tmp_path):
    folder = str(tmp_path)
    snapshot.snapshot_write({"works": make_works({}, {})}, folder, "20240101T000000Z")
    snapshot.snapshot_write({"works": make_works({"state": "New"})}, folder, "20250101T000000Z")
    snapshot.snapshot_write({"works": make_works({}, {}, {})}, folder, "zz-not-a-snapshot")
    latest = snapshot.latest_snapshot_select(snapshot.read_snapshots(spark, folder))
    assert [r.state for r in latest.collect()] == ["New"]
    with pytest.raises(ValueError, match="missing"):
        snapshot.latest_snapshot_select(snapshot.read_snapshots(spark, folder).drop("tenure"))
    snapshot.snapshot_write({"works": make_works({}, {"source_rung": 2})}, folder, "20260101T000000Z")
    with pytest.raises(ValueError, match="source_rung"):
        snapshot.latest_snapshot_select(snapshot.read_snapshots(spark, folder))


def test_a_half_written_snapshot_is_never_read(spark, make_works, tmp_path, monkeypatch):
    folder, name = str(tmp_path), "20240101T000000Z"
    with pytest.raises(ValueError, match="no complete snapshot"):
        snapshot.snapshot_open(spark, folder)
    works = make_works({}, {})
    snapshot.snapshot_write({"works": works, "ids": works.select("work_id")}, folder, name, generated_at="1", source="a", source_rung=2)

    def broken(*args):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(type(spark), "createDataFrame", broken)
        with pytest.raises(OSError):  # all tables are there, the manifest is not
            snapshot.snapshot_write({"works": works.limit(1)}, folder, "20250101T000000Z", generated_at="2")
    manifest, tables = snapshot.snapshot_open(spark, folder)
    assert manifest.first().snapshot == name and tables["works"].count() == 2
    assert {(r.table, r.rows, r.complete) for r in snapshot.snapshot_counts(manifest, tables).collect()} == {("works", 2, True), ("ids", 2, True)}
    assert snapshot.read_snapshots(spark, folder).count() == 2

    # Written again: the new attempt replaces the old one; a worse source is refused unless forced.
    again = {"works": works.limit(1), "ids": works.select("work_id")}
    with pytest.raises(snapshot.SnapshotDowngrade):
        snapshot.snapshot_write(again, folder, name, generated_at="3", source_rung=5)
    snapshot.snapshot_write(again, folder, name, generated_at="3", source_rung=5, force=True)
    manifest, tables = snapshot.snapshot_open(spark, folder)
    assert tables["works"].count() == 1 and tables["works"].schema == works.schema
    assert manifest.first().row_count == 1 and manifest.first().contract_sha256 == contract.contract_sha256()
    assert [r.snapshot for r in snapshot.read_snapshots(spark, folder).collect()] == [name]


def test_receipts_tell_what_changed(make_works):
    rows = make_works(*[{"state": f"S{i}"} for i in range(20)])
    receipt = lambda **inputs: snapshot.input_receipts([(n, df, True, None) for n, df in inputs.items()])
    last = receipt(same=rows, fewer=rows, other=rows, wider=rows, gone=rows)
    now = receipt(same=rows.repartition(3, "state"), fewer=rows.limit(5), other=rows.withColumn("state", F.lower("state")), wider=rows.withColumn("x", F.lit(1)), fresh=rows)
    out = {r.input: (r.change, r.differs) for r in snapshot.receipt_changes(now, last).collect()}
    assert out == {
        "same": ("same", []), "fewer": ("changed", ["rows", "content"]), "other": ("changed", ["content"]),
        "wider": ("changed", ["layout", "content"]), "gone": ("gone", []), "fresh": ("new", []),
    }
    old = last.withColumn("contract_sha256", F.lit("x")).withColumn("config_sha256", F.lit("y"))
    assert {tuple(r.differs) for r in snapshot.receipt_changes(last, old).collect()} == {("contract", "config")}


def test_receipts_do_not_depend_on_order(make_works):
    rows = make_works(*[{"state": f"S{i}"} for i in range(20)])
    a, b = (snapshot.input_receipts([("works", df, True, None)]).first() for df in (rows, rows.repartition(3, "state")))
    assert a == b and a["rows"] == 20 and not a.is_demo
    changed = snapshot.input_receipts([("works", rows.withColumn("state", F.lit("x")), True, None)]).first()
    assert changed.checksum != a.checksum


def test_last_completion_follows_file_names_not_sizes(spark, tmp_path):
    row = lambda date: {"WORK_RECOMMENDATION_DTL_ID": "1", "ACTUAL_END_DATE": date}
    (tmp_path / "b_last.json").write_text(json.dumps([row("01-Jan-2020")]))
    (tmp_path / "a_first.json").write_text(json.dumps([row("02-Feb-2024")] + [row("03-Mar-2023")] * 200))
    rows = tiles.tile_unwrap(tiles.read_tile_documents(spark, str(tmp_path)))
    found = tiles.completed_lookup(tiles.parse_completed(rows)).collect()
    assert [(r.work_id, str(r.completion_date)) for r in found] == [("1", "2020-01-01")]


def test_tiles_are_read_once_and_only_those_asked_for(spark, monkeypatch):
    from worksift.queries import catalog

    labels = []
    store = catalog.written
    monkeypatch.setattr(catalog, "written", lambda df, label: labels.append(label) or store(df, label))
    monkeypatch.setattr(catalog, "_STORED", {})
    assert catalog.tile_parse(spark, "/root/testdata/sf0.001").count() > 0
    assert labels == ["tile_sanctioned"]
    documents = spark.createDataFrame([('{"Works": "[{\\"a\\": \\"1\\"}]"}',)], "document string")
    unwrapped = tiles.tile_unwrap(documents)
    assert [r.row for r in unwrapped.collect()] == [{"a": "1"}]
    plan = unwrapped._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2


def test_payments_travel_as_one_row_each(spark):
    """a payment becomes three only after the last shuffle."""
    rows = [("1", f"V{i % 3}", f"v{i % 5}", f"A{i % 2}", "2024-01-01", i % 4 > 0, 1.25) for i in range(400)]
    rows += [("1", None, None, None, None, None, None)]
    pay = spark.createDataFrame(rows, "work_id string, vendor_name string, vendor_id string, implementing_agency string, paid_on string, settled boolean, amount_inr double")
    rolled = tiles.payment_rollup(pay.withColumn("paid_on", F.col("paid_on").cast("date")))
    steps = rolled._jdf.queryExecution().executedPlan().toString().splitlines()
    explode = min(i for i, line in enumerate(steps) if "Generate" in line)
    assert not [line for line in steps[explode + 1 :] if "Generate" in line]
    assert len([line for line in steps[explode:] if "Exchange" in line]) == len([line for line in steps if "Exchange" in line]) == 2
    (one,) = rolled.collect()
    # V0 has 134 events; its ids have 27 each but v4, which has 26. A0 and A1 have 200.
    assert (one.vendor_name, one.vendor_id, one.implementing_agency, one.expenditure_amount_inr) == ("V0", "v0", "A0", 375.0)


def given_tables(spark, folder, orders, lines):
    """The tables behind the works, as files: two customers, nations and regions, three suppliers."""
    for name, rows, schema in (
        ("customer", [(1, 0), (2, 1)], "c_custkey bigint, c_nationkey int"),
        ("nation", [(0, "N0", 0), (1, "N1", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        ("region", [(0, "R0"), (1, "R1")], "r_regionkey int, r_name string"),
        ("supplier", [(5, "S5"), (6, "S6"), (7, "S7")], "s_suppkey bigint, s_name string"),
        ("orders", orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"),
        ("lineitem", lines, "l_orderkey bigint, l_suppkey bigint, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_lines_of_the_works_travel_once(spark, tmp_path):
    """Lines are dealt out by order once and summed there."""
    day = lambda d: datetime.datetime(2000, 1, d)
    orders = [(1, 1, "F", day(1), "1-URGENT"), (2, 2, "O", day(2), "2-HIGH"), (3, 9, "O", day(3), "2-HIGH"), (1, 1, "F", day(1), "1-URGENT"), (None, 1, "P", day(4), None)]
    lines = [(1, 6, 100.0, 0.1, "R", day(5)), (1, 5, 10.0, 0.0, "N", day(7)), (1, 5, 10.0, 0.0, None, day(6)), (1, 6, 1.0, 0.5, "A", day(5)), (1, None, 2.0, None, "A", None)]
    lines += [(None, 7, 1.0, 0.0, "N", day(9))]
    works = driver_tables.works(spark, given_tables(spark, tmp_path, orders, lines))
    plan = works._jdf.queryExecution().executedPlan().toString()
    assert "l_suppkey" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "l_orderkey" in line)
    assert len([line for line in plan.splitlines() if "Exchange hashpartitioning(l_orderkey" in line]) == 1
    out = sorted(works.collect(), key=str)
    assert [r.work_id for r in out] == ["1", "1", "2", None]
    one, _, two, none = out
    # Suppliers 5 and 6 have two lines each: the smaller number is the vendor.
    assert (one.vendor_id, one.vendor_name, one.sanctioned_amount_inr, str(one.last_updated)) == ("5", "S5", 110.5, "2000-01-07")
    assert (one.expenditure_amount_inr, one.state, one.constituency) == (0.6 * 10.5, "R0", "N0")
    assert (two.vendor_id, two.implementing_agency, two.sanctioned_amount_inr, str(two.last_updated)) == (None, None, None, "2000-01-02")
    assert (none.vendor_id, none.state) == (None, "R0")


def test_lines_are_summed_as_whole_numbers(spark, tmp_path):
    """amounts of lines are added up as integers, exactly, whatever their size and sign."""
    day = datetime.datetime(2000, 1, 5)
    orders = [(n, 1, "F", day, "1-URGENT") for n in (1, 2, 3, 4)]
    lines = [(1, 5, 9_999_999_999.99, 0.01, "N", day)] * 40 + [(1, 6, 0.01, 0.07, "R", day)] * 3
    lines += [(2, 5, 3.33, 0.1, "N", day), (2, 6, -7.77, 0.05, "A", day), (3, 5, None, 0.1, "N", day), (4, 5, 8.0, 1.5, None, day)]
    works = driver_tables.works(spark, given_tables(spark, tmp_path, orders, lines))
    plan = works._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(_high" not in plan and "sum(paid#" not in plan and "gross_high" in plan
    out = {r.work_id: (r.sanctioned_amount_inr, r.expenditure_amount_inr) for r in works.collect()}
    large = decimal.Decimal("9999999999.99") * decimal.Decimal("0.99") * 40
    assert out["1"] == (float(large + 3 * decimal.Decimal("0.0093")), float(large * decimal.Decimal("0.6")))
    assert out["2"] == (float(decimal.Decimal("2.997") - decimal.Decimal("7.3815")), float(decimal.Decimal("-4.3845") * decimal.Decimal("0.6")))
    assert out["3"] == (None, None) and out["4"] == (-4.0, 0.0)


def test_long_tile_documents_are_stored_in_small_groups(spark, monkeypatch):
    """a hundred documents at least stood in one page and one group, whatever their size."""
    from urllib.parse import urlparse

    import pyarrow.parquet as pq

    from worksift.plans import driver_tables
    from worksift.queries import catalog

    text = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(4_000)), lambda x: F.sha2(F.concat(x.cast("string"), F.col("id").cast("string")), 256)))
    documents = spark.range(160, numPartitions=1).select(text.alias("document"))  # 40 MB
    monkeypatch.setattr(driver_tables, "tile_documents", lambda spark, sf_dir: {"sanctioned": documents})
    monkeypatch.setattr(catalog, "_STORED", {})
    stored = catalog.tile(spark, "/root/testdata/sf0.001", "sanctioned")
    (file,) = [urlparse(f).path for f in stored.inputFiles()]
    groups = pq.ParquetFile(file).metadata
    assert stored.distinct().count() == 160
    assert max(groups.row_group(k).total_byte_size for k in range(groups.num_row_groups)) <= 18 << 20


def test_clean_text_by_bytes_is_clean_text_by_patterns(spark):
    import re

    texts = ["a", "  a\tb  ", "a  b", "a\n\nb", "\n a\r\n", "x\u00a0\u00a0y", "\u2003a", "a\u0085", "", "   ", None, "\x1c a", "\ta \t\x0bb", "é  é", "a\nb"]
    space = "[\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    tidy = lambda t: re.sub(f"{space}{{2,}}", " ", re.sub(f"^{space}+|{space}+\\Z", "", t.replace("\t", " "))) or None
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", clean_text(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == [None if r.t is None else tidy(r.t) for r in rows]
