import random

import pytest
from pyspark.sql import functions as F

from worksift import config
from worksift.operators import ledger


def reviews_of(spark, *rows):
    return spark.createDataFrame(rows, "review_id bigint, candidate_id bigint, status string, reviewed_by string, supersedes bigint")


def candidates_of(spark, n):
    return spark.createDataFrame([(i, "identical_batch") for i in range(1, n + 1)], "candidate_id bigint, finder string")


def test_resolve_takes_the_newest_review_not_superseded(spark):
    reviews = reviews_of(spark, (1, 1, "a", "x", None), (2, 1, "b", "x", 1), (3, 2, "a", "x", None), (4, 2, "c", "x", None), (5, 2, "d", "x", 4))
    out = {r.candidate_id: r.current_status for r in ledger.review_resolve(candidates_of(spark, 3), reviews).collect()}
    assert out == {1: "b", 2: "d", 3: "pending"}


def test_append_chains_and_refuses(spark):
    reviews = reviews_of(spark, (7, 1, "confirmed_same", "x", None))
    decisions = spark.createDataFrame(
        [(1, "rejected_different", " ann ", 1), (2, "confirmed_same", "bob", 2), (1, "confirmed_same", "cy", 3), (1, "maybe", "d", 4), (2, "confirmed_same", " ", 5), (9, "confirmed_same", "e", 6)],
        "candidate_id bigint, status string, reviewed_by string, position bigint",
    )
    out = {r.position: (r.problem, r.review_id, r.supersedes, r.reviewed_by) for r in ledger.review_append(candidates_of(spark, 2), reviews, decisions).collect()}
    assert out[1] == (None, 8, 7, "ann") and out[2] == (None, 9, None, "bob") and out[3] == (None, 10, 8, "cy")
    assert [out[i][:3] for i in (4, 5, 6)] == [("unknown_status", None, None), ("blank_reviewer", None, None), ("candidate_not_found", None, None)]


def test_upsert_keeps_ids_sorts_sides_and_takes_the_last_row(spark):
    key = ["scope", "fingerprint_a", "fingerprint_b", "finder_version"]
    schema = "scope string, fingerprint_a string, fingerprint_b string, finder_version string, text string"
    existing = spark.createDataFrame([("S", "a", "b", "v", "old"), ("S", "c", "c", "v", "kept")], schema).withColumn("candidate_id", F.when(F.col("text") == "old", 4).otherwise(6).cast("bigint"))
    incoming = spark.createDataFrame([("S", "b", "a", "v", "first", 1), ("S", "x", "x", "v", "new", 2), ("S", "a", "b", "v", "last", 3), ("A", "x", "x", "v", "newer", 4)], schema + ", position bigint")
    out = {(r.scope, r.fingerprint_a, r.fingerprint_b): (r.candidate_id, r.text) for r in ledger.candidate_upsert(existing, incoming, key).collect()}
    assert out == {("S", "a", "b"): (4, "last"), ("S", "c", "c"): (6, "kept"), ("S", "x", "x"): (7, "new"), ("A", "x", "x"): (8, "newer")}


def one_by_one(history, batch, works, today):
    """The rules applied to one request after the other."""
    stored = {h["outcome_id"]: h for h in history}
    verdicts = {}
    for row in sorted(batch, key=lambda r: r["position"]):
        triple = (row["work_id"], row["inspected_on"], row["inspector_id"])
        target = stored.get(row["supersedes"])
        if row["work_id"] not in works:
            reason = "work_not_found"
        elif row["outcome"] not in config.OUTCOME_IS_ISSUE:
            reason = "unknown_outcome"
        elif row["inspected_on"] > today:
            reason = "bad_date"
        elif row["supersedes"] is not None and (target is None or target["work_id"] != row["work_id"]):
            reason = "invalid_supersedes"
        elif row["supersedes"] is not None and any(s["supersedes"] == row["supersedes"] for s in stored.values()):
            reason = "already_superseded"
        elif any((s["work_id"], s["inspected_on"], s["inspector_id"]) == triple for s in stored.values()):
            reason = "duplicate_outcome"
        else:
            reason = None
            stored[row["outcome_id"]] = row
        verdicts[row["outcome_id"]] = reason
    return verdicts


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_a_batch_of_outcomes_equals_one_request_after_the_other(spark, seed):
    rng = random.Random(seed)
    names = ["outcome_id", "work_id", "inspected_on", "inspector_id", "outcome", "supersedes", "position"]

    def row(i, targets):
        return dict(
            outcome_id=i, work_id=f"w{rng.randint(1, 5)}", inspected_on=f"2024-01-{rng.randint(1, 6):02d}", inspector_id=rng.choice("ab"),
            outcome=rng.choice(["work_present_and_matches"] * 9 + ["wrong"]), supersedes=rng.choice([None, None, rng.choice(targets)]) if targets else None, position=i,
        )

    history, seen = [], set()
    for i in range(1, 15):
        r = {**row(i, []), "outcome": "work_present_and_matches"}
        key = (r["work_id"], r["inspected_on"], r["inspector_id"])
        if key not in seen:
            seen.add(key)
            history.append(r)
    # Targets are mostly recent rows, so that chains form; some come later, and some are the row itself.
    recent = lambda i: [*range(max(100, i - 12), i + 4), *range(1, 15)]
    batch = [row(i, recent(i) if seed > 2 else list(range(1, i))) for i in range(100, 180)]
    if seed > 2:
        for r in batch:
            r["work_id"], r["inspected_on"] = rng.choice(["w1", "w2"]), f"2024-01-{rng.randint(1, 5):02d}"
            r["inspector_id"] = rng.choice("abcdefgh")
    schema = "outcome_id bigint, work_id string, inspected_on string, inspector_id string, outcome string, supersedes bigint, position bigint"
    frame = lambda rows: spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema).withColumn("inspected_on", F.col("inspected_on").cast("date"))
    works = spark.createDataFrame([(f"w{i}",) for i in range(1, 5)], "work_id string")
    out = ledger.outcome_accept(frame(history), frame(batch), works, F.lit("2024-01-05").cast("date"))
    got = {r.outcome_id: r.reason for r in out.collect()}
    want = one_by_one(history, batch, {f"w{i}" for i in range(1, 5)}, "2024-01-05")
    assert got == want
    assert len(set(want.values())) >= (6 if seed < 3 else 4)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """A chain of 1,000 amendments in one batch, and one whose second half follows a refused row."""
    labels = []
    keep = ledger.written
    monkeypatch.setattr(ledger, "written", lambda df, label: (labels.append(label), keep(df, label))[1])
    kinds = "outcome_id bigint, work_id string, inspected_on string, inspector_id string, outcome string, supersedes bigint, position bigint"
    ok = "work_present_and_matches"
    rows = [(k, "w1", "2024-01-01", f"i{k}", ok, k - 1 if k > 1 else None, k) for k in range(1, 1001)]
    rows += [(k, "w2", "2024-01-01", f"i{k}", "wrong" if k == 1500 else ok, k - 1 if k > 1401 else None, k) for k in range(1401, 1601)]
    batch = spark.createDataFrame(rows, kinds).withColumn("inspected_on", F.col("inspected_on").cast("date"))
    works = spark.createDataFrame([("w1",), ("w2",)], "work_id string")
    out = {r.outcome_id: r.reason for r in ledger.outcome_accept(batch.where("false"), batch, works, F.lit("2024-01-05").cast("date")).collect()}
    assert all(out[k] is None for k in (*range(1, 1001), *range(1401, 1500)))
    assert out[1500] == "unknown_outcome" and {out[k] for k in range(1501, 1601)} == {"invalid_supersedes"}
    assert labels.count("steps") + labels.count("decided") <= 24
    assert max(labels[: labels.index("decided")].count("steps"), 1) <= 12


def test_context_ranks_inside_the_authority(make_works, spark):
    da = lambda d, s="In Progress": {"implementing_district_authority": d, "completion_status": s}
    works = make_works(da("A"), da("A"), da("A", "Completed"), da(None), da(None), da("B", "Completed"))
    scored = spark.createDataFrame([(f"w{i:04d}", s) for i, s in enumerate([10.0, 20.0, 10.0, 5.0, 5.0, 1.0], 1)], "work_id string, risk_score double")
    out = {r.work_id: (r.inspection_rank_at_time, r.population_n_at_time, r.cutoff_rank_at_time) for r in ledger.outcome_context(works, scored).collect()}
    assert out == {"w0001": (2, 2, 1), "w0002": (1, 2, 1), "w0003": (3, 2, 1), "w0004": (1, 2, 1), "w0005": (2, 2, 1), "w0006": (1, 0, 0)}


def test_groups_and_wilson(spark):
    rows = [(i, "work_present_but_differs" if i <= 12 else "work_present_and_matches", False, None) for i in range(1, 31)]
    rows += [(40, "agency_unresponsive", False, None), (41, "work_present_but_differs", True, None), (42, "work_present_but_differs", True, 41)]
    df = spark.createDataFrame(rows, "outcome_id bigint, outcome string, in_control_sample boolean, supersedes bigint")
    df = df.withColumns({"inspection_rank_at_time": F.lit(3), "cutoff_rank_at_time": F.when(F.col("outcome_id") < 5, 3).otherwise(2)})
    out = {r.group: r for r in ledger.wilson_rate(ledger.outcome_groups(df)).collect()}
    ranked, spot = out["ranked"], out["spot_check"]
    assert (ranked.n, ranked.reached_work, ranked.issues, ranked.within_quota) == (31, 30, 12, 4)
    assert (spot.n, spot.issue_rate, spot.comparison_ready) == (1, None, False)
    assert ranked.issue_rate == 0.4 and abs(ranked.rate_low - 0.24594) < 1e-4 and abs(ranked.rate_high - 0.57677) < 1e-4


def test_first_layout_outcomes_are_read_under_the_right_name(spark):
    df = spark.createDataFrame([(1, 1, "DA", None), (2, 2, "AG", "DA2")], "outcome_id int, context_version int, implementing_agency string, implementing_district_authority string")
    out = {r.outcome_id: (r.implementing_district_authority, r.implementing_agency) for r in ledger.outcome_read(df).collect()}
    assert out == {1: ("DA", None), 2: ("DA2", "AG")}


def test_outcomes_can_arrive_as_a_stream(spark, tmp_path):
    from worksift.streaming.outcome_feed import append_outcomes

    schema = "outcome_id bigint, work_id string, inspected_on date, inspector_id string, outcome string, supersedes bigint, position bigint"
    works = spark.createDataFrame([("w1",)], "work_id string")
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "ledger", "state"))

    def arrive(*rows):
        df = spark.createDataFrame(rows, schema.replace("date", "string")).withColumn("inspected_on", F.col("inspected_on").cast("date"))
        df.coalesce(1).write.mode("append").parquet(source)
        append_outcomes(spark.readStream.schema(schema).parquet(source), works, target, checkpoint).awaitTermination()

    ok = "work_not_found_at_site"
    arrive((1, "w1", "2024-01-01", "a", ok, None, 1), (2, "w1", "2024-01-01", "a", ok, None, 2))
    arrive((3, "w1", "2024-01-01", "a", ok, None, 3), (4, "w1", "2024-01-02", "a", ok, 1, 4))
    out = {r.outcome_id: r.reason for r in spark.read.parquet(target).collect()}
    assert out == {1: None, 2: "duplicate_outcome", 3: "duplicate_outcome", 4: None}


def test_outcomes_without_position_or_id_are_refused(spark):
    kinds = "outcome_id bigint, work_id string, inspected_on date, inspector_id string, outcome string, supersedes bigint, position bigint"
    ok = "work_not_found_at_site"
    rows = [(1, "a", None, None), (None, "b", None, 2), (3, "\t", None, 3), (4, "c", None, 4)]
    batch = spark.createDataFrame(
        [(i, "w1", "2024-01-01", who, ok, s, p) for i, who, s, p in rows], kinds.replace("date", "string")
    ).withColumn("inspected_on", F.col("inspected_on").cast("date"))
    works = spark.createDataFrame([("w1",)], "work_id string")
    out = ledger.outcome_accept(batch.where("false"), batch, works, F.lit("2025-01-01").cast("date")).collect()
    assert {(r.outcome_id, r.reason) for r in out} == {(1, "no_position"), (None, "no_position"), (3, "blank_inspector"), (4, None)}


def test_pages_of_candidates_with_gaps_in_their_ids(spark, monkeypatch):
    monkeypatch.setattr("worksift.plans.ranking._BLOCK_ROWS", 16)
    ids = list(range(3, 200, 7))
    resolved = spark.createDataFrame([(i, "identical_batch", "pending") for i in ids], "candidate_id bigint, finder string, current_status string")
    seen = []
    for number in range(1, 7):
        page, total = ledger.candidate_page(resolved, status="pending", page=number, page_size=5)
        seen.append(sorted(r.candidate_id for r in page.collect()))
        assert tuple(total.first()) == (len(ids), 6)
    assert seen == [ids[k : k + 5] for k in range(0, 30, 5)]
    beyond, _ = ledger.candidate_page(resolved, page=7, page_size=5)
    none, total = ledger.candidate_page(resolved, status="other")
    assert beyond.isEmpty() and none.isEmpty() and tuple(total.first()) == (0, 0)


@pytest.mark.parametrize("page, size", [(0, 50), (1, 0), (1, config.MAX_PAGE_SIZE + 1)])
def test_pages_have_a_bounded_size(spark, page, size):
    from worksift.operators.serve import WorksQuery

    with pytest.raises(ValueError):
        ledger.candidate_page(candidates_of(spark, 1), page=page, page_size=size)
    with pytest.raises(ValueError):
        WorksQuery(page=page, page_size=size)


def test_context_of_a_few_works_shuffles_no_texts(spark):
    """the places of the works asked for are stored, so that their number is known to the join with all texts."""
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c")], "candidate_id bigint, work_id string")
    resolved = spark.createDataFrame([(i, "f", False, f"text {i}", "pending") for i in (1, 2, 3)], "candidate_id bigint, finder string, threshold_crossing_batch boolean, text string, current_status string")
    out = ledger.duplicate_context(members, resolved, members.where("work_id = 'a'").distinct())
    assert [f for f in out.inputFiles() if "/placed-" in f]
    assert sorted((r.work_id, r.candidate_id, r.place, r.work_count, r.other_work_count, r.text) for r in out.collect()) == [("a", 1, 2, 2, 1, "text 1"), ("a", 2, 1, 1, 0, "text 2")]
