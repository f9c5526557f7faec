import pytest
from pyspark.sql import functions as F

from worksift.operators import delay, evaluation, pendency, serve

AS_OF = "2025-06-15"


def as_of():
    return F.lit(AS_OF).cast("date")


@pytest.fixture(scope="module")
def merged(make_works):
    rows = []
    for i in range(60):
        rows.append(
            {
                "state": "S%d" % (i % 3),
                "completion_status": ["In Progress", "Sanctioned", "Completed", "Recommended"][i % 4],
                "sanction_date": None if i % 7 == 0 else f"20{22 + i % 3}-0{1 + i % 9}-01",
                "recommendation_date": f"2022-0{1 + i % 9}-01",
                "expenditure_amount_inr": float(i % 2),
                "vendor_name": "100% Works_Co" if i == 8 else "Plain",
                "implementing_district_authority": None if i == 9 else f"D{i % 2}",
                "sanctioned_amount_inr": 1_600_000.0 + i * 100_000.0,
            }
        )
    works = make_works(*rows)
    n = F.substring("work_id", 2, 4).cast("int")
    flags = F.when(n % 5 == 0, F.array(F.lit("stalled_work"))).otherwise(F.array().cast("array<string>"))
    return works.withColumns(
        {"inspection_rank": 61 - n, "risk_score": n.cast("double"), "flags": flags, "why_flagged": F.lit(None), "peer_group": F.lit(None)}
    ).cache()


def test_pages_cover_the_queue_without_gaps(merged, monkeypatch):
    from worksift.plans import ranking

    monkeypatch.setattr(ranking, "_BLOCK_ROWS", 7)
    places = []
    for page in range(1, 6):
        rows, meta = serve.works_page(merged, serve.WorksQuery(scope="under_implementation", page=page, page_size=8), as_of())
        places += [(r.display_rank, r.inspection_rank, r.work_id) for r in rows.collect()]
    places.sort()
    assert [p[0] for p in places] == list(range(1, 31))
    assert [p[1] for p in places] == sorted(p[1] for p in places)
    ranked = {r.work_id: r for r in serve.filtered_rank(merged.where(serve.under_implementation())).collect()}
    assert all(ranked[w].display_rank == n and ranked[w].inside_quota == (n <= 3) for n, _, w in places)
    row = meta.first()
    assert (row.total, row.total_pages, row.quota_n) == (30, 4, 3)
    assert row.flagged_total == sum(r.flagged for r in ranked.values())
    assert row.flagged_beyond_quota == sum(r.flagged for r in ranked.values() if r.display_rank > 3)


def test_a_page_is_one_read_of_a_range_of_ranks(spark, merged, monkeypatch):
    from worksift.plans import ranking

    monkeypatch.setattr(ranking, "_BLOCK_ROWS", 7)
    stored = serve.works_stored(merged)
    rows, _ = serve.works_page(stored, serve.WorksQuery(scope="under_implementation", page=2, page_size=8), as_of())
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = rows.select("*")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert plan.count("FileScan") == 1 and "Join" not in plan
    want = sorted(r.inspection_rank for r in merged.where(serve.under_implementation()).collect())[8:16]
    assert f"GreaterThanOrEqual(inspection_rank,{want[0]})" in plan and f"LessThanOrEqual(inspection_rank,{want[-1]})" in plan
    assert [(r.display_rank, r.inspection_rank) for r in rows.orderBy("display_rank").collect()] == [*zip(range(9, 17), want)]
    # Files of the stored table hold ranges of ranks that do not overlap.
    ends = stored.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min("inspection_rank").alias("a"), F.max("inspection_rank").alias("b")).orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:]))


def test_no_quota_outside_the_population_and_nothing_found(merged):
    _, meta = serve.works_page(merged, serve.WorksQuery(), as_of())
    assert (meta.first().quota_n, meta.first().flagged_beyond_quota, meta.first().total) == (None, None, 60)
    rows, meta = serve.works_page(merged, serve.WorksQuery(scope="under_implementation", q="no such work"), as_of())
    assert rows.count() == 0
    assert (meta.first().total, meta.first().quota_n, meta.first().flagged_beyond_quota) == (0, 0, 0)


def test_search_is_literal(merged):
    assert serve.works_search(merged, "100% works_").count() == 1
    assert serve.works_search(merged, "%").count() == 1
    assert serve.works_search(merged, "W0003").count() == 1


def test_card_counts_equal_the_filtered_lists(merged):
    cards = {r.kind: r["count"] for r in pendency.pendency_kinds(merged, as_of()).collect()}
    for kind in ("late_sanction", "open_past_one_year", "no_payment_90_days"):
        assert cards[kind] == serve.works_filter(merged, serve.WorksQuery(pendency=kind), as_of()).count() > 0
    for by in pendency.GROUP_COLUMNS:
        groups = pendency.pendency_groups(merged, by, as_of()).collect()
        assert [(-g.population_n, g.group) for g in groups] == sorted((-g.population_n, g.group) for g in groups)
    states = pendency.pendency_groups(merged, "state", as_of()).collect()
    assert sum(g.late_sanction for g in states) == cards["late_sanction"]
    with pytest.raises(ValueError):
        serve.pendency_condition("early_warning", as_of())


def test_pushed_filters_reach_the_scan(merged, spark, tmp_path):
    path = str(tmp_path / "m")
    merged.drop("why_flagged", "peer_group").write.parquet(path)
    asked = serve.WorksQuery(scope="under_implementation", states=("S1",))
    plan = serve.works_filter(spark.read.parquet(path), asked, as_of()).select("work_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(completion_status" in plan or "In(state" in plan or "EqualTo(state" in plan
    assert "vendor_name" not in plan.split("ReadSchema")[-1]


def test_facets_keep_flags_that_never_fired(merged):
    facets = {(r.facet, r.value): r["count"] for r in serve.works_facets(merged).collect()}
    assert facets[("flag", "cost_outlier")] == 0 and facets[("flag", "stalled_work")] > 0
    assert ("district_authority", None) not in facets


def test_summary_and_quota(merged):
    row = serve.summary_figures(merged).first()
    assert (row.works_under_implementation, row.total_works_all_statuses, row.state_count) == (30, 60, 3)
    ratios = serve.summary_ratios(serve.summary_figures(merged.where("work_id = 'none'"))).first()
    assert tuple(ratios) == (0.0, 0.0, 0.0)
    assert pendency.quota_sum(merged).first().quota_sum == 2 + 2
    third = pendency.third_party(merged).first()
    assert third.required_n == third.at_or_above_25_lakh + -(-third.between_15_and_25_lakh // 2)
    assert evaluation.targeting_performance(merged).first().quota == 3


def test_early_warning_is_served_only_when_current_and_shipped(spark):
    rows = [("shipped", AS_OF), ("shipped", "2025-05-15"), ("not_shipped", AS_OF)]
    artifact = spark.createDataFrame(rows, "status string, data_as_of string").withColumn("data_as_of", F.to_date("data_as_of"))
    manifest = spark.createDataFrame([(AS_OF + "T10:00:00Z",)], "data_as_of string")
    assert serve.early_warning_read(artifact, manifest).count() == 1


# -- delay model ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def cohort(make_works):
    rows = []
    for i in range(1500):
        day = i % 27 + 1
        month = 4 + i % 8  # sanctioned April to November 2023, and again young
        agency = f"A{i % 10}"
        late = (i % 10 < 4) != (i % 37 == 0)
        rows.append(
            {
                "implementing_agency": agency, "sanction_date": f"{2023 if i % 3 else 2024}-{month:02d}-{day:02d}", "state": f"S{i % 4}",
                "sanctioned_amount_inr": 1000.0 + i % 50, "completion_status": "In Progress" if late else "Completed",
            }
        )
    return make_works(*rows)


def test_cohort_dates(spark):
    dates = delay.cohort_dates(F.lit("2026-09-04").cast("date"))
    row = spark.range(1).select(*[c.cast("string").alias(n) for n, c in dates.items()]).first()
    assert tuple(row) == ("2024-07-04", "2025-01-04", "2025-04-04")


def test_a_learnable_label_ships_and_spending_cannot_move_it(cohort):
    artifact, watch = delay.delay_watch(cohort, as_of())
    row = artifact.first()
    assert row.status == "shipped" and row.roc_auc > 0.8
    young = cohort.where(F.col("completion_status").isin("In Progress", "Sanctioned") & F.datediff(as_of(), "sanction_date").between(0, 365)).count()
    assert row.scored_n == young and row.watch_n == watch.count() == -(-young // 10)
    spent = cohort.withColumn("expenditure_amount_inr", F.rand(3) * 1e6)
    again = delay.delay_watch(spent, as_of())[1]
    assert [r.work_id for r in again.orderBy("place").collect()] == [r.work_id for r in watch.orderBy("place").collect()]


def test_noise_does_not_ship(cohort):
    noise = cohort.withColumn("completion_status", F.when(F.xxhash64("work_id") % 2 == 0, "In Progress").otherwise("Completed"))
    artifact, watch = delay.delay_watch(noise, as_of())
    assert artifact.first().status == "not_shipped" and watch.count() == 0


def test_metrics_equal_direct_counts(spark):
    import random

    rng = random.Random(2)
    rows = [(f"w{i:03d}", int(rng.random() < 0.4), rng.randint(0, 12) / 10) for i in range(200)]
    df = spark.createDataFrame(rows, "work_id string, y int, score double")
    out = delay.delay_metrics(df).first()
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, tp = 0.0, 0
    for t in sorted({s for _, _, s in rows}, reverse=True):
        hits = sum(p >= t for p in pos)
        ap += (hits - tp) / len(pos) * hits / (hits + sum(n >= t for n in neg))
        tp = hits
    top = sorted(rows, key=lambda r: (-r[2], r[0]))[:20]
    base = len(pos) / 200
    assert tuple(out) == (round(auc, 3), round(ap, 3), round(base, 3), round(sum(y for _, y, _ in top) / 20 / base, 3))
    flat = spark.createDataFrame([("a", 1, 0.5), ("b", 0, 0.5)], "work_id string, y int, score double")
    assert delay.delay_metrics(flat).first().roc_auc == 0.5


def test_few_categories_are_pooled_and_unseen_ones_score_as_zeros(cohort, make_works):
    train = delay.delay_features(delay.labelled(cohort).where("sanction_date < '2024-01-01'"), delay.agency_prior(delay.labelled(cohort)))
    rare = train.withColumn("state", F.when(F.col("work_id") < "w0020", F.concat(F.lit("rare"), F.col("work_id"))).otherwise(F.col("state")))
    model = delay.DelayModel(rare)
    names = {n for n, _ in model.coefficients()}
    assert "state_(few)" in names and not any("rarew" in n for n in names)
    seen = rare.limit(5).withColumn("state", F.lit("never seen"))
    assert model.score(seen).where("score is null").count() == 0
