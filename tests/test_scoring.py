import hashlib
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from worksift.operators import detectors, ensemble, peers, scores
from worksift.plans import storage
from worksift.plans.storage import run_dir

AS_OF = "2025-06-15"


def as_of():
    return F.lit(AS_OF).cast("date")


def findings(works):
    out = detectors.flag_assemble(detectors.detect(works, as_of()))
    return {r.work_id: r for r in out.collect()}


@pytest.mark.parametrize("members,expected", [(29, []), (30, ["cost_outlier", "stalled_work"])])
def test_a_group_below_thirty_never_flags(peers_around, members, expected):
    extreme = {"sanctioned_amount_inr": 1e9, "expenditure_amount_inr": 0.0}
    works = peers_around(members - 1, extreme)
    row = findings(works)[f"w{members:04d}"]
    assert row.flags == expected
    assert (row.peer_group is None) == (expected == [])


def test_groups_are_not_widened_over_years(peers_around):
    works = peers_around(29, {"sanctioned_amount_inr": 1e9, "sanction_date": "2023-05-01"}, {"sanctioned_amount_inr": 1e9, "state": ""})
    assert all(r.flags == [] for r in findings(works).values())


def test_cost_outlier_needs_spread(peers_around):
    flat = peers_around(40, sanctioned_amount_inr=100.0)
    assert all("cost_outlier" not in r.flags for r in findings(flat).values())


def test_stalled_variants(peers_around):
    quiet = {"completion_status": "Completed"}
    works = peers_around(
        40,
        {"sanction_date": "2024-12-31", "last_updated": "2024-12-31", "expenditure_amount_inr": 0.0},
        {"sanction_date": "2025-01-01", "expenditure_amount_inr": 0.0},
        {"expenditure_amount_inr": 9.0},
        {"expenditure_amount_inr": 10.0},
        {"expenditure_amount_inr": 0.0, "sanctioned_amount_inr": 0.0},
        {"sanction_date": None, "last_updated": "2024-12-01", "expenditure_amount_inr": 0.0},
        {"sanction_date": None, "last_updated": "2024-12-01", "expenditure_amount_inr": 1.0},
        {"expenditure_amount_inr": 0.0, **quiet},
        **{"completion_status": "Completed"},
    )
    works = works.withColumn(
        "completion_status",
        F.when(F.col("work_id").between("w0041", "w0047"), "Sanctioned").otherwise(F.col("completion_status")),
    )
    out = {r.work_id: (r.stalled_variant, r.stalled_months) for r in detectors.stalled_work(peers.gated(works), as_of()).collect()}
    assert out["w0041"] == ("zero_spend", 6)
    # January to June is five calendar months.
    assert out["w0042"] == (None, None)
    assert out["w0043"][0] == "part_spend" and out["w0044"][0] is None
    assert out["w0045"][0] is None
    assert out["w0046"] == ("no_update", 6) and out["w0047"][0] is None
    assert out["w0048"][0] is None


def test_expenditure_mismatch(peers_around):
    wild = peers_around(60, {"expenditure_amount_inr": 300.0}, expenditure_amount_inr=10.0, sanctioned_amount_inr=100.0)
    row = {r.work_id: r for r in detectors.expenditure_mismatch(peers.gated(wild)).collect()}["w0061"]
    assert (row.mismatch_variant, row.mismatch_percent_over) == ("over_sanction", 200.0)
    close = peers_around(100, {"expenditure_amount_inr": 100.0}, {"expenditure_amount_inr": 100.0, "completion_status": "Completed"}, {"expenditure_amount_inr": 95.0}, expenditure_amount_inr=10.0, sanctioned_amount_inr=100.0)
    out = {r.work_id: r.mismatch_variant for r in detectors.expenditure_mismatch(peers.gated(close)).collect()}
    assert [out[f"w{i:04d}"] for i in (101, 102, 103)] == ["full_spend_open", None, None]


def test_concentration_prefers_the_agency(make_works):
    rows = [{"implementing_agency": f"A{i}", "vendor_name": f"V{i}", "mp_name": f"M{i}", "constituency": f"C{i}"} for i in range(20)]
    rows += [{"implementing_agency": "Wide", "vendor_name": "VW", "mp_name": f"M{i}", "constituency": f"C{i}"} for i in range(6)]
    rows += [{"implementing_agency": None, "vendor_name": "VX", "mp_name": "M", "constituency": f"C{i}"} for i in range(8)]
    out = detectors.agency_concentration(make_works(*rows)).collect()
    by_agency = {r.concentration_variant for r in out if r.implementing_agency == "Wide"}
    by_vendor = {(r.concentration_variant, r.concentration_districts, r.concentration_mps) for r in out if r.vendor_name == "VX"}
    assert by_agency == {"districts_and_mps"}
    assert by_vendor == {("vendor", 8, None)}
    assert {r.concentration_variant for r in out if r.vendor_name not in ("VW", "VX")} == {None}


def test_score_caps_flags_at_eighty(spark):
    every = F.array(*[F.lit(f) for f in ("cost_outlier", "stalled_work", "expenditure_mismatch", "agency_concentration")])
    row = spark.range(1).select(
        scores.risk_score(every, F.lit(1.0)).alias("a"), scores.risk_score(every, F.lit(None)).alias("b"), scores.risk_score(F.array().cast("array<string>"), F.lit(2.0)).alias("c")
    ).first()
    assert (row.a, row.b, row.c) == (100.0, 80.0, 20.0)


def test_breakdown_adds_up(spark):
    df = spark.createDataFrame([("a", ["cost_outlier", "stalled_work", "expenditure_mismatch", "agency_concentration"], 90.0), ("b", [], 0.0), ("c", ["stalled_work"], 25.0)], "work_id string, flags array<string>, risk_score double")
    rows = scores.risk_breakdown(df).collect()
    parts = {(r.work_id, r.part): r.points for r in rows}
    assert parts[("a", "cost_outlier")] == 24.0 and parts[("a", "ensemble")] == 10.0 and parts[("c", "stalled_work")] == 25.0
    assert abs(sum(p for (w, _), p in parts.items() if w == "a") - 90.0) < 1e-9
    assert {r.capped_by for r in rows if r.work_id == "a"} == {20.0}


@pytest.fixture(scope="module")
def crowd(make_works):
    rng = np.random.default_rng(5)
    rows = [
        {"sanctioned_amount_inr": float(a), "expenditure_amount_inr": float(a * s), "sanction_date": f"2024-{1 + i % 12:02d}-01"}
        for i, (a, s) in enumerate(zip(rng.integers(100, 140, 500), rng.integers(0, 4, 500) / 4))
    ]
    rows += [{"sanctioned_amount_inr": None, "expenditure_amount_inr": None}] * 90
    rows += [{"sanctioned_amount_inr": 9e7, "expenditure_amount_inr": 1.0, "sanction_date": "2010-01-01"}]
    return make_works(*rows)


def brute_factor(points, k=20):
    """Local outlier factor with every work as its own row."""
    x = np.repeat(points[ensemble.FEATURES].to_numpy(), points["weight"], axis=0)
    ids = np.repeat(points["point"].to_numpy(), points["weight"])
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
    near = np.take_along_axis(d, order, 1)
    density = 1 / (np.maximum(near[:, -1][order], near).mean(1) + 1e-10)
    return dict(zip(ids, density[order].mean(1) / density))


@pytest.mark.parametrize("cell_points,brute", [(10_000, 4_000), (40, 4_000), (60, 50)])
def test_local_outlier_factor_is_exact_whatever_the_cells(crowd, monkeypatch, cell_points, brute):
    monkeypatch.setattr(ensemble, "_CELL_POINTS", cell_points)
    monkeypatch.setattr(ensemble, "_BRUTE_POINTS", brute)
    monkeypatch.setattr(ensemble, "_QUERIES_PER_TASK", 7)
    points = ensemble.feature_points(crowd, as_of())
    got = ensemble.local_outlier_factor(points).toPandas()
    want = brute_factor(got)
    assert got["weight"].max() >= 90
    assert np.allclose(got["outlier_factor"], got["point"].map(want), rtol=1e-9)


def test_neighbours_are_not_stored_and_large_cells_split_inside_their_task(spark, monkeypatch):
    """20 rows a point were written and shuffled several times over."""
    rng = np.random.default_rng(1)
    x = np.unique(np.round(rng.normal(size=(500, 4)), 1), axis=0)
    points = pd.DataFrame(x, columns=ensemble.FEATURES)
    points.insert(0, "weight", np.where(np.arange(len(x)) == 5, 60, 1 + np.arange(len(x)) % 2))
    points.insert(0, "point", np.arange(len(x)) * 7 + 3)
    kept = {}

    def keep(df, label):
        kept[label] = storage.written(df, label)
        return kept[label]

    monkeypatch.setattr(ensemble, "written", keep)
    monkeypatch.setattr(ensemble, "_CELL_POINTS", 60)
    monkeypatch.setattr(ensemble, "_TASK_POINTS", 130)
    monkeypatch.setattr(ensemble, "_BRUTE_POINTS", 50)
    monkeypatch.setattr(ensemble, "_CELLS_PER_CORE", 1)
    got = ensemble.local_outlier_factor(spark.createDataFrame(points)).toPandas()
    assert len(got) == len(x)
    assert np.allclose(got["outlier_factor"], got["point"].map(brute_factor(points)), rtol=1e-9)
    assert not {"near", "neighbours"} & set(kept)
    assert kept["density"].count() == len(x)
    assert kept["reach"].count() < 5 * len(x)


def test_ensemble_is_bounded_repeatable_and_finds_the_planted_work(crowd):
    first, second = (ensemble.ensemble_score(w, as_of()).toPandas() for w in (crowd, crowd.repartition(9)))
    both = first.merge(second, on=ensemble.POINT)
    assert len(both) == len(first)
    assert np.allclose(both["ensemble_x"], both["ensemble_y"], atol=1e-12)
    assert first["ensemble"].between(0, 1).all()
    assert first.sort_values("ensemble").iloc[-1]["point_sanctioned"] == 9e7


def test_ensemble_of_one_work_is_zero(make_works):
    assert [r.ensemble for r in ensemble.ensemble_score(make_works({}), as_of()).collect()] == [0.0]


def test_scores_do_not_depend_on_input_order(crowd):
    a, b = (scores.score_all(w, as_of()).select("work_id", "inspection_rank", "risk_score").toPandas() for w in (crowd, crowd.repartition(5, "work_id")))
    a, b = (x.sort_values("work_id").reset_index(drop=True) for x in (a, b))
    assert a.equals(b)
    assert sorted(a["inspection_rank"]) == list(range(1, len(a) + 1))


def test_rank_stability_of_equal_runs(spark):
    run = spark.createDataFrame([(f"w{i}", float(i % 9)) for i in range(100)], "work_id string, score double")
    row = scores.rank_stability(run, run, 10).first()
    assert abs(row.spearman - 1) < 1e-12 and row.jaccard_top_k == 1.0


def plain_rho(a, b):
    """Spearman by average ranks."""
    rank = lambda x: np.array([(np.sum(x < v) + (np.sum(x == v) + 1) / 2) for v in x])
    return np.corrcoef(rank(a), rank(b))[0, 1]


def test_forests_of_several_runs_against_a_plain_version(crowd):
    """Smaller forests are the first trees of larger ones, and agreement is that of plain ranks and sets."""
    seeds, sizes = (42, 7), (5, 20)
    runs = scores.run_scores(crowd, as_of(), seeds, sizes).toPandas().pivot(index="work_id", columns="run", values="score")
    assert list(runs.columns) == [0, 1, 2, 3]
    points = ensemble.feature_points(crowd, as_of())
    alone = ensemble.isolation_runs(points, ensemble.anomaly_features(crowd, as_of()), [7], [5]).select(*ensemble.POINT, F.col("runs")[0].alias("x"))
    of = crowd.select("work_id", *[c.alias(n) for n, c in ensemble.point_columns(as_of()).items()]).join(alone, ensemble.POINT)
    want = {r.work_id: round(r.x, 9) for r in of.collect()}
    assert all(abs(runs[2][w] - x) < 1e-9 for w, x in want.items())
    k, pairs = 10, [(0, 2), (1, 3), (0, 1)]
    long = scores.run_scores(crowd, as_of(), seeds, sizes)
    got = {(r.run_a, r.run_b): r for r in scores.forest_stability(long, pairs, k).collect()}
    assert set(got) == set(pairs)
    for a, b in pairs:
        assert abs(got[a, b].spearman - plain_rho(runs[a].to_numpy(), runs[b].to_numpy())) < 1e-9
        top = [set(sorted(runs.index, key=lambda w: (-runs[r][w], w))[:k]) for r in (a, b)]
        assert abs(got[a, b].jaccard_top_k - len(top[0] & top[1]) / len(top[0] | top[1])) < 1e-9


def test_every_tree_gets_its_sample(crowd):
    rows = ensemble.anomaly_features(crowd, as_of())
    total = rows.count()
    nodes = ensemble.forest_nodes(rows, total, [42], 30).toPandas()
    assert nodes["rows"].unique().tolist() == [min(total, 256)] and nodes.groupby("tree").ngroups == 30
    for _, tree in nodes.groupby("tree"):
        inner = tree[tree["axis"] >= 0]
        assert set(tree["node"]) == {0, *(2 * inner["node"] + 1), *(2 * inner["node"] + 2)}


def test_every_tree_draws_the_same_works_as_the_rule(spark):
    """draws are made by columns of numbers, not tree by tree in each row; works without an id draw nothing."""
    seeds, trees, total = [42, -7], 3, 2000
    rows = spark.range(total).select(F.col("id").cast("string").alias("work_id"), *[F.col("id").cast("double").alias(f) for f in ensemble.FEATURES])
    rows = rows.unionByName(rows.limit(1).withColumn("work_id", F.lit(None).cast("string")))
    offered = ensemble._forest_sample(rows, total, seeds, trees)
    assert "lambda" not in offered._jdf.queryExecution().optimizedPlan().toString().lower()
    chosen = {}
    for r in offered.collect():
        chosen.setdefault((r.seed, r.tree), set()).add(r.work_id)

    def draw(work_id, seed, tree):
        digest = hashlib.md5(work_id.encode()).hexdigest()
        a, b = int(digest[:8], 16), int(digest[8:16], 16) | 1
        return (a + (seed * 65_537 + tree) % (1 << 24) * b) % (1 << 32)

    for seed in seeds:
        for tree in range(trees):
            order = sorted((draw(str(w), seed, tree), str(w)) for w in range(total))
            assert chosen[seed, tree] == {w for _, w in order[: ensemble.SETTINGS.forest_sample]}


def test_works_are_scored_before_they_are_sampled(crowd):
    """the sort of the ranking samples stored scores."""
    ranked = scores.score_all(crowd, as_of(), ensemble=None)
    assert [f for f in os.listdir(run_dir(crowd.sparkSession)) if f.startswith("unranked-")]
    assert ranked.count() == crowd.count()
