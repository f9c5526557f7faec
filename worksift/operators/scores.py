"""Risk score, inspection rank and what a score is made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksift.config import SETTINGS
from worksift.functions.money import risk_band
from worksift.operators.detectors import detect, flag_assemble
from worksift.operators.ensemble import POINT, anomaly_features, ensemble_score, feature_points, isolation_runs, point_columns
from worksift.plans.ranking import global_rank, running_totals
from worksift.plans.storage import written

SCORED_COLUMNS = ["work_id", "inspection_rank", "risk_score", "flags", "why_flagged", "peer_group"]


def _weight(flag: Column) -> Column:
    chain = F
    for name, points in SETTINGS.flag_weights.items():
        chain = chain.when(flag == name, F.lit(points))
    return chain.otherwise(F.lit(0.0))


def flag_points(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0.0), lambda total, f: total + _weight(f))


def risk_score(flags: Column, ensemble: Column) -> Column:
    """Capped flag points plus the clamped ensemble share, to two decimals."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(ensemble, F.lit(0.0))))
    points = F.least(F.lit(SETTINGS.flags_cap), flag_points(flags))
    return F.round(F.least(F.lit(100.0), points + SETTINGS.ensemble_weight * clamped), 2)


def inspection_rank(scored: DataFrame) -> DataFrame:
    """Dense 1..N: highest score first, then the smaller work id."""
    return global_rank(scored, [F.col("risk_score").desc(), F.col("work_id").asc()], "inspection_rank")


def score_all(works: DataFrame, as_of: Column, ensemble: DataFrame | None | bool = True) -> DataFrame:
    """Scored records of every work.

    ``ensemble`` is ``True`` to fit it here, ``None`` to score by rules alone, or a table of
    points and scores fitted elsewhere.
    """
    flagged = flag_assemble(detect(works, as_of))
    if ensemble is None:
        signal = F.lit(0.0)
    else:
        points = ensemble_score(works, as_of) if ensemble is True else ensemble
        flagged = flagged.withColumns(point_columns(as_of)).join(points, POINT, "left")
        signal = F.col("ensemble")
    scored = flagged.withColumn("risk_score", risk_score(F.col("flags"), signal))
    # Ranking samples its rows before it sorts them: written, they are scored once and not twice.
    narrow = written(scored.select(*[c for c in SCORED_COLUMNS if c != "inspection_rank"]), "unranked")
    return inspection_rank(narrow).select(*SCORED_COLUMNS)


def risk_breakdown(scored: DataFrame) -> DataFrame:
    """One row per part of a score: each flag at its (cap-scaled) points, then the ensemble."""
    total = flag_points(F.col("flags"))
    capped = F.least(F.lit(SETTINGS.flags_cap), total)
    base = scored.select("work_id", "flags", "risk_score", total.alias("_raw"), capped.alias("_capped"))
    rest = F.greatest(F.lit(0.0), F.col("risk_score") - F.col("_capped"))
    parts = F.transform(
        "flags",
        lambda f: F.struct(f.alias("part"), (_weight(f) * F.col("_capped") / F.nullif(F.col("_raw"), F.lit(0.0))).alias("points")),
    )
    ensemble = F.when(
        rest > 0.005, F.array(F.struct(F.lit("ensemble").alias("part"), rest.alias("points")))
    ).otherwise(F.array().cast("array<struct<part:string,points:double>>"))
    with_parts = base.withColumn("_parts", F.concat(parts, ensemble)).withColumn(
        "_total", F.aggregate("_parts", F.lit(0.0), lambda t, p: t + p["points"])
    )
    return with_parts.select(
        "work_id", "_total", (F.col("_raw") - F.col("_capped")).alias("capped_by"), F.explode("_parts").alias("p")
    ).select(
        "work_id",
        F.col("p.part").alias("part"),
        F.col("p.points").alias("points"),
        F.when(F.col("_total") > 0, F.col("p.points") / F.col("_total")).otherwise(0.0).alias("share"),
        "capped_by",
    )


def risk_band_counts(scored: DataFrame) -> DataFrame:
    band = risk_band(F.col("risk_score"), F.col("flags"))
    return scored.groupBy(band.alias("band")).agg(F.count("*").alias("works"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks with ties sharing their mean. Rows are counted per distinct value first, so a common
    value is one row when the values are put in order."""
    counts = df.groupBy(value).agg(F.count("*").alias("_c"))
    ordered = running_totals(global_rank(counts, [F.col(value)], "_order"), "_order", {"_upto": "_c"})
    ranks = ordered.select(F.col(value), (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name))
    return df.join(ranks, value)


def rank_stability(run_a: DataFrame, run_b: DataFrame, k: int) -> DataFrame:
    """Spearman correlation of two runs' scores and the Jaccard overlap of their top ``k``."""
    a = average_ranks(run_a.select("work_id", F.col("score").alias("_a")), "_a", "_ra")
    b = average_ranks(run_b.select("work_id", F.col("score").alias("_b")), "_b", "_rb")
    # A run without any spread has no correlation.
    spread = F.nullif(F.stddev_pop("_ra") * F.stddev_pop("_rb"), F.lit(0.0))
    rho = a.join(b, "work_id").agg((F.covar_pop("_ra", "_rb") / spread).alias("spearman"))

    def top(run: DataFrame, mark: str) -> DataFrame:
        return run.orderBy(F.col("score").desc(), "work_id").limit(k).select("work_id", F.lit(1).alias(mark))

    both = top(run_a, "_in_a").join(top(run_b, "_in_b"), "work_id", "full_outer")
    shared = F.count_if(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull())
    overlap = both.agg((shared / F.nullif(F.count("*"), F.lit(0))).alias("jaccard_top_k"))
    return rho.crossJoin(F.broadcast(overlap))  # single rows


def run_scores(works: DataFrame, as_of: Column, seeds: Sequence[int], sizes: Sequence[int]) -> DataFrame:
    """``run, work_id, score``: isolation of every work by forests of several seeds and sizes, grown and
    applied in one pass. Runs are numbered by seed and then by size."""
    points = feature_points(works, as_of)
    signal = isolation_runs(points, anomaly_features(works, as_of), seeds, sizes).select(*POINT, "runs")
    each = works.select("work_id", *[c.alias(n) for n, c in point_columns(as_of).items()]).join(signal, POINT)
    return each.select("work_id", F.posexplode("runs").alias("run", "score")).select("run", "work_id", F.round("score", 9).alias("score"))


def forest_stability(runs: DataFrame, pairs: Sequence[tuple[int, int]], k: int) -> DataFrame:
    """``run_a, run_b, spearman, jaccard_top_k`` of pairs of ``runs`` (``run, work_id, score``), which hold
    the same works. All runs are ranked together: scores are counted per run and distinct value, put in
    one order, and a run's ranks begin where the one before ends."""
    runs = written(runs, "runs")
    counts = runs.groupBy("run", "score").agg(F.count("*").alias("_c"))
    ordered = written(running_totals(global_rank(counts, [F.col("run"), F.col("score")], "_order"), "_order", {"_upto": "_c"}), "run-ranks")
    starts = ordered.groupBy("run").agg(F.min(F.col("_upto") - F.col("_c")).alias("_start"))
    mean = F.col("_upto") - F.col("_start") - (F.col("_c") - 1) / 2
    ranks = ordered.join(F.broadcast(starts), "run").select("run", "score", mean.alias("rank"))  # one row per run
    ranked = written(runs.join(ranks, ["run", "score"]).select("run", "work_id", "rank"), "ranked")
    wanted = runs.sparkSession.createDataFrame(list(pairs), "run_a int, run_b int")
    side = lambda s: ranked.select(F.col("run").alias(f"run_{s}"), "work_id", F.col("rank").alias(f"_{s}"))
    met = side("a").join(F.broadcast(wanted), "run_a").join(side("b"), ["run_b", "work_id"])  # a row per pair of runs
    spread = F.nullif(F.stddev_pop("_a") * F.stddev_pop("_b"), F.lit(0.0))
    rho = met.groupBy("run_a", "run_b").agg((F.covar_pop("_a", "_b") / spread).alias("spearman"))
    top = None
    for run in sorted({r for pair in pairs for r in pair}):
        best = runs.where(F.col("run") == run).orderBy(F.col("score").desc(), "work_id").limit(k).select("run", "work_id")
        top = best if top is None else top.unionByName(best)
    top = written(top, "top")  # k works per run
    size = top.groupBy("run").agg(F.count("*").alias("n"))
    a, b = (top.select(F.col("run").alias(f"run_{s}"), "work_id") for s in "ab")
    shared = a.join(F.broadcast(wanted), "run_a").join(b, ["run_b", "work_id"]).groupBy("run_a", "run_b").agg(F.count("*").alias("_shared"))
    sizes = lambda s: size.select(F.col("run").alias(f"run_{s}"), F.col("n").alias(f"_n_{s}"))
    common = F.coalesce("_shared", F.lit(0))
    overlap = wanted.join(sizes("a"), "run_a").join(sizes("b"), "run_b").join(shared, ["run_a", "run_b"], "left").select(
        "run_a", "run_b", (common / (F.col("_n_a") + F.col("_n_b") - common)).alias("jaccard_top_k")
    )
    return rho.join(overlap, ["run_a", "run_b"])
