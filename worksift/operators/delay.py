"""Delay model: will a young work still be open later, judged on an older cohort."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksift import config
from worksift.plans.ranking import global_rank, running_totals
from worksift.plans.storage import written

MODEL_VERSION = "delay_logistic_v1"
NUMERIC = ["log_sanctioned", "agency_prior", "sanction_month"]
EXPOSURE = "exposure_months"
CATEGORICAL = ["work_category", "state"]
_FEW = "(few)"


def labelled(works: DataFrame) -> DataFrame:
    return works.where(F.col("sanction_date").isNotNull()).withColumn(
        "y", (F.coalesce(F.col("completion_status"), F.lit("")) != "Completed").cast("int")
    )


def cohort_dates(as_of: Column) -> dict[str, Column]:
    """First day, train cut-off and last day: 26, 20 and 17 months before."""
    return {name: F.add_months(as_of, -months) for name, months in (("start", 26), ("cutoff", 20), ("end", 17))}


def delay_cohort(works: DataFrame, as_of: Column) -> DataFrame:
    """Works of the cohort with their label and ``part``: ``train`` before the cut-off."""
    d = cohort_dates(as_of)
    rows = labelled(works).where(F.col("sanction_date").between(d["start"], d["end"]))
    return rows.withColumn("part", F.when(F.col("sanction_date") < d["cutoff"], "train").otherwise("test"))


def agency_prior(history: DataFrame) -> DataFrame:
    """Smoothed mean label per agency; the null row is the rate over the whole history, which
    unknown agencies take."""
    pseudo = config.PRIOR_SMOOTHING
    overall = history.agg(F.avg(F.col("y").cast("double")).alias("rate"))
    agencies = history.where(F.col("implementing_agency").isNotNull()).groupBy("implementing_agency").agg(
        F.sum("y").alias("_y"), F.count("*").alias("_n")
    )
    prior = agencies.crossJoin(F.broadcast(overall)).select(  # one row
        "implementing_agency",
        ((F.col("_y") + F.col("rate") * pseudo) / (F.col("_n") + pseudo)).alias("agency_prior"),
    )
    return prior.unionByName(
        overall.select(F.lit(None).cast("string").alias("implementing_agency"), F.col("rate").alias("agency_prior"))
    )


def delay_features(rows: DataFrame, prior: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Adds the numeric features; exposure only when ``as_of`` is given."""
    overall = prior.where(F.col("implementing_agency").isNull()).select(F.col("agency_prior").alias("_rate"))
    known = prior.where(F.col("implementing_agency").isNotNull())
    out = rows.join(written(known, "prior"), "implementing_agency", "left").crossJoin(F.broadcast(overall))  # one row
    columns = {
        "agency_prior": F.coalesce("agency_prior", "_rate"),
        "log_sanctioned": F.log1p(F.coalesce("sanctioned_amount_inr", F.lit(0.0))),
        "sanction_month": F.month("sanction_date").cast("double"),
    }
    if as_of is not None:
        columns[EXPOSURE] = F.round(F.datediff(as_of, "sanction_date") / 30.44, 1)
    return out.withColumns(columns).drop("_rate")


class DelayPreparation:
    """Scaling and category columns learned from a training set.

    Categories and states with few rows share one column; a value never seen gives all zeros.
    The learned lists are as long as the categories and states, not the data.
    """

    def __init__(self, train: DataFrame, numeric: list[str]):
        self.numeric = numeric
        stats = train.agg(
            *[fn(c).alias(f"{label}_{c}") for c in numeric for label, fn in (("mean", F.avg), ("std", F.stddev_pop))]
        ).first()
        self.scale = {c: (stats[f"mean_{c}"], stats[f"std_{c}"] or 1.0) for c in numeric}
        self.values = {}
        for c in CATEGORICAL:
            counts = train.groupBy(c).agg(F.count("*").alias("n"))
            few = F.when(F.col("n") < config.MIN_CATEGORY_ROWS, F.lit(_FEW)).otherwise(F.col(c))
            self.values[c] = [
                (r[c], r["shown"]) for r in counts.select(c, few.alias("shown")).orderBy(c).collect()
            ]

    def apply(self, rows: DataFrame) -> DataFrame:
        out = rows
        for c in self.numeric:
            mean, std = self.scale[c]
            out = out.withColumn(f"_{c}", (F.col(c) - mean) / std)
        for c in CATEGORICAL:
            shown = reduce(lambda w, v: w.when(F.col(c).eqNullSafe(F.lit(v[0])), v[1]), self.values[c], F)
            out = out.withColumn(f"_{c}", shown.otherwise("(unseen)") if self.values[c] else F.lit("(unseen)"))
        return out

    def stages(self) -> list:
        names = [f"_{c}" for c in CATEGORICAL]
        return [
            StringIndexer(inputCols=names, outputCols=[n + "_i" for n in names], handleInvalid="keep"),
            OneHotEncoder(inputCols=[n + "_i" for n in names], outputCols=[n + "_v" for n in names], dropLast=False),
            VectorAssembler(inputCols=[f"_{c}" for c in self.numeric] + [n + "_v" for n in names], outputCol="features"),
        ]


class DelayModel:
    """L2 logistic regression (C = 1) with its preparation."""

    def __init__(self, train: DataFrame, numeric: list[str] = NUMERIC):
        train = written(train, "train")
        self.prepare = DelayPreparation(train, numeric)
        n = max(train.count(), 1)
        logistic = LogisticRegression(
            labelCol="y", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-9
        )
        self.model = Pipeline(stages=[*self.prepare.stages(), logistic]).fit(self.prepare.apply(train))
        self.train = train

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``score``, a probability, and ``margin``, its log odds."""
        scored = self.model.transform(self.prepare.apply(rows))
        return scored.withColumns(
            {"score": vector_to_array("probability")[1], "margin": vector_to_array("rawPrediction")[1]}
        ).select(*rows.columns, "score", "margin")

    def names(self) -> list[str]:
        """The features in the order of the weights."""
        names = list(self.prepare.numeric)
        for c, values in zip(CATEGORICAL, self.model.stages[0].labelsArray):
            names += [f"{c}_{v}" for v in values] + [f"{c}_(unseen)"]
        return names

    def coefficients(self) -> list[tuple[str, float]]:
        """Feature name and weight, the largest first."""
        weights = self.model.stages[-1].coefficients.toArray()
        return sorted(zip(self.names(), weights.tolist()), key=lambda p: -abs(p[1]))

    def gradient(self) -> DataFrame:
        """``feature, total, squares, positives, gradient``: sums of each feature, its square and its
        product with the label over the training rows, and the slope of the penalised loss in its
        weight, which is 0 at the optimum. ``(intercept)`` has no penalty. One pass, partial sums per task."""
        scored = self.model.transform(self.prepare.apply(self.train))
        values = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))
        rows = scored.select("y", vector_to_array("probability")[1].alias("p"), F.posexplode(values).alias("at", "x"))
        sums = rows.groupBy("at").agg(
            F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"),
            F.sum(F.col("x") * F.col("y")).alias("positives"), F.sum((F.col("p") - F.col("y")) * F.col("x")).alias("slope"),
            F.count("*").alias("n"),
        )
        fitted = self.model.stages[-1]
        weights = [*zip(self.names(), fitted.coefficients.toArray().tolist(), strict=True), ("(intercept)", 0.0)]
        known = self.train.sparkSession.createDataFrame([(k, name, w) for k, (name, w) in enumerate(weights)], "at int, feature string, weight double")
        return sums.join(known, "at").select(  # a row per feature
            "feature", "total", "squares", "positives", ((F.col("slope") + F.col("weight")) / F.col("n")).alias("gradient")
        )


def delay_metrics(scored: DataFrame) -> DataFrame:
    """ROC-AUC, average precision, base rate and lift in the top tenth of ``work_id, y, score``.

    Rows are counted per distinct score; running totals over the scores give both curves. Ties in
    the top tenth go by work id.
    """
    by_score = scored.groupBy("score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    ranked = global_rank(by_score, [F.col("score").desc()], "_order")
    upto = running_totals(ranked, "_order", {"tp": "pos", "fp": "neg"})
    totals = upto.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.count("*").alias("scores"))
    pairs = F.col("pos") * (F.col("N") - F.col("fp")) + F.col("pos") * F.col("neg") / 2
    step = F.col("pos") / F.nullif(F.col("P"), F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp"))
    curves = upto.crossJoin(F.broadcast(totals)).agg(  # one row
        F.when(F.max("scores") > 1, F.sum(pairs) / F.nullif(F.max("P") * F.max("N"), F.lit(0))).otherwise(0.5).alias("roc_auc"),
        F.sum(step).alias("average_precision"),
        (F.max("P") / F.nullif(F.max("P") + F.max("N"), F.lit(0))).alias("base_rate"),
        F.greatest(F.lit(1), F.floor((F.max("P") + F.max("N")) * 0.10)).alias("_k"),
    )
    places = global_rank(scored.select("work_id", "y", "score"), [F.col("score").desc(), F.col("work_id")], "_place")
    top = places.crossJoin(F.broadcast(curves.select("_k"))).where(F.col("_place") <= F.col("_k"))
    lift = top.agg(F.avg(F.col("y").cast("double")).alias("_top"))
    return curves.crossJoin(F.broadcast(lift)).select(  # single rows
        *[F.round(c, 3).alias(c) for c in ("roc_auc", "average_precision", "base_rate")],
        F.round(F.col("_top") / F.nullif(F.col("base_rate"), F.lit(0.0)), 3).alias("lift_at_10"),
    )


def _train_test(works: DataFrame, as_of: Column, exposure: bool = False) -> tuple[DataFrame, DataFrame]:
    d = cohort_dates(as_of)
    history = labelled(works).where(F.col("sanction_date") < d["cutoff"])
    cohort = delay_features(delay_cohort(works, as_of), agency_prior(history), as_of if exposure else None)
    cohort = written(cohort, "cohort")
    return cohort.where(F.col("part") == "train"), cohort.where(F.col("part") == "test")


def delay_model(works: DataFrame, as_of: Column) -> DataFrame:
    """Scores of the cohort's test part by the model fitted on its train part."""
    train, test = _train_test(works, as_of)
    return DelayModel(train).score(test).select("work_id", "y", "score")


def delay_gradient(works: DataFrame, as_of: Column) -> DataFrame:
    """The fitted model's sums and slopes over its training rows, by feature."""
    return DelayModel(_train_test(works, as_of)[0]).gradient()


def young_works(works: DataFrame, as_of: Column) -> DataFrame:
    """Labelled works under implementation, sanctioned in the last year: those a watch list scores."""
    age = F.datediff(as_of, "sanction_date")
    return labelled(works).where(F.col("completion_status").isin(*config.UNDER_IMPLEMENTATION) & age.between(0, 365))


def watch_list(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(counts, watch)`` of ``work_id, score``: the first tenth, rounded up, the highest score first and
    then the smaller id."""
    ranked = global_rank(scored.select("work_id", "score"), [F.col("score").desc(), F.col("work_id")], "place")
    counts = ranked.agg(
        F.count("*").alias("scored_n"),
        F.ceil(F.lit(config.WATCH_SHARE) * F.count("*").cast("double")).cast("bigint").alias("watch_n"),
    )
    watch = ranked.crossJoin(F.broadcast(counts)).where(F.col("place") <= F.col("watch_n"))  # one row
    return counts, watch.select("work_id", "score", "place")


def delay_watch(works: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """``(artifact, watch)``: one row of version, cohort, features, metrics and status, and the ranked
    watch list. Below the quality bar the list is empty; above it the model is refitted on the whole
    cohort."""
    train, test = _train_test(works, as_of)
    scores = DelayModel(train).score(test).select("work_id", "y", "score")
    sizes = train.agg(F.count("*").alias("train_n")).crossJoin(F.broadcast(test.agg(F.count("*").alias("test_n"))))  # single rows
    metrics = written(delay_metrics(written(scores, "scores")).crossJoin(F.broadcast(sizes)), "metrics")
    got = metrics.first()
    # A figure that cannot be computed, as with one class only, is below the bar.
    shipped = (got["roc_auc"] or 0) >= config.MIN_TEST_AUC and (got["lift_at_10"] or 0) >= config.MIN_TEST_LIFT
    d = cohort_dates(as_of)
    artifact = metrics.withColumns(
        {
            "model_version": F.lit(MODEL_VERSION),
            "data_as_of": as_of,
            "status": F.lit("shipped" if shipped else "not_shipped"),
            **{f"cohort_{name}": day for name, day in d.items()},
            "numeric": F.array(*[F.lit(c) for c in NUMERIC]),
            "categorical": F.array(*[F.lit(c) for c in CATEGORICAL]),
        }
    )
    if not shipped:
        empty = works.where(F.lit(False)).select("work_id", F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("place"))
        return artifact.withColumns({"scored_n": F.lit(0).cast("bigint"), "watch_n": F.lit(0).cast("bigint")}), empty
    prior = agency_prior(labelled(works).where(F.col("sanction_date") <= d["end"]))
    model = DelayModel(delay_features(delay_cohort(works, as_of), prior))
    scored = model.score(delay_features(young_works(works, as_of), prior))
    counts, watch = watch_list(scored)
    return artifact.crossJoin(F.broadcast(counts)), watch  # single rows


def delay_model_comparison(works: DataFrame, as_of: Column, folds: int = 5) -> DataFrame:
    """Baseline, logistic, boosted trees and calibrated logistic on the same cohort."""
    train, test = _train_test(works, as_of, exposure=True)
    numeric = [NUMERIC[0], EXPOSURE, *NUMERIC[1:]]
    base = train.agg(F.avg(F.col("y").cast("double")).alias("score"))
    scores = {"baseline": test.crossJoin(F.broadcast(base)).select("work_id", "y", "score")}  # one row

    logistic = DelayModel(train, numeric)
    scores["logistic"] = logistic.score(test).select("work_id", "y", "score")

    prepare = DelayPreparation(train, numeric)
    boosted = Pipeline(
        stages=[*prepare.stages(), GBTClassifier(labelCol="y", maxIter=50, stepSize=0.1, maxDepth=5, seed=42)]
    ).fit(prepare.apply(train))
    scores["boosted"] = boosted.transform(prepare.apply(test)).select(
        "work_id", "y", vector_to_array("probability")[1].alias("score")
    )

    # Calibration: a one-variable logistic on the margins of rows left out of each fold.
    fold = F.pmod(F.xxhash64("work_id"), F.lit(folds))
    calibrated = None
    for k in range(folds):
        part = DelayModel(train.where(fold != k), numeric)
        held = part.score(train.where(fold == k))
        assemble = VectorAssembler(inputCols=["margin"], outputCol="m")
        sigmoid = LogisticRegression(labelCol="y", featuresCol="m", regParam=0.0, standardization=False)
        fitted = sigmoid.fit(assemble.transform(held))
        one = fitted.transform(assemble.transform(part.score(test))).select("work_id", "y", vector_to_array("probability")[1].alias("score"))
        calibrated = one if calibrated is None else calibrated.unionByName(one)
    scores["calibrated"] = calibrated.groupBy("work_id", "y").agg(F.avg("score").alias("score"))

    rows = None
    for name, scored in scores.items():
        scored = written(scored, name)
        brier = scored.agg(F.round(F.avg(F.pow(F.col("score") - F.col("y"), F.lit(2.0))), 3).alias("brier"))
        one = delay_metrics(scored).crossJoin(F.broadcast(brier)).withColumn("model", F.lit(name))  # single rows
        rows = one if rows is None else rows.unionByName(one)
    return rows
