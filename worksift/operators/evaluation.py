"""Scheme totals and how well the ranking targets the inspection quota."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksift.config import FLAGS
from worksift.functions.money import exact_sum
from worksift.operators.serve import under_implementation
from worksift.plans.ranking import global_rank


def scheme_totals(works: DataFrame) -> DataFrame:
    sanctioned = exact_sum(F.col("sanctioned_amount_inr"))
    spent = exact_sum(F.col("expenditure_amount_inr"))
    totals = works.agg(
        F.count("*").alias("works"),
        F.count_if(under_implementation()).alias("under_implementation"),
        F.round(sanctioned, 2).alias("sanctioned"),
        F.round(spent, 2).alias("spent"),
        F.round(sanctioned - spent, 2).alias("unspent"),
    )
    return totals.withColumn("unspent_percent", F.col("unspent") / F.nullif(F.col("sanctioned"), F.lit(0.0)) * 100)


def detector_counts(scored: DataFrame) -> DataFrame:
    row = scored.agg(
        F.array(
            F.struct(F.lit("any_flag").alias("flag"), F.count_if(F.size("flags") > 0).alias("works")),
            *[F.struct(F.lit(f).alias("flag"), F.count_if(F.array_contains("flags", f)).alias("works")) for f in FLAGS],
        ).alias("_f")
    )
    return row.select(F.explode("_f").alias("f")).select("f.*").where(
        (F.col("flag") == "any_flag") | (F.col("works") > 0)
    )


def targeting_performance(merged: DataFrame) -> DataFrame:
    """The first ten percent of the ranked population against the whole of it."""
    pool = merged.where(under_implementation()).select(
        "inspection_rank",
        F.size("flags").alias("n_flags"),
        F.col("sanctioned_amount_inr").alias("sanctioned"),
        (F.col("sanctioned_amount_inr") - F.col("expenditure_amount_inr")).alias("unspent"),
    )
    ranked = global_rank(pool, [F.col("inspection_rank")], "place")
    size = ranked.agg(F.bround(F.count("*") * 0.10, 0).cast("bigint").alias("quota"))
    rows = ranked.crossJoin(F.broadcast(size))  # one row
    top, many = F.col("place") <= F.col("quota"), F.col("n_flags") >= 2
    flagged = F.col("n_flags") > 0
    rupees = lambda c, cond: F.round(exact_sum(F.when(cond, F.col(c))), 2)
    figures = rows.agg(
        F.count("*").alias("pool"),
        F.max("quota").alias("quota"),
        F.count_if(flagged).alias("flagged_in_pool"),
        F.count_if(flagged & top).alias("flagged_in_quota"),
        F.count_if(many).alias("multi_flag_in_pool"),
        F.count_if(many & top).alias("multi_flag_in_quota"),
        rupees("sanctioned", F.lit(True)).alias("sanctioned_in_pool"),
        rupees("sanctioned", top).alias("sanctioned_in_quota"),
        rupees("unspent", F.lit(True)).alias("unspent_in_pool"),
        rupees("unspent", top).alias("unspent_in_quota"),
    )
    share = lambda top, bottom: top / F.nullif(bottom, F.lit(0))
    base = share(F.col("flagged_in_pool"), F.col("pool"))
    precision = share(F.col("flagged_in_quota"), F.col("quota"))
    return figures.withColumns({"base_rate": base, "precision": precision, "lift": share(precision, base)})
