"""Guideline checks and inspection quotas over works under implementation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksift.config import PENDENCY_KINDS, THIRD_PARTY_FULL_INR, THIRD_PARTY_HALF_INR
from worksift.functions.money import exact_sum, quota_for
from worksift.operators.serve import pendency_condition, under_implementation
from worksift.plans.ranking import exact_quantiles

GROUP_COLUMNS = {
    "state": "state",
    "district_authority": "implementing_district_authority",
    "constituency": "constituency",
}


def population(works: DataFrame) -> DataFrame:
    return works.where(under_implementation())


def quota_by_authority(works: DataFrame) -> DataFrame:
    """Quota of every known authority over its own population."""
    authority = "implementing_district_authority"
    return (
        population(works)
        .where(F.col(authority).isNotNull())
        .groupBy(authority)
        .agg(F.count("*").alias("population_n"))
        .withColumn("quota_n", quota_for(F.col("population_n")))
    )


def quota_sum(works: DataFrame) -> DataFrame:
    return quota_by_authority(works).agg(
        F.count("*").alias("district_authority_n"), F.coalesce(F.sum("quota_n"), F.lit(0)).alias("quota_sum")
    )


def pendency_kinds(works: DataFrame, as_of: Column) -> DataFrame:
    """Count and rupees of each check, in one pass. The checks overlap and are never added up."""
    amount = F.col("sanctioned_amount_inr")
    every = {"population": F.lit(True), **{k: pendency_condition(k, as_of) for k in PENDENCY_KINDS}}
    row = population(works).agg(
        F.array(
            *[
                F.struct(
                    F.lit(kind).alias("kind"),
                    F.count_if(condition).alias("count"),
                    F.round(exact_sum(F.when(condition, amount)), 2).alias("sanctioned_inr"),
                )
                for kind, condition in every.items()
            ]
        ).alias("_k")
    )
    return row.select(F.explode("_k").alias("k")).select("k.*")


def pendency_median(works: DataFrame) -> DataFrame:
    """Median days from recommendation to sanction over works with both dates, half to even."""
    days = population(works).select(F.datediff("sanction_date", "recommendation_date").alias("days"))
    median = exact_quantiles(days, [], "days", {"median": 2})
    return median.agg(F.bround(F.max("median"), 0).cast("bigint").alias("median_days_to_sanction"))


def pendency_groups(works: DataFrame, group_by: str, as_of: Column) -> DataFrame:
    """Population, the three counts and the quota per group, in one pass."""
    column = F.col(GROUP_COLUMNS[group_by])
    return (
        population(works)
        .where(column.isNotNull())
        .groupBy(column.alias("group"))
        .agg(
            F.count("*").alias("population_n"),
            *[F.count_if(pendency_condition(k, as_of)).alias(k) for k in PENDENCY_KINDS],
        )
        .withColumn("quota_n", quota_for(F.col("population_n")))
        .orderBy(F.col("population_n").desc(), "group")
    )


def third_party(works: DataFrame) -> DataFrame:
    """Works large enough for third-party inspection: all of the largest, half of the next."""
    amount = F.col("sanctioned_amount_inr")
    counts = population(works).agg(
        F.count_if(amount >= THIRD_PARTY_FULL_INR).alias("at_or_above_25_lakh"),
        F.count_if((amount >= THIRD_PARTY_HALF_INR) & (amount < THIRD_PARTY_FULL_INR)).alias("between_15_and_25_lakh"),
    )
    half = F.ceil(F.col("between_15_and_25_lakh") / 2).cast("bigint")
    return counts.withColumn("required_n", F.col("at_or_above_25_lakh") + half)


def early_warning_scope(works: DataFrame, watch: DataFrame) -> DataFrame:
    return population(works).join(watch.select("work_id"), "work_id", "left_semi").agg(
        F.count("*").alias("early_warning_n")
    )
