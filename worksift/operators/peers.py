"""Peer groups: works of one category, state and financial year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksift.config import SETTINGS
from worksift.functions.dates import financial_year
from worksift.plans.ranking import exact_quantiles
from worksift.plans.storage import written

PEER_KEYS = ["work_category", "state", "financial_year"]


def with_financial_year(works: DataFrame) -> DataFrame:
    return works.withColumn("financial_year", financial_year(F.col("sanction_date"), F.col("last_updated")))


def has_peer_key() -> Column:
    return (
        (F.length("work_category") > 0) & (F.length("state") > 0) & F.col("financial_year").isNotNull()
    )


def spend_ratio() -> Column:
    """Spend over sanction, null where either is missing or nothing was sanctioned."""
    return F.when(
        F.col("sanctioned_amount_inr") != 0,
        F.col("expenditure_amount_inr") / F.col("sanctioned_amount_inr"),
    )


def peer_groups(works: DataFrame) -> DataFrame:
    """Size, cost and spend-ratio statistics of every group, of any size.

    Means and deviations combine map-side; quartiles come from bracketed positions, so one very
    large group is never brought together.
    """
    cost = "sanctioned_amount_inr"
    keyed = (
        with_financial_year(works)
        .where(has_peer_key())
        .select(*PEER_KEYS, cost, spend_ratio().alias("ratio"))
    )
    zero = F.lit(0.0)
    moments = keyed.groupBy(*PEER_KEYS).agg(
        F.count("*").alias("n"),
        *[
            F.coalesce(fn(column), zero).alias(f"{label}_{name}")
            for name, column in (("cost", cost), ("ratio", "ratio"))
            for label, fn in (("mean", F.avg), ("std", F.stddev_pop))
        ],
    )
    quartiles = exact_quantiles(keyed, PEER_KEYS, cost, {"q1_cost": 1, "median_cost": 2, "q3_cost": 3})
    # Groups whose amounts are all missing have no quartiles.
    joined = moments.join(quartiles, PEER_KEYS, "left").fillna(0.0, ["q1_cost", "median_cost", "q3_cost"])
    label = F.concat(
        F.col("work_category"), F.lit(" works, "), F.col("state"), F.lit(", "), F.col("financial_year")
    )
    return joined.withColumn("label", label)


def peer_gate(works: DataFrame, groups: DataFrame) -> DataFrame:
    """Works with their group's statistics under ``peer``; null unless the group has at least
    ``min_peer_group_n`` members. Groups are never widened."""
    passing = groups.where(F.col("n") >= SETTINGS.min_peer_group_n)
    stats = [c for c in groups.columns if c not in PEER_KEYS]
    peer = passing.select(*PEER_KEYS, F.struct(*stats).alias("peer"))
    return with_financial_year(works).join(peer, PEER_KEYS, "left")


def gated(works: DataFrame) -> DataFrame:
    """``peer_gate`` against the works' own groups. The groups (categories x states x years) are
    written first, so the join knows their real size."""
    return peer_gate(works, written(peer_groups(works), "peers"))


def peer_coverage(groups: DataFrame) -> DataFrame:
    passing = F.col("n") >= SETTINGS.min_peer_group_n
    return groups.agg(
        F.count("*").alias("groups"),
        F.count_if(passing).alias("groups_passing"),
        F.coalesce(F.sum(F.when(passing, F.col("n"))), F.lit(0)).alias("works_covered"),
    )
