"""The four rule detectors, as columns on works that already carry their peer group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksift.config import FLAGS, SETTINGS
from worksift.functions.dates import months_elapsed
from worksift.functions.sentences import sentence
from worksift.plans.storage import written


def _amounts() -> tuple[Column, Column]:
    """Sanctioned and spent, missing ones as 0."""
    zero = F.lit(0.0)
    return F.coalesce("sanctioned_amount_inr", zero), F.coalesce("expenditure_amount_inr", zero)


def _z(value: Column, mean: str, std: str) -> Column:
    return F.when(F.col(std) > 0, (value - F.col(mean)) / F.col(std))


def cost_outlier(gated: DataFrame) -> DataFrame:
    """Adds ``cost_variant`` (null when quiet) and ``cost_multiple`` of the peer median."""
    amount, median = F.col("sanctioned_amount_inr"), F.col("peer.median_cost")
    fired = _z(amount, "peer.mean_cost", "peer.std_cost") > SETTINGS.cost_z
    return gated.withColumns(
        {
            "cost_variant": F.when(fired, F.when(median <= 0, "no_multiple").otherwise("default")),
            "cost_multiple": F.when(fired & (median > 0), amount / median),
        }
    )


def stalled_work(gated: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``stalled_variant``, ``stalled_months`` and ``stalled_percent``. With a sanction date
    the clock runs from it; without one, an unspent work counts from its last update."""
    sanctioned, spent = _amounts()
    dated = F.col("sanction_date").isNotNull()
    months = months_elapsed(F.coalesce("sanction_date", "last_updated"), as_of)
    open_status = F.col("peer").isNotNull() & F.col("completion_status").isin("In Progress", "Sanctioned")
    old = open_status & (months >= SETTINGS.stall_months)
    percent = F.when(sanctioned > 0, spent / sanctioned * 100)
    variant = (
        F.when(old & dated & (sanctioned > 0) & (spent <= 0), "zero_spend")
        .when(old & dated & (percent < SETTINGS.stall_spend_percent), "part_spend")
        .when(old & ~dated & (spent <= 0), "no_update")
    )
    return gated.withColumns(
        {
            "stalled_variant": variant,
            "stalled_months": F.when(variant.isNotNull(), months),
            "stalled_percent": F.when(variant == "part_spend", percent),
        }
    )


def expenditure_mismatch(gated: DataFrame) -> DataFrame:
    """Adds ``mismatch_variant`` and ``mismatch_percent_over``. The spend ratio must stand out
    among peers, and then exceed the sanction, or equal it while the work is open."""
    sanctioned, spent = _amounts()
    ratio = F.when(F.col("peer").isNotNull() & (sanctioned > 0), spent / sanctioned)
    z = _z(ratio, "peer.mean_ratio", "peer.std_ratio")
    outside = (F.col("peer.std_ratio") <= 0) | (z > SETTINGS.ratio_z)
    full = (F.abs(ratio - 1) < 1e-9) & ~F.col("completion_status").eqNullSafe(F.lit("Completed"))
    variant = F.when(outside & (ratio > 1), "over_sanction").when(outside & full, "full_spend_open")
    return gated.withColumns(
        {
            "mismatch_variant": variant,
            "mismatch_percent_over": F.when(variant == "over_sanction", (ratio - 1) * 100),
        }
    )


def _spans(works: DataFrame, party: str, spans: dict[str, str]) -> DataFrame:
    """Works and distinct-value counts per party, with a z-score over all parties.

    The distinct (party, MP, constituency) triples are counted first, so a party holding a third
    of all works is already small when it is brought together.
    """
    columns = list(spans.values())
    triples = works.where(F.length(party) > 0).groupBy(party, *columns).agg(F.count("*").alias("works"))
    per_party = triples.groupBy(party).agg(
        F.sum("works").alias("works"),
        *[F.countDistinct(c).alias(f"{name}_count") for name, c in spans.items()],
    )
    overall = per_party.agg(
        *[fn(f"{name}_count").alias(f"{label}_{name}") for name in spans for label, fn in (("mean", F.avg), ("std", F.stddev_pop))]
    )
    scored = per_party.crossJoin(F.broadcast(overall))  # one row
    for name in spans:
        z = _z(F.col(f"{name}_count"), f"mean_{name}", f"std_{name}")
        unusual = (F.col(f"{name}_count") >= SETTINGS.concentration_min_span) & (z > SETTINGS.concentration_z)
        scored = scored.withColumn(
            f"{name}_unusual",
            F.coalesce(unusual, F.lit(False)) & (F.col("works") >= SETTINGS.concentration_min_works),
        ).drop(f"mean_{name}", f"std_{name}")
    return scored


def concentrated_agencies(works: DataFrame) -> DataFrame:
    spans = _spans(works, "implementing_agency", {"mp": "mp_name", "district": "constituency"})
    return spans.where(F.col("mp_unusual") | F.col("district_unusual"))


def concentrated_vendors(works: DataFrame) -> DataFrame:
    return _spans(works, "vendor_name", {"district": "constituency"}).where(F.col("district_unusual"))


def agency_concentration(works: DataFrame) -> DataFrame:
    """Adds ``concentration_variant``, ``concentration_mps`` and ``concentration_districts``, from
    spans over all works. An agency's finding goes before a vendor's."""
    both = F.col("mp_unusual") & F.col("district_unusual")
    agencies = concentrated_agencies(works).select(
        "implementing_agency",
        F.struct(
            F.when(both, "districts_and_mps").otherwise("mps").alias("variant"),
            F.col("mp_count").alias("mps"),
            F.when(both, F.col("district_count")).alias("districts"),
        ).alias("_agency"),
    )
    vendors = concentrated_vendors(works).select(
        "vendor_name",
        F.struct(
            F.lit("vendor").alias("variant"),
            F.lit(None).cast("bigint").alias("mps"),
            F.col("district_count").alias("districts"),
        ).alias("_vendor"),
    )
    finding = F.coalesce("_agency", "_vendor")
    return (
        works.join(written(agencies, "agencies"), "implementing_agency", "left")
        .join(written(vendors, "vendors"), "vendor_name", "left")
        .withColumns(
            {
                "concentration_variant": finding["variant"],
                "concentration_mps": finding["mps"],
                "concentration_districts": finding["districts"],
            }
        )
        .drop("_agency", "_vendor")
    )


def detect(works: DataFrame, as_of: Column) -> DataFrame:
    """Works with their peer group and the findings of all four detectors."""
    from worksift.operators.peers import gated

    found = gated(agency_concentration(works))
    return expenditure_mismatch(stalled_work(cost_outlier(found), as_of))


def _variants() -> dict[str, Column]:
    """The fired variant of each flag; no peer group, no flag, concentration included."""
    return {
        "cost_outlier": F.col("cost_variant"),
        "stalled_work": F.col("stalled_variant"),
        "expenditure_mismatch": F.col("mismatch_variant"),
        "agency_concentration": F.when(F.col("peer").isNotNull(), F.col("concentration_variant")),
    }


def flag_assemble(found: DataFrame) -> DataFrame:
    """Adds ``flags`` in fixed order, ``why_flagged`` by flag, and ``peer_group`` when flagged."""
    values = {
        "multiple": F.col("cost_multiple"),
        "category": F.col("work_category"),
        "months": F.col("stalled_months"),
        "percent_spent": F.col("stalled_percent"),
        "percent_over": F.col("mismatch_percent_over"),
        "mp_count": F.col("concentration_mps"),
        "district_count": F.col("concentration_districts"),
    }
    variant = _variants()
    flags = F.array_compact(F.array(*[F.when(variant[f].isNotNull(), F.lit(f)) for f in FLAGS]))
    why = [
        F.when(variant[f].isNotNull(), F.struct(F.lit(f), sentence(variant[f], values))) for f in FLAGS
    ]
    return found.withColumn("flags", flags).withColumns(
        {
            "why_flagged": F.map_from_entries(F.array_compact(F.array(*why))),
            "peer_group": F.when(
                F.size("flags") > 0,
                F.struct(F.col("peer.label").alias("label"), F.col("peer.n").alias("n")),
            ),
        }
    )
