"""Read queries over the works and scored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worksift.config import (
    COMPLETION_DAYS_LIMIT,
    FLAGS,
    MAX_PAGE_SIZE,
    NO_PAYMENT_DAYS,
    SANCTION_DAYS_LIMIT,
    UNDER_IMPLEMENTATION,
)
from worksift.functions.dates import calendar_months, days_stale, financial_year
from worksift.functions.money import exact_sum, quota_for
from worksift.plans.ranking import block_ranks, dense_position, position_blocks
from worksift.plans.storage import written
from worksift.sources.contract import WORKS_SCHEMA

# The columns a text search looks in.
SEARCH_COLUMNS = (
    "work_id",
    "constituency",
    "implementing_district_authority",
    "implementing_agency",
    "mp_name",
    "state",
    "vendor_name",
    "vendor_id",
    "work_description",
    "activity_name",
)
SCORED_COLUMNS = ("inspection_rank", "risk_score", "flags", "why_flagged", "peer_group")


@dataclass(frozen=True)
class WorksQuery:
    scope: str = "all"
    states: tuple[str, ...] = ()
    year: str | None = None
    category: str | None = None
    flag: str | None = None
    vendor_id: str | None = None
    district_authority: str | None = None
    constituency: str | None = None
    pendency: str | None = None
    q: str | None = None
    page: int = 1
    page_size: int = 50

    def __post_init__(self) -> None:
        if self.page < 1 or not 1 <= self.page_size <= MAX_PAGE_SIZE:
            raise ValueError(f"page from 1, page_size from 1 to {MAX_PAGE_SIZE}; got {self.page}, {self.page_size}")


def under_implementation() -> Column:
    return F.col("completion_status").isin(*UNDER_IMPLEMENTATION)


def pendency_condition(kind: str, as_of: Column) -> Column:
    """One of the three monthly pendency checks on a works row."""
    since_sanction = F.datediff(as_of, F.col("sanction_date"))
    if kind == "late_sanction":
        condition = F.datediff("sanction_date", "recommendation_date") > SANCTION_DAYS_LIMIT
    elif kind == "open_past_one_year":
        condition = since_sanction > COMPLETION_DAYS_LIMIT
    elif kind == "no_payment_90_days":
        unpaid = F.coalesce("expenditure_amount_inr", F.lit(0.0)) == 0
        condition = (since_sanction > NO_PAYMENT_DAYS) & unpaid
    else:
        raise ValueError(f"unknown pendency kind: {kind!r}")
    return F.coalesce(condition, F.lit(False))


def works_merged(works: DataFrame, scored: DataFrame) -> DataFrame:
    """Works with their score, 27 columns."""
    return works.join(scored, "work_id").select(*WORKS_SCHEMA, *SCORED_COLUMNS)


def works_search(rows: DataFrame, needle: str) -> DataFrame:
    """Case-insensitive literal match in any search column; ``%`` and ``_`` are themselves."""
    found = F.lit(False)
    for name in SEARCH_COLUMNS:
        found = found | F.coalesce(F.contains(F.lower(name), F.lit(needle.lower())), F.lit(False))
    return rows.where(found)


def works_year_filter(rows: DataFrame, year: str) -> DataFrame:
    return rows.where(financial_year(F.col("sanction_date"), F.col("last_updated")) == year)


def works_filter(merged: DataFrame, query: WorksQuery, as_of: Column, watch: DataFrame | None = None) -> DataFrame:
    """Every filter of a works query, as conditions that reach the scan. ``watch`` is the
    early-warning list, when there is one to serve."""
    rows = merged
    guideline_kind = query.pendency is not None and query.pendency != "early_warning"
    if query.scope == "under_implementation" or guideline_kind:
        rows = rows.where(under_implementation())
    if query.states:
        rows = rows.where(F.col("state").isin(*query.states))
    for name, value in (
        ("work_category", query.category),
        ("vendor_id", query.vendor_id),
        ("implementing_district_authority", query.district_authority),
        ("constituency", query.constituency),
    ):
        if value:
            rows = rows.where(F.col(name) == value)
    if query.flag:
        rows = rows.where(F.array_contains("flags", query.flag))
    if query.pendency == "early_warning":
        rows = rows.where(F.lit(False)) if watch is None else rows.join(watch.select("work_id"), "work_id", "left_semi")
    elif query.pendency:
        rows = rows.where(pendency_condition(query.pendency, as_of))
    if query.q:
        rows = works_search(rows, query.q)
    if query.year:
        rows = works_year_filter(rows, query.year)
    return rows


def _queue(filtered: DataFrame) -> DataFrame:
    return filtered.select("work_id", "inspection_rank", (F.size("flags") > 0).alias("flagged"))


def filtered_rank(filtered: DataFrame) -> DataFrame:
    """``work_id, flagged, display_rank, inside_quota``: place of each work in a filtered queue."""
    queue = _queue(filtered)
    blocks = position_blocks(queue, "inspection_rank")
    ranked = dense_position(queue, "inspection_rank", blocks, "display_rank")
    total = blocks.agg(quota_for(F.sum("rows")).alias("_quota"))
    return (
        ranked.crossJoin(F.broadcast(total))  # one row
        .withColumn("inside_quota", F.col("display_rank") <= F.col("_quota"))
        .drop("_quota")
    )


def works_stored(merged: DataFrame) -> DataFrame:
    """``merged`` written for serving: in inspection order, so that a range of ranks is a few row groups."""
    return written(merged.repartitionByRange("inspection_rank").sortWithinPartitions("inspection_rank"), "served")


def _rank_between(rows: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Rows of a range of ranks. Bounds are literals, so they reach the scan and skip row groups."""
    return rows.where(F.lit(False)) if low is None else rows.where(F.col("inspection_rank").between(low, high))


def works_page(
    merged: DataFrame, query: WorksQuery, as_of: Column, watch: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """One page in inspection order, and the counts that go with it.

    The filtered queue is counted per block of ranks. Only ranks of the blocks under the page, and of the
    one the quota ends in, are read again, two columns of them, and they give the page's first and last
    rank: the page is every filtered row between the two, which is one read of whole rows.
    ``works_stored`` keeps these ranges together.
    """
    filtered = works_filter(merged, query, as_of, watch)
    queue = _queue(filtered)
    blocks = written(position_blocks(queue, "inspection_rank", {"flagged": F.count_if("flagged")}), "blocks")
    first = (query.page - 1) * query.page_size
    end = F.col("start") + F.col("rows")
    place, rank = F.col("display_rank"), F.col("inspection_rank")

    def placed(some: DataFrame) -> DataFrame:
        """Places of the rows in some blocks (a run of them), only their ranks being read."""
        bounds = some.agg(F.min("block"), F.max("block")).first()
        low, high = (None, None) if bounds[0] is None else block_ranks(*bounds)
        return dense_position(_rank_between(queue, low, high), "inspection_rank", some, "display_rank")

    under = blocks.where((F.col("start") < first + query.page_size) & (end > first))
    inside = placed(under).where(place.between(first + 1, first + query.page_size))
    page = inside.agg(F.min(rank), F.max(rank)).first()
    # At most a page of rows: their order is one small window.
    rows = _rank_between(filtered, *page).withColumn(
        "display_rank", (F.row_number().over(Window.orderBy(rank)) + first).cast("bigint")
    )

    total = F.coalesce(F.sum("rows"), F.lit(0))
    counts = blocks.agg(
        total.alias("total"),
        F.ceil(total / query.page_size).cast("bigint").alias("total_pages"),
        quota_for(total).alias("quota_n"),
        F.coalesce(F.sum("flagged"), F.lit(0)).alias("flagged_total"),
    )
    if query.scope != "under_implementation":
        unknown = F.lit(None).cast("bigint")
        return rows, counts.withColumns({"quota_n": unknown, "flagged_beyond_quota": unknown})
    quota = F.broadcast(counts.select("quota_n"))  # one row
    after = blocks.crossJoin(quota).where(F.col("start") >= F.col("quota_n")).agg(
        F.coalesce(F.sum("flagged"), F.lit(0)).alias("_after")
    )
    split = blocks.crossJoin(quota).where((F.col("start") < F.col("quota_n")) & (end > F.col("quota_n")))
    within = placed(split).crossJoin(quota)
    rest = within.agg(F.count_if(F.col("flagged") & (place > F.col("quota_n"))).alias("_rest"))
    meta = counts.crossJoin(F.broadcast(after)).crossJoin(F.broadcast(rest))  # single rows
    return rows, meta.withColumn("flagged_beyond_quota", F.col("_after") + F.col("_rest")).drop("_after", "_rest")


def work_day_counts(rows: DataFrame, as_of: Column, watch: DataFrame | None = None) -> DataFrame:
    """Adds days to sanction, days since sanction, days stale and early-warning membership."""
    out = rows.withColumns(
        {
            "days_to_sanction": F.datediff("sanction_date", "recommendation_date"),
            "days_since_sanction": F.datediff(as_of, "sanction_date"),
            "days_stale": days_stale(F.col("last_updated"), as_of),
        }
    )
    if watch is None:
        return out.withColumn("early_warning", F.lit(False))
    marked = watch.select("work_id", F.lit(True).alias("_watched")).distinct()
    joined = out.join(marked, "work_id", "left")
    return joined.withColumn("early_warning", F.coalesce("_watched", F.lit(False))).drop("_watched")


def works_facets(merged: DataFrame) -> DataFrame:
    """``facet, value, detail, count`` over the population; flags that never fired count 0."""
    population = merged.where(under_implementation()).select(
        "state",
        "work_category",
        "implementing_district_authority",
        "constituency",
        "mp_name",
        financial_year(F.col("sanction_date"), F.col("last_updated")).alias("year"),
        "flags",
    )
    blank = F.lit(None).cast("string")

    def facet(name: str, value: str, detail: Column = blank, keep: Column | None = None) -> DataFrame:
        rows = population if keep is None else population.where(keep)
        return rows.groupBy(F.lit(name).alias("facet"), F.col(value).alias("value"), detail.alias("detail")).agg(
            F.count("*").alias("count")
        )

    authority = "implementing_district_authority"
    out = facet("state", "state")
    out = out.unionByName(facet("category", "work_category"))
    out = out.unionByName(facet("district_authority", authority, keep=F.col(authority).isNotNull()))
    out = out.unionByName(facet("constituency", "constituency", F.col("mp_name")))
    out = out.unionByName(facet("year", "year", keep=F.col("year").isNotNull()))
    fired = population.agg(
        F.array(
            *[F.struct(F.lit(f).alias("value"), F.count_if(F.array_contains("flags", f)).alias("count")) for f in FLAGS]
        ).alias("_f")
    )
    flags = fired.select(F.explode("_f").alias("f")).select(
        F.lit("flag").alias("facet"), F.col("f.value").alias("value"), blank.alias("detail"), F.col("f.count").alias("count")
    )
    return out.unionByName(flags)


def work_detail(merged: DataFrame, work_id: str, as_of: Column, context: DataFrame | None = None, watch: DataFrame | None = None) -> DataFrame:
    """One work with its day counts and, when given, the duplicate candidates it belongs to, a row for
    each (``place`` 1 is the newest); a work in none is one row without them."""
    row = work_day_counts(merged.where(F.col("work_id") == work_id), as_of, watch)
    if context is None:
        return row
    return row.join(context.where(F.col("work_id") == work_id), "work_id", "left")


def summary_figures(merged: DataFrame) -> DataFrame:
    """One row of headline figures. Idle means nothing spent and sanctioned over 12 calendar
    months before the newest update of any work."""
    newest = merged.agg(F.max("last_updated").alias("_newest"))
    rows = merged.crossJoin(F.broadcast(newest))  # one row
    inside = under_implementation()
    flagged = inside & (F.size("flags") > 0)
    idle = (
        inside
        & (F.col("expenditure_amount_inr") == 0)
        & (calendar_months(F.col("sanction_date"), F.col("_newest")) > 12)
    )
    amount = F.col("sanctioned_amount_inr")
    rupees = lambda condition: F.round(exact_sum(F.when(condition, amount)), 2)
    return rows.agg(
        F.count_if(inside).alias("works_under_implementation"),
        F.count_if(flagged).alias("flagged_count"),
        rupees(flagged).alias("total_flagged_amount_inr"),
        rupees(idle).alias("idle_beyond_12_months_amount_inr"),
        F.count("*").alias("total_works_all_statuses"),
        F.count_if(idle).alias("idle_work_count"),
        rupees(inside).alias("total_sanctioned_under_implementation_inr"),
        F.countDistinct(F.when(inside, F.col("state"))).alias("state_count"),
        F.countDistinct(F.when(inside, F.col("constituency"))).alias("constituency_count"),
    )


def summary_ratios(summary: DataFrame) -> DataFrame:
    works, flagged = F.col("works_under_implementation"), F.col("flagged_count")
    value, sanctioned = F.col("total_flagged_amount_inr"), F.col("total_sanctioned_under_implementation_inr")
    ratio = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
    return summary.select(
        (ratio(flagged, works) * 100).alias("flagged_percent"),
        (ratio(value, sanctioned) * 100).alias("value_flagged_percent"),
        ratio(value, flagged).alias("average_flagged_inr"),
    )


def early_warning_read(artifact: DataFrame, manifest: DataFrame) -> DataFrame:
    """The delay model's metrics, only when shipped and built for the manifest's as-of date."""
    current = manifest.select(F.to_date(F.substring("data_as_of", 1, 10)).alias("data_as_of"))
    return artifact.where(F.col("status") == "shipped").join(F.broadcast(current), "data_as_of", "left_semi")  # one row
