"""Fund-flow graph from member to agency to vendor, as node, edge and edge-work tables.

An edge's works are rows of ``edge_works`` rather than one array per edge: an edge may carry a
large share of all works. ``work_id_lists`` renders them as sorted lists of bounded length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worksift.functions.money import exact_sum
from worksift.functions.text import percent_encode, slug
from worksift.plans.ranking import exact_quantiles, global_rank
from worksift.plans.storage import written

# Node id prefixes, cluster threshold and floor, ribbon rows per tier.
NODE_PREFIX = {"MP": "mp", "Agency": "agency", "Vendor": "vendor"}
CLUSTER_Z = 2.0
CLUSTER_MIN_WORKS = 5
RIBBON_ROWS = 7

# Fixed value: the sentence shown for a cluster.
CLUSTER_SENTENCE = (
    "%s is connected to %d distinct MPs, %.1f standard deviations above the average of %.1f among %ss "
    "with at least %d works recorded."
)
LIST_LENGTH = 10_000


def _rupees(amount: str) -> Column:
    return F.round(exact_sum(F.col(amount)), 2)


def flow_facts(works: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per work with its three node ids (null where it has none), amount and flag."""
    flagged = scored.select("work_id", (F.size("flags") > 0).alias("flagged"))
    has_vendor = (F.length("vendor_name") > 0) & (F.length("vendor_id") > 0)
    agency = F.nullif(F.col("implementing_agency"), F.lit(""))
    return works.join(flagged, "work_id", "left").select(
        "work_id",
        "mp_name",
        agency.alias("agency_name"),
        F.when(has_vendor, F.col("vendor_name")).alias("vendor_name"),
        F.concat(F.lit(NODE_PREFIX["MP"] + "_"), slug(F.col("mp_name"))).alias("mp_id"),
        F.concat(F.lit(NODE_PREFIX["Agency"] + "_"), slug(agency)).alias("agency_id"),
        F.when(
            has_vendor, F.concat(F.lit(NODE_PREFIX["Vendor"] + "_"), percent_encode(F.col("vendor_id")))
        ).alias("vendor_node"),
        F.coalesce("sanctioned_amount_inr", F.lit(0.0)).alias("amount"),
        F.coalesce("flagged", F.lit(False)).alias("flagged"),
    )


def graph_nodes(facts: DataFrame) -> DataFrame:
    """Id, type, label and number of flagged works. When spellings share a slug, members and
    agencies show the label of the smallest work id; vendors show their usual name."""
    parts = []
    for kind, node, name in (
        ("MP", "mp_id", "mp_name"),
        ("Agency", "agency_id", "agency_name"),
        ("Vendor", "vendor_node", "vendor_name"),
    ):
        by_label = (
            facts.where(F.col(node).isNotNull())
            .groupBy(F.col(node).alias("id"), F.col(name).alias("label"))
            .agg(
                F.count("*").alias("n"),
                F.count_if("flagged").alias("flagged"),
                F.min("work_id").alias("first_work"),
            )
        )
        prefer = F.struct(-F.col("n"), F.col("label")) if kind == "Vendor" else F.col("first_work")
        parts.append(
            by_label.groupBy("id").agg(
                F.lit(kind).alias("type"),
                F.min_by("label", prefer).alias("label"),
                F.sum("flagged").cast("double").alias("risk_weight"),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def edge_works(facts: DataFrame) -> DataFrame:
    """``source, target, kind, work_id, amount, flagged``: every work behind every edge."""
    common = ["work_id", "amount", "flagged"]
    paid = F.col("agency_id").isNotNull()
    members = facts.where(paid).select(
        F.col("mp_id").alias("source"), F.col("agency_id").alias("target"), F.lit("MP").alias("source_type"), *common
    )
    vendors = facts.where(paid & F.col("vendor_node").isNotNull()).select(
        F.col("agency_id").alias("source"), F.col("vendor_node").alias("target"), F.lit("Agency").alias("source_type"), *common
    )
    return members.unionByName(vendors)


def graph_edges(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.groupBy("source", "target", "source_type").agg(
        F.count("*").alias("work_count"),
        _rupees("amount").alias("total_amount_inr"),
        F.count_if("flagged").alias("flagged_work_count"),
    )


def work_id_lists(rows: DataFrame, keys: Sequence[str], length: int = LIST_LENGTH) -> DataFrame:
    """Sorted distinct work ids per key as lists of at most ``length``, numbered by ``part``."""
    ids = rows.select(*keys, "work_id").distinct()
    ranked = global_rank(ids, [*[F.col(k) for k in keys], F.col("work_id")], "_rank")
    starts = ranked.groupBy(*keys).agg(F.min("_rank").alias("_first"))
    part = F.floor((F.col("_rank") - F.col("_first")) / length).cast("int")
    return (
        ranked.join(starts, list(keys))
        .groupBy(*keys, part.alias("part"))
        .agg(F.sort_array(F.collect_list("work_id")).alias("work_ids"))
    )


def graph_integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge ends that are no node; an intact graph gives no rows."""
    ids = nodes.select("id")
    loose = [
        edges.join(ids, F.col(end) == F.col("id"), "left_anti").select(
            F.lit(end).alias("end"), "source", "target"
        )
        for end in ("source", "target")
    ]
    return loose[0].unionByName(loose[1])


def _vendor_members(edges: DataFrame) -> DataFrame:
    """``id, members``: distinct members two hops from a vendor through any shared agency.

    Members are numbered and an agency's are combined into masks of 64, so a busy agency sends its
    vendors a row per mask and not one per member.
    """
    members = edges.where(F.col("source_type") == "MP").select(
        F.col("target").alias("agency"), F.col("source").alias("mp")
    )
    numbers = global_rank(members.select("mp").distinct(), [F.col("mp")], "_n")
    bit = F.expr("shiftleft(cast(1 as bigint), cast(_n % 64 as int))")
    masks = (
        members.join(numbers, "mp")
        .groupBy("agency", F.expr("_n div 64").alias("_word"))
        .agg(F.bit_or(bit).alias("_mask"))
    )
    vendors = edges.where(F.col("source_type") == "Agency").select(
        F.col("source").alias("agency"), F.col("target").alias("id")
    )
    combined = vendors.join(masks, "agency").groupBy("id", "_word").agg(F.bit_or("_mask").alias("_mask"))
    return combined.groupBy("id").agg(F.sum(F.bit_count("_mask")).alias("members"))


def _reach(edges: DataFrame) -> DataFrame:
    """``id, type, members``: members per agency (direct) and per vendor (two hops)."""
    direct = edges.where(F.col("source_type") == "MP").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("members"))
    hops = _vendor_members(edges)
    return direct.withColumn("type", F.lit("Agency")).unionByName(hops.withColumn("type", F.lit("Vendor")))


def graph_reach_counts(edges: DataFrame, at_least: int = 3) -> DataFrame:
    wide = F.col("members") >= at_least
    return _reach(edges).agg(
        F.count_if(wide & (F.col("type") == "Agency")).alias("agencies_wide"),
        F.count_if(wide & (F.col("type") == "Vendor")).alias("vendors_wide"),
    )


def concentration_clusters(nodes: DataFrame, edges: DataFrame, min_works: int = CLUSTER_MIN_WORKS) -> DataFrame:
    """Agencies and vendors whose member count stands out among busy nodes of their type, by the
    sample deviation."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"), "work_count")
    busy = ends.groupBy("id").agg(F.sum("work_count").alias("works")).where(F.col("works") >= min_works)
    eligible = (
        nodes.where(F.col("type") != "MP")
        .join(busy, "id")
        .join(_reach(edges).select("id", "members"), "id", "left")
        .withColumn("members", F.coalesce("members", F.lit(0)))
    )
    stats = eligible.groupBy("type").agg(
        F.avg("members").alias("mean"), F.stddev_samp("members").alias("std")
    )  # two rows
    z = F.when(F.col("std") > 0, (F.col("members") - F.col("mean")) / F.col("std"))
    found = eligible.join(F.broadcast(stats), "type").withColumn("z", z).where(F.col("z") > CLUSTER_Z)
    reason = F.format_string(CLUSTER_SENTENCE, "label", "members", "z", "mean", F.lower("type"), F.lit(min_works))
    return found.select(F.col("id").alias("node_id"), "label", "members", reason.alias("reason"))


def vendor_concentration(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Per vendor node: members sharing a work with it, agencies, works, rupees, flagged works.

    A work on both hops is one row of ``facts``, so this is one aggregation; its distinct
    (vendor, agency, member) triples are counted before a busy vendor is brought together.
    """
    triples = (
        facts.where(F.col("agency_id").isNotNull() & F.col("vendor_node").isNotNull())
        .groupBy("vendor_node", "agency_id", "mp_id")
        .agg(
            F.count("*").alias("works"),
            F.sum(F.col("amount").cast("decimal(28,4)")).alias("amount"),
            F.count_if("flagged").alias("flagged"),
        )
    )
    per_vendor = triples.groupBy(F.col("vendor_node").alias("id")).agg(
        F.countDistinct("mp_id").alias("members"),
        F.countDistinct("agency_id").alias("agencies"),
        F.sum("works").alias("works"),
        F.round(exact_sum(F.col("amount")), 2).alias("rupees"),
        F.sum("flagged").alias("flagged"),
    )
    vendors = nodes.where(F.col("type") == "Vendor").select("id", "label")
    count = lambda c: F.coalesce(c, F.lit(0))
    return vendors.join(per_vendor, "id", "left").select(
        F.col("id").alias("vendor_id"),
        F.col("label").alias("vendor_label"),
        count("members").alias("member_count"),
        count("agencies").alias("agency_count"),
        count("works").alias("work_count"),
        F.coalesce("rupees", F.lit(0.0)).alias("sanctioned_inr"),
        count("flagged").alias("flagged_work_count"),
    )


def vendor_match(concentrations: DataFrame, min_members: int, limit: int) -> DataFrame:
    """The first ``limit`` vendors with enough members, and how many there are in all."""
    matching = concentrations.where(F.col("member_count") >= min_members)
    total = matching.agg(F.count("*").alias("matching_count"))
    top = matching.orderBy(F.col("member_count").desc(), "vendor_label", "vendor_id").limit(limit)
    return top.crossJoin(F.broadcast(total))  # one row


def vendor_median(concentrations: DataFrame) -> DataFrame:
    """Median member count, halves rounded up; 0 for no vendors."""
    median = exact_quantiles(concentrations, [], "member_count", {"median": 2})
    return median.agg(
        F.coalesce(F.floor(F.max("median") + 0.5), F.lit(0)).cast("bigint").alias("median_member_count")
    )


def _cluster_works(edge_rows: DataFrame, vendor_ids: DataFrame) -> DataFrame:
    """Works the agencies paid to the given vendors."""
    paid = edge_rows.where(F.col("source_type") == "Agency")
    return paid.join(vendor_ids.select(F.col("vendor_id").alias("target")), "target", "left_semi")


def vendor_cluster(
    nodes: DataFrame, edge_rows: DataFrame, vendor_ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Nodes and whole edges around a set of vendors: their agencies, and members with a work that
    such an agency paid to one of them."""
    paid = _cluster_works(edge_rows, vendor_ids)
    relevant = paid.select(F.col("source").alias("target"), "work_id")
    member_rows = edge_rows.where(F.col("source_type") == "MP")
    touching = member_rows.join(relevant, ["target", "work_id"], "left_semi").select("source", "target").distinct()
    member_edges = graph_edges(member_rows.join(touching, ["source", "target"], "left_semi"))
    edges = member_edges.unionByName(graph_edges(paid))
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    kept = ends.unionByName(vendor_ids.select(F.col("vendor_id").alias("id")))
    return nodes.join(kept, "id", "left_semi"), edges


def cluster_restrict(edge_rows: DataFrame, vendor_ids: DataFrame) -> DataFrame:
    """The cluster's edges with each member's edge cut to the works its agency paid to these
    vendors, so both sides of an agency add up."""
    paid = _cluster_works(edge_rows, vendor_ids)
    relevant = paid.select(F.col("source").alias("target"), "work_id")
    member_rows = edge_rows.where(F.col("source_type") == "MP")
    cut = member_rows.join(relevant, ["target", "work_id"], "left_semi")
    return graph_edges(cut).unionByName(graph_edges(paid))


def graph_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node counts by type, and the flow over agency-to-vendor edges only."""
    kinds = nodes.agg(
        F.count_if(F.col("type") == "MP").alias("mp_count"),
        F.count_if(F.col("type") == "Agency").alias("agency_count"),
        F.count_if(F.col("type") == "Vendor").alias("vendor_count"),
    )
    flow = edges.where(F.col("source_type") == "Agency").agg(_rupees("total_amount_inr").alias("flow_inr"))
    return kinds.crossJoin(F.broadcast(flow))  # single rows


def graph_one_hop(
    nodes: DataFrame, edges: DataFrame, agency: str | None = None, vendor: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes whose label contains a needle, their edges and those edges' ends."""
    if not agency and not vendor:
        return nodes, edges
    matches = F.lit(False)
    for kind, needle in (("Agency", agency), ("Vendor", vendor)):
        if needle:
            found = F.contains(F.lower("label"), F.lit(needle.lower()))
            matches = matches | ((F.col("type") == kind) & found)
    seeds = nodes.where(matches).select("id")
    touched = [
        edges.join(seeds, F.col(end) == F.col("id"), "left_semi") for end in ("source", "target")
    ]
    kept_edges = touched[0].unionByName(touched[1]).distinct()
    ends = kept_edges.select(F.explode(F.array("source", "target")).alias("id"))
    return nodes.join(seeds.unionByName(ends), "id", "left_semi"), kept_edges


def flow_tier(flagged: Column, works: Column) -> Column:
    return (
        F.when((works <= 0) | (flagged <= 0), "plain").when(flagged >= works, "high").otherwise("elevated")
    )


def flow_fold_topk(nodes: DataFrame, edges: DataFrame, rows: int = RIBBON_ROWS) -> DataFrame:
    """Flows between the largest nodes of each type, the rest folded into one node per type when
    there are more than ``rows`` of them."""
    flows = edges.withColumn("amount", F.greatest(F.lit(0.0), F.col("total_amount_inr")))
    value = {
        end: flows.groupBy(F.col(end).alias("id")).agg(exact_sum(F.col("amount")).alias(name))
        for end, name in (("source", "outflow"), ("target", "inflow"))
    }
    sized = (
        nodes.join(value["source"], "id", "left")
        .join(value["target"], "id", "left")
        .withColumn("value", F.greatest(F.coalesce("outflow", F.lit(0.0)), F.coalesce("inflow", F.lit(0.0))))
        .select("id", "type", "label", "value")
    )
    counts = sized.groupBy("type").agg(F.count("*").alias("_of_type"))  # three rows
    # A rank filter below a constant: each task keeps its own first rows before the shuffle.
    largest = Window.partitionBy("type").orderBy(F.col("value").desc(), "label", "id")
    kept = (
        sized.withColumn("_row", F.row_number().over(largest))
        .where(F.col("_row") <= rows)
        .join(F.broadcast(counts), "type")
        .where((F.col("_of_type") <= rows) | (F.col("_row") <= rows - 1))
        .select("id")
    )
    kept = written(kept, "ribbon")

    def folded(df: DataFrame, end: str, kind: Column) -> DataFrame:
        marked = df.join(kept.select(F.col("id").alias(end), F.lit(True).alias("_kept")), end, "left")
        more = F.concat(F.lit("more:"), kind)
        return marked.withColumn(end, F.when(F.col("_kept"), F.col(end)).otherwise(more)).drop("_kept")

    source_type = F.col("source_type")
    target_type = F.when(source_type == "MP", "Agency").otherwise("Vendor")
    both = folded(folded(flows, "source", source_type), "target", target_type)
    merged = both.groupBy("source", "target").agg(
        _rupees("amount").alias("amount"),
        F.sum("work_count").alias("work_count"),
        F.sum("flagged_work_count").alias("flagged_work_count"),
    )
    return merged.withColumn("tier", flow_tier(F.col("flagged_work_count"), F.col("work_count")))
