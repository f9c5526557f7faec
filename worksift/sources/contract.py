"""The works and scored record layouts, and checks that report every violation as a row."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksift.config import COMPLETION_STATUSES, SETTINGS, WORK_CATEGORIES

# The 22 columns of a works record.
WORKS_SCHEMA = {
    "work_id": "string",
    "state": "string",
    "constituency": "string",
    "mp_name": "string",
    "tenure": "string",
    "implementing_district_authority": "string",
    "implementing_agency": "string",
    "vendor_id": "string",
    "vendor_name": "string",
    "work_category": "string",
    "work_description": "string",
    "activity_name": "string",
    "recommendation_date": "date",
    "work_stage": "string",
    "completion_date": "date",
    "has_public_document": "boolean",
    "sanctioned_amount_inr": "double",
    "expenditure_amount_inr": "double",
    "sanction_date": "date",
    "completion_status": "string",
    "last_updated": "date",
    "source_rung": "int",
}


# The other tables of a snapshot.
SCORED_SCHEMA = {
    "work_id": "string",
    "inspection_rank": "bigint",
    "risk_score": "double",
    "flags": "array<string>",
    "why_flagged": "map<string,string>",
    "peer_group": "struct<label:string,n:bigint>",
}
NODE_SCHEMA = {"id": "string", "type": "string", "label": "string", "risk_weight": "double"}
EDGE_SCHEMA = {
    "source": "string",
    "target": "string",
    "work_count": "bigint",
    "total_amount_inr": "double",
    "flagged_work_count": "bigint",
}
CONTRACTS = {"works": WORKS_SCHEMA, "scored": SCORED_SCHEMA, "nodes": NODE_SCHEMA, "edges": EDGE_SCHEMA}


def canonical_sha256(value: object) -> str:
    """Hash of a value as JSON with sorted keys and no spaces: equal for equal values."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def contract_sha256() -> str:
    """Hash of every declared table layout."""
    return canonical_sha256(CONTRACTS)


def normalize_project(raw: DataFrame, source_rung: int, today: Column | None = None) -> DataFrame:
    """The fixed projection: typed columns, absent ones null, spend defaulting to 0."""
    if not 1 <= source_rung <= 5:
        raise ValueError(f"source_rung must be 1 to 5, got {source_rung}")
    today = F.current_date() if today is None else today
    columns = []
    for name, kind in WORKS_SCHEMA.items():
        c = F.col(name).try_cast(kind) if name in raw.columns else F.lit(None).cast(kind)
        if name == "expenditure_amount_inr":
            c = F.coalesce(c, F.lit(0.0))
        elif name == "last_updated":
            c = F.coalesce(c, today)
        elif name == "source_rung":
            c = F.lit(source_rung)
        columns.append(c.alias(name))
    return raw.select(*columns)


def _present(name: str) -> Column:
    return F.coalesce(F.length(name) > 0, F.lit(False))


def _contract_rules() -> dict[str, Column]:
    """Rule name to the condition that a valid row meets."""
    rules = {f"{c}_required": _present(c) for c in ("work_id", "state", "constituency", "mp_name")}
    rules["tenure_pattern"] = F.coalesce(F.col("tenure").rlike("^[0-9]{4}-[0-9]{4}$"), F.lit(False))
    rules["vendor_id_empty"] = F.col("vendor_id").isNull() | (F.length("vendor_id") > 0)
    rules["work_category_enum"] = F.coalesce(F.col("work_category").isin(*WORK_CATEGORIES), F.lit(False))
    for c in ("sanctioned_amount_inr", "expenditure_amount_inr"):
        rules[f"{c}_minimum"] = F.coalesce(F.col(c) >= 0, F.lit(False))
    rules["completion_status_enum"] = F.coalesce(
        F.col("completion_status").isin(*COMPLETION_STATUSES), F.lit(False)
    )
    rules["last_updated_required"] = F.col("last_updated").isNotNull()
    rules["source_rung_range"] = F.coalesce(F.col("source_rung").between(1, 5), F.lit(False))
    return rules


def contract_validate(works: DataFrame) -> DataFrame:
    """One row per (work, broken rule); a valid batch gives none."""
    broken = F.array_compact(
        F.array(*[F.when(~ok, F.lit(rule)) for rule, ok in _contract_rules().items()])
    )
    return works.select("work_id", F.explode(broken).alias("rule"))


def require_valid(works: DataFrame) -> DataFrame:
    """``works`` unchanged, or an error naming the broken rules of the first bad rows."""
    bad = contract_validate(works).limit(10).collect()  # ten rows at most
    if bad:
        raise ValueError("records break the works contract: " + "; ".join(map(str, bad)))
    return works


def contract_cross_checks(
    works: DataFrame, scored: DataFrame, nodes: DataFrame, edge_works: DataFrame, evidence: DataFrame
) -> DataFrame:
    """``(check, subject, detail)`` for every broken rule across the five tables. Edges and alias
    candidates come as one row per work behind them."""

    def finding(df: DataFrame, check: str, subject: Column, detail: Column) -> DataFrame:
        return df.select(
            F.lit(check).alias("check"),
            subject.cast("string").alias("subject"),
            detail.cast("string").alias("detail"),
        )

    known = works.select("work_id")
    ranks = scored.agg(
        F.count("*").alias("n"),
        F.min("inspection_rank").alias("low"),
        F.max("inspection_rank").alias("high"),
        F.countDistinct("inspection_rank").alias("distinct"),
    ).where((F.col("n") > 0) & ~((F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("distinct") == F.col("n"))))
    flagged, group = F.size("flags") > 0, F.col("peer_group")
    node_ids = nodes.select(F.col("id").alias("_node"))

    def missing_works(df: DataFrame, check: str, subject: Column) -> DataFrame:
        lost = df.withColumn("_subject", subject).join(known, "work_id", "left_anti")
        return finding(lost, check, F.col("_subject"), F.col("work_id"))

    edge_name = F.concat_ws("->", "source", "target")
    checks = [
        finding(scored.join(known, "work_id", "left_anti"), "scored_without_work", F.col("work_id"), F.lit(None)),
        finding(ranks, "ranks_not_dense", F.lit("inspection_rank"), F.col("n")),
        finding(scored.where(flagged & group.isNull()), "flagged_without_peers", F.col("work_id"), F.lit(None)),
        finding(
            scored.where(flagged & (F.col("peer_group.n") < SETTINGS.min_peer_group_n)),
            "peer_group_too_small",
            F.col("work_id"),
            F.col("peer_group.n"),
        ),
        finding(scored.where(~flagged & group.isNotNull()), "peers_without_flag", F.col("work_id"), F.lit(None)),
        missing_works(edge_works, "edge_work_unknown", edge_name),
        missing_works(
            evidence, "alias_work_unknown", F.concat_ws("/", "kind", "key")
        ),
    ]
    for end in ("source", "target"):
        loose = edge_works.select("source", "target").distinct().join(node_ids, F.col(end) == F.col("_node"), "left_anti")
        checks.append(finding(loose, f"edge_{end}_unknown", edge_name, F.col(end)))
    result = checks[0]
    for check in checks[1:]:
        result = result.unionByName(check)
    return result
