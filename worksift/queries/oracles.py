"""The same results in plain SQL over the given tables, for comparison by another engine.

Nothing is imported from the package: every value is stated here a second time, so that a wrong
word, threshold or name there does not agree with itself.
"""

from __future__ import annotations

import json

ORACLES: dict[str, str] = {}

DAY = "DATE '2001-09-01'"

# Each activity of the tiles and the category it must get.
ACTIVITY_CATEGORIES = (
    ("Construction of roads with drainage", "Road"),
    ("Purchase of books for the school library", "School"),
    ("Tube-well for drinking water", "Drinking Water"),
    ("Solar street light", "Electricity"),
    ("Community hall", "Community Infrastructure"),
    ("Ambulance for the hospital", "Health"),
    ("Public toilet block", "Sanitation"),
    ("Flood control walls along roadsides", "Community Infrastructure"),
    ("Seed store", "Community Infrastructure"),
)
# The works record, names and kinds of versions, words, flags.
WORKS_COLUMNS = (
    "work_id state constituency mp_name tenure implementing_district_authority implementing_agency vendor_id vendor_name "
    "work_category work_description activity_name recommendation_date work_stage completion_date has_public_document "
    "sanctioned_amount_inr expenditure_amount_inr sanction_date completion_status last_updated source_rung"
).split()
DATES = ("recommendation_date", "completion_date", "sanction_date", "last_updated")
AMOUNTS = ("sanctioned_amount_inr", "expenditure_amount_inr")
STATUSES = ("Completed", "In Progress", "Recommended", "Sanctioned")
FLAGS = ("cost_outlier", "stalled_work", "expenditure_mismatch", "agency_concentration")
FINDER_VERSION = "candidate_generation_v0"
JUDGED_FINDER = "judged_same_asset_same_place"
JUDGED_VERSION = "work_candidate_derivation_v1"
PLACE_STOPLIST = ("village", "gram", "ward", "road", "school", "shamshan", "ghat", "community", "hall")
CONTINUATION_MARKERS = ("phase", "continuation", "continue", "remaining", "balance work")
WILSON_Z = 1.959963984540054
# Fixed value: the digest of the scoring settings as published; a changed setting changes it.
CONFIG_SHA256 = "3676cb6da04d118a4178163f0a19e6982005f6e5a3fbafe06cf0f7d5f92aa297"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# -- common table expressions -----------------------------------------------------------------

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (sql, needs)


def sql(body: str, *needs: str) -> str:
    """``body`` with the expressions it needs, and theirs, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for other in CTES[name][1]:
            add(other)
        ordered.append(name)

    for name in needs:
        add(name)
    if not ordered:
        return body
    again = any(f"FROM {n} " in CTES[n][0] for n in ordered)
    return ("WITH RECURSIVE " if again else "WITH ") + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in ordered) + "\n" + body


def oracle(name: str, body: str, *needs: str) -> None:
    ORACLES[name] = sql(body, *needs)


cte(
    "pay",
    """SELECT l_orderkey,
  SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS gross,
  SUM(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) ELSE 0 END) AS settled,
  MAX(CAST(l_shipdate AS DATE)) AS last_activity
FROM lineitem GROUP BY l_orderkey""",
)
cte(
    "vend",
    """SELECT l_orderkey, l_suppkey, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_suppkey) AS rn
FROM (SELECT l_orderkey, l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey) t""",
)
cte(
    "works",
    """SELECT CAST(o.o_orderkey AS VARCHAR) AS work_id, r.r_name AS state, n.n_name AS constituency,
  concat('MP-', CAST(o.o_custkey % 100 AS VARCHAR)) AS mp_name,
  concat(n.n_name, '-DA-', CAST(o.o_custkey % 4 AS VARCHAR)) AS implementing_district_authority,
  CASE WHEN p.l_orderkey IS NULL THEN NULL ELSE
    concat('AG-', CAST(CAST(FLOOR(POWER((o.o_orderkey % 997) / CAST(997 AS DOUBLE), 4) * 400) AS INT) AS VARCHAR)) END AS implementing_agency,
  CAST(v.l_suppkey AS VARCHAR) AS vendor_id, s.s_name AS vendor_name, o.o_orderpriority AS work_category,
  CAST(p.gross AS DOUBLE) AS sanctioned_amount_inr,
  CAST(CASE WHEN o.o_orderkey % 67 = 0 THEN p.settled * 2.5 ELSE p.settled * 0.6 END AS DOUBLE) AS expenditure_amount_inr,
  CAST(o.o_orderdate AS DATE) AS sanction_date,
  CAST(o.o_orderdate AS DATE) - CAST(o.o_custkey % 120 AS INT) AS recommendation_date,
  CASE o.o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'In Progress' ELSE 'Sanctioned' END AS completion_status,
  COALESCE(p.last_activity, CAST(o.o_orderdate AS DATE)) AS last_updated
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN pay p ON p.l_orderkey = o.o_orderkey
LEFT JOIN vend v ON v.l_orderkey = o.o_orderkey AND v.rn = 1
LEFT JOIN supplier s ON s.s_suppkey = v.l_suppkey""",
    "pay",
    "vend",
)
MONTHS = f"greatest(0, (year({DAY}) * 12 + month({DAY})) - (year(sanction_date) * 12 + month(sanction_date)))"
FY = "CASE WHEN month({d}) >= 4 THEN year({d}) ELSE year({d}) - 1 END"


def fy(date: str) -> str:
    start = FY.format(d=date)
    return f"printf('%d-%02d', {start}, ({start} + 1) % 100)"


cte(
    "keyed",
    f"""SELECT *, {fy('coalesce(sanction_date, last_updated)')} AS financial_year,
  CASE WHEN sanctioned_amount_inr <> 0 THEN expenditure_amount_inr / sanctioned_amount_inr END AS ratio FROM works""",
    "works",
)


def quartile(i: int) -> str:
    at = f"greatest(1, least({i} * (len(l) + 1) // 4, len(l) - 1))"
    share = f"({i} * (len(l) + 1) - 4 * {at})"
    return (
        f"CASE WHEN len(l) IS NULL THEN 0.0 WHEN len(l) = 1 THEN l[1] "
        f"ELSE (l[{at}] * (4 - {share}) + l[{at} + 1] * {share}) / 4 END"
    )


cte(
    "grouped",
    """SELECT work_category, state, financial_year, COUNT(*) AS n,
  coalesce(AVG(sanctioned_amount_inr), 0) AS mean_cost, coalesce(STDDEV_POP(sanctioned_amount_inr), 0) AS std_cost,
  coalesce(AVG(ratio), 0) AS mean_ratio, coalesce(STDDEV_POP(ratio), 0) AS std_ratio,
  list_sort(list(sanctioned_amount_inr) FILTER (WHERE sanctioned_amount_inr IS NOT NULL)) AS l
FROM keyed GROUP BY 1, 2, 3""",
    "keyed",
)
cte(
    "peers",
    f"""SELECT * EXCLUDE (l), {quartile(1)} AS q1_cost, {quartile(2)} AS median_cost, {quartile(3)} AS q3_cost,
  concat(work_category, ' works, ', state, ', ', financial_year) AS label FROM grouped""",
    "grouped",
)
cte(
    "gated",
    """SELECT w.*, p.n AS peer_n, p.label AS peer_label, p.mean_cost, p.std_cost, p.mean_ratio, p.std_ratio, p.median_cost
FROM keyed w LEFT JOIN peers p ON p.work_category = w.work_category AND p.state = w.state
  AND p.financial_year = w.financial_year AND p.n >= 30""",
    "keyed",
    "peers",
)
cte(
    "agency_spans",
    """SELECT implementing_agency, COUNT(*) AS works, COUNT(DISTINCT mp_name) AS mps, COUNT(DISTINCT constituency) AS districts
FROM works WHERE implementing_agency <> '' GROUP BY 1""",
    "works",
)
cte(
    "agency_found",
    """SELECT implementing_agency, mps, districts, mp_u, d_u FROM (
  SELECT *, works >= 2 AND mps >= 3 AND sm > 0 AND (mps - am) / sm > 2.0 AS mp_u,
    works >= 2 AND districts >= 3 AND sd > 0 AND (districts - ad) / sd > 2.0 AS d_u
  FROM agency_spans, (SELECT AVG(mps) am, STDDEV_POP(mps) sm, AVG(districts) ad, STDDEV_POP(districts) sd FROM agency_spans))
WHERE mp_u OR d_u""",
    "agency_spans",
)
cte(
    "vendor_found",
    """SELECT vendor_name, districts FROM (
  SELECT vendor_name, COUNT(*) AS works, COUNT(DISTINCT constituency) AS districts FROM works WHERE vendor_name <> '' GROUP BY 1) v
WHERE works >= 2 AND districts >= 3 AND (districts - (SELECT AVG(d) FROM (SELECT COUNT(DISTINCT constituency) d FROM works WHERE vendor_name <> '' GROUP BY vendor_name)))
  > 2.0 * (SELECT STDDEV_POP(d) FROM (SELECT COUNT(DISTINCT constituency) d FROM works WHERE vendor_name <> '' GROUP BY vendor_name))
  AND (SELECT STDDEV_POP(d) FROM (SELECT COUNT(DISTINCT constituency) d FROM works WHERE vendor_name <> '' GROUP BY vendor_name)) > 0""",
    "works",
)
cte(
    "found",
    f"""SELECT g.*,
  CASE WHEN std_cost > 0 AND (sanctioned_amount_inr - mean_cost) / std_cost > 2.5 THEN
    CASE WHEN median_cost <= 0 THEN 'no_multiple' ELSE 'default' END END AS cost_variant,
  {MONTHS} AS months,
  coalesce(expenditure_amount_inr, 0) / nullif(coalesce(sanctioned_amount_inr, 0), 0) AS spend,
  CASE WHEN a.mp_u AND a.d_u THEN 'districts_and_mps' WHEN a.implementing_agency IS NOT NULL THEN 'mps'
    WHEN v.vendor_name IS NOT NULL THEN 'vendor' END AS conc_variant,
  CASE WHEN a.implementing_agency IS NOT NULL THEN a.mps END AS conc_mps,
  CASE WHEN a.mp_u AND a.d_u THEN a.districts WHEN a.implementing_agency IS NULL THEN v.districts END AS conc_districts
FROM gated g LEFT JOIN agency_found a ON a.implementing_agency = g.implementing_agency
LEFT JOIN vendor_found v ON v.vendor_name = g.vendor_name""",
    "gated",
    "agency_found",
    "vendor_found",
)
cte(
    "variants",
    """SELECT *,
  CASE WHEN peer_n IS NOT NULL AND completion_status IN ('In Progress', 'Sanctioned') AND months >= 6 AND coalesce(sanctioned_amount_inr, 0) > 0 THEN
    CASE WHEN coalesce(expenditure_amount_inr, 0) <= 0 THEN 'zero_spend' WHEN spend * 100 < 10 THEN 'part_spend' END END AS stall_variant,
  CASE WHEN peer_n IS NOT NULL AND coalesce(sanctioned_amount_inr, 0) > 0 AND (std_ratio <= 0 OR (spend - mean_ratio) / std_ratio > 2.0) THEN
    CASE WHEN spend > 1 THEN 'over_sanction' WHEN abs(spend - 1) < 1e-9 AND completion_status <> 'Completed' THEN 'full_spend_open' END END AS over_variant,
  CASE WHEN peer_n IS NOT NULL THEN conc_variant END AS gated_conc
FROM found""",
    "found",
)
cte(
    "flagged",
    """SELECT *, [f FOR f IN [CASE WHEN cost_variant IS NOT NULL THEN 'cost_outlier' END, CASE WHEN stall_variant IS NOT NULL THEN 'stalled_work' END,
  CASE WHEN over_variant IS NOT NULL THEN 'expenditure_mismatch' END, CASE WHEN gated_conc IS NOT NULL THEN 'agency_concentration' END] IF f IS NOT NULL] AS flags,
  (CASE WHEN cost_variant IS NOT NULL THEN 30 ELSE 0 END) + (CASE WHEN stall_variant IS NOT NULL THEN 25 ELSE 0 END)
  + (CASE WHEN over_variant IS NOT NULL THEN 25 ELSE 0 END) + (CASE WHEN gated_conc IS NOT NULL THEN 20 ELSE 0 END) AS points
FROM variants""",
    "variants",
)
cte(
    "scored",
    """SELECT *, CAST(least(80, points) AS DOUBLE) AS risk_score,
  ROW_NUMBER() OVER (ORDER BY least(80, points) DESC, work_id) AS inspection_rank FROM flagged""",
    "flagged",
)
UNDER = "completion_status IN ('Sanctioned', 'In Progress')"
RUPEES = "SUM(CAST({x} AS DECIMAL(28,4)))"


def rupees(x: str, where: str = "TRUE") -> str:
    return f"CAST(ROUND(coalesce(SUM(CASE WHEN {where} THEN CAST({x} AS DECIMAL(28,4)) END), 0), 2) AS DOUBLE)"


# -- sources ----------------------------------------------------------------------------------

activity = "CASE o_orderkey % {n} {whens} END".format(
    n=len(ACTIVITY_CATEGORIES), whens=" ".join(f"WHEN {i} THEN {q(a)}" for i, (a, _) in enumerate(ACTIVITY_CATEGORIES))
)
category = "CASE activity_name " + " ".join(f"WHEN {q(a)} THEN {q(name)}" for a, name in ACTIVITY_CATEGORIES) + " END"
cte(
    "spine",
    f"""SELECT *, CAST(o_orderdate AS DATE) AS ordered, {activity} AS activity_name FROM orders
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
cte(
    "events_paid",
    """SELECT CAST(l_orderkey AS VARCHAR) AS work_id, concat('Vendor ', CAST(l_suppkey % 40 AS VARCHAR)) AS vendor_name,
  CAST(l_suppkey AS VARCHAR) AS vendor_id, p_brand AS implementing_agency, CAST(l_shipdate AS DATE) AS paid_on,
  l_returnflag <> 'R' AS settled, l_extendedprice AS amount_inr FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
)
cte(
    "parsed",
    f"""SELECT CASE WHEN o_orderkey % 997 <> 5 THEN CAST(o_orderkey AS VARCHAR) END AS work_id, r_name AS state, n_name AS constituency,
  concat('MP ', CAST(o_custkey % 100 AS VARCHAR)) AS mp_name, CASE WHEN o_orderkey % 100 <> 1 THEN '2024-2029' END AS tenure,
  concat(n_name, '-DA-', CAST(o_custkey % 4 AS VARCHAR)) AS implementing_district_authority, {category} AS work_category,
  CASE WHEN o_orderkey % 10 <> 3 THEN o_orderpriority END AS work_description, activity_name,
  CASE WHEN o_custkey % 50 <> 7 THEN ordered - CAST(o_custkey % 120 AS INT) END AS recommendation_date,
  CASE o_orderstatus WHEN 'P' THEN 'Vendor Identification' WHEN 'O' THEN 'Physical Inspection' ELSE 'Work Completed' END AS work_stage,
  CASE o_orderkey % 3 WHEN 1 THEN TRUE WHEN 2 THEN FALSE END AS has_public_document,
  CASE WHEN o_orderkey % 211 = 0 THEN 0.0 ELSE o_totalprice END AS sanctioned_amount_inr,
  CASE WHEN o_custkey % 60 <> 9 THEN ordered END AS sanction_date, o_orderstatus, ordered FROM spine""",
    "spine",
)
cte(
    "usual_vendor",
    """SELECT work_id, vendor_name FROM (SELECT work_id, vendor_name, ROW_NUMBER() OVER (PARTITION BY work_id ORDER BY COUNT(*) DESC, vendor_name) AS rn
FROM events_paid WHERE vendor_name IS NOT NULL GROUP BY 1, 2) WHERE rn = 1""",
    "events_paid",
)
cte(
    "usual_id",
    """SELECT work_id, vendor_id FROM (SELECT e.work_id, e.vendor_id, ROW_NUMBER() OVER (PARTITION BY e.work_id ORDER BY COUNT(*) DESC, e.vendor_id) AS rn
FROM events_paid e JOIN usual_vendor u ON u.work_id = e.work_id AND u.vendor_name = e.vendor_name GROUP BY 1, 2) WHERE rn = 1""",
    "usual_vendor",
)
cte(
    "usual_agency",
    """SELECT work_id, implementing_agency FROM (SELECT work_id, implementing_agency, ROW_NUMBER() OVER (PARTITION BY work_id ORDER BY COUNT(*) DESC, implementing_agency) AS rn
FROM events_paid WHERE implementing_agency IS NOT NULL GROUP BY 1, 2) WHERE rn = 1""",
    "events_paid",
)
cte(
    "rollup_rows",
    f"""SELECT t.work_id, vendor_name, vendor_id, implementing_agency, last_activity, spent FROM (
  SELECT work_id, MAX(paid_on) AS last_activity, {rupees('amount_inr', 'settled')} AS spent FROM events_paid GROUP BY 1) t
LEFT JOIN usual_vendor USING (work_id) LEFT JOIN usual_id USING (work_id) LEFT JOIN usual_agency USING (work_id)""",
    "usual_id",
    "usual_agency",
)
oracle(
    "tile_unwrap",
    """SELECT 'sanctioned' AS tile, CASE WHEN o_orderkey % 997 <> 5 THEN CAST(o_orderkey AS VARCHAR) END AS work_id,
  concat(chr(9), ' ', r_name, '  ') AS value, o_orderkey % 3 <> 0 AS has_file_status FROM spine
UNION ALL SELECT 'completed', CAST(o_orderkey AS VARCHAR), strftime(ordered + 90, '%-d-%b-%Y'), FALSE FROM spine WHERE o_orderstatus = 'F'
UNION ALL SELECT 'payments', work_id, vendor_name, FALSE FROM events_paid""",
    "spine",
    "events_paid",
)
oracle(
    "tile_parse",
    """SELECT work_id, state, constituency, mp_name, tenure, implementing_district_authority, work_category, work_description, activity_name,
  CAST(recommendation_date AS VARCHAR) AS recommendation_date, work_stage, CAST(has_public_document AS VARCHAR) AS has_public_document,
  ROUND(sanctioned_amount_inr, 4) AS sanctioned_amount_inr, CAST(sanction_date AS VARCHAR) AS sanction_date FROM parsed""",
    "parsed",
)
oracle(
    "payment_rollup",
    """SELECT work_id, vendor_name, vendor_id, implementing_agency, CAST(last_activity AS VARCHAR) AS last_activity, spent AS expenditure_amount_inr FROM rollup_rows""",
    "rollup_rows",
)
oracle(
    "completed_lookup",
    "SELECT CAST(l_orderkey AS VARCHAR) AS work_id, CAST(MAX(CAST(l_shipdate AS DATE)) AS VARCHAR) AS completion_date FROM lineitem GROUP BY 1",
)
oracle(
    "works_join",
    f"""SELECT p.work_id, state, constituency, mp_name, tenure, implementing_district_authority, r.implementing_agency, r.vendor_id, r.vendor_name,
  work_category, work_description, activity_name, CAST(recommendation_date AS VARCHAR) AS recommendation_date, work_stage,
  CASE WHEN o_orderstatus = 'F' THEN CAST(ordered + 90 AS VARCHAR) END AS completion_date,
  CAST(has_public_document AS VARCHAR) AS has_public_document, ROUND(sanctioned_amount_inr, 4) AS sanctioned_amount_inr,
  coalesce(r.spent, 0.0) AS expenditure_amount_inr, CAST(sanction_date AS VARCHAR) AS sanction_date,
  CASE WHEN o_orderstatus = 'F' THEN 'Completed' WHEN work_stage = 'Vendor Identification' THEN 'Sanctioned' ELSE 'In Progress' END AS completion_status,
  CAST(coalesce(r.last_activity, sanction_date, {DAY}) AS VARCHAR) AS last_updated
FROM parsed p LEFT JOIN rollup_rows r ON r.work_id = p.work_id WHERE p.work_id IS NOT NULL""",
    "parsed",
    "rollup_rows",
)
oracle(
    "source_quality_counts",
    """SELECT COUNT(*) AS sanctioned_rows, COUNT(work_id) AS records, COUNT(*) - COUNT(work_id) AS dropped_no_work_id,
  COUNT(*) FILTER (work_id IS NOT NULL AND work_description IS NOT NULL) AS description_present,
  COUNT(*) FILTER (work_id IS NOT NULL AND work_description IS NULL) AS description_missing,
  COUNT(work_id) AS activity_present, CAST(0 AS BIGINT) AS activity_missing,
  COUNT(*) FILTER (work_id IS NOT NULL AND recommendation_date IS NOT NULL) AS recommendation_date_present,
  COUNT(*) FILTER (work_id IS NOT NULL AND recommendation_date IS NULL) AS recommendation_date_missing,
  CAST(0 AS BIGINT) AS recommendation_date_unparseable, COUNT(recommendation_date) AS recommendation_date_supplied,
  CAST(0 AS BIGINT) AS sanction_date_unparseable, COUNT(sanction_date) AS sanction_date_supplied,
  COUNT(*) FILTER (o_orderstatus = 'F') AS completed_rows, (SELECT COUNT(*) FROM lineitem) AS expenditure_rows FROM parsed""",
    "parsed",
)
absent = {"tenure", "work_description", "activity_name", "work_stage", "completion_date", "has_public_document"}


def normalised(name: str) -> str:
    if name in absent:
        return f"CAST(NULL AS VARCHAR) AS {name}"
    if name == "source_rung":
        return "3 AS source_rung"
    if name == "last_updated":
        return f"CAST({DAY} AS VARCHAR) AS last_updated"
    if name in AMOUNTS:
        value = f"coalesce({name}, 0.0)" if name.startswith("exp") else name
        return f"ROUND({value}, 6) AS {name}"
    return f"CAST({name} AS VARCHAR) AS {name}" if name in DATES else name


oracle("normalize_project", "SELECT " + ", ".join(normalised(n) for n in WORKS_COLUMNS) + " FROM works", "works")
oracle(
    "contract_validate",
    """SELECT rule, COUNT(*) AS works FROM (SELECT 'work_category_enum' AS rule FROM works
UNION ALL SELECT 'sanctioned_amount_inr_minimum' FROM works WHERE sanctioned_amount_inr IS NULL) GROUP BY 1""",
    "works",
)
oracle(
    "latest_snapshot_select",
    "SELECT work_id, '20260904T101500Z' AS snapshot, 1 AS source_rung, ROUND(sanctioned_amount_inr, 4) AS sanctioned_amount_inr FROM works",
    "works",
)
oracle(
    "works_compat_view",
    """SELECT work_id, implementing_district_authority, CAST(NULL AS VARCHAR) AS implementing_agency, CAST(NULL AS VARCHAR) AS vendor_id, vendor_name,
  CAST(NULL AS VARCHAR) AS work_stage, CAST(NULL AS VARCHAR) AS completion_date, CAST(NULL AS VARCHAR) AS has_public_document,
  CAST(NULL AS VARCHAR) AS work_description FROM works""",
    "works",
)
oracle(
    "graph_rebuild_needed",
    "SELECT * FROM (VALUES (FALSE, 'current'), (TRUE, 'no_authority'), (TRUE, 'no_work_ids')) t(rebuild_needed, graph)",
)


def receipt(name: str, complete: str, note: str, demo: str, columns: dict[str, tuple[str, str]], source: str) -> str:
    """A receipt: rows as text, columns by name, summed by the first 15 hex digits of their md5."""
    parts = []
    for column, (value, kind) in sorted(columns.items()):
        shown = f"printf('%.6f', {value})" if kind == "double" else f"CAST({value} AS VARCHAR)"
        parts.append(f"coalesce(strlen({shown}) || ':' || {shown}, '-')")
    layout = json.dumps({c: k for c, (_, k) in columns.items()}, sort_keys=True, separators=(",", ":"))
    return f"""SELECT {q(name)} AS input, {complete} AS complete, {note} AS note, COUNT(*) AS rows, SUM(length(r))::BIGINT AS chars,
  CAST(SUM(CAST('0x' || md5(r)[1:15] AS BIGINT)) AS VARCHAR) AS checksum, {demo} AS is_demo, sha256({q(layout)}) AS schema_sha256 FROM (SELECT {" || ".join(parts)} AS r FROM {source})"""


def as_is(kinds: str, **others: tuple[str, str]) -> dict[str, tuple[str, str]]:
    return {c: (c, k) for c, k in (x.split(":") for x in kinds.split())} | others


WORKS_LAYOUT = as_is(
    "work_id:string state:string constituency:string mp_name:string implementing_district_authority:string implementing_agency:string vendor_id:string "
    "vendor_name:string work_category:string recommendation_date:date sanctioned_amount_inr:double expenditure_amount_inr:double sanction_date:date "
    "completion_status:string last_updated:date",
    tenure=("'2024-2029'", "string"), work_description=("NULL", "string"), activity_name=("NULL", "string"), work_stage=("NULL", "string"),
    completion_date=("NULL", "date"), has_public_document=("NULL", "boolean"), source_rung=("5", "int"),
)
SANCTIONED_LAYOUT = as_is(
    "work_id:string state:string constituency:string mp_name:string tenure:string implementing_district_authority:string work_category:string "
    "work_description:string activity_name:string recommendation_date:date work_stage:string has_public_document:boolean sanctioned_amount_inr:double sanction_date:date"
)
PAYMENT_LAYOUT = as_is("work_id:string vendor_name:string vendor_id:string implementing_agency:string paid_on:date settled:boolean amount_inr:double")
# Fixed value: the declared tables of a snapshot.
DECLARED = {
    "works": {c: k for c, (_, k) in WORKS_LAYOUT.items()},
    "scored": {"work_id": "string", "inspection_rank": "bigint", "risk_score": "double", "flags": "array<string>", "why_flagged": "map<string,string>", "peer_group": "struct<label:string,n:bigint>"},
    "nodes": {"id": "string", "type": "string", "label": "string", "risk_weight": "double"},
    "edges": {"source": "string", "target": "string", "work_count": "bigint", "total_amount_inr": "double", "flagged_work_count": "bigint"},
}
oracle(
    "input_receipts",
    f"""SELECT *, sha256({q(json.dumps(DECLARED, sort_keys=True, separators=(",", ":")))}) AS contract_sha256, {q(CONFIG_SHA256)} AS config_sha256, 'cached_tiles' AS acquisition_mode,
  CASE input WHEN 'expenditure_events' THEN 'new' WHEN 'works_completed' THEN 'same' ELSE 'changed' END AS change,
  CASE input WHEN 'works_sanctioned' THEN 'layout,content' WHEN 'works' THEN 'rows,content' ELSE '' END AS differs FROM (
{receipt('works_sanctioned', 'TRUE', 'CAST(NULL AS VARCHAR)', 'FALSE', SANCTIONED_LAYOUT, 'parsed')}
UNION ALL {receipt('works_completed', 'TRUE', 'NULL', 'FALSE', dict(work_id=('CAST(o_orderkey AS VARCHAR)', 'string'), completion_date=('CAST(ordered + 90 AS DATE)', 'date')), "spine WHERE o_orderstatus = 'F'")}
UNION ALL {receipt('expenditure_events', 'FALSE', "'salvaged'", 'FALSE', PAYMENT_LAYOUT, 'events_paid')}
UNION ALL {receipt('works', 'TRUE', 'NULL', 'TRUE', WORKS_LAYOUT, 'works')})""",
    "parsed",
    "events_paid",
    "works",
)

# -- peer groups and detectors ----------------------------------------------------------------

STATS = ("mean_cost", "std_cost", "mean_ratio", "std_ratio", "q1_cost", "median_cost", "q3_cost")
oracle(
    "peer_groups",
    "SELECT work_category, state, financial_year, label, n, " + ", ".join(f"ROUND({s}, 6) AS {s}" for s in STATS) + " FROM peers",
    "peers",
)
oracle("peer_gate", "SELECT work_id, peer_label AS label, coalesce(peer_n, 0) AS n, ROUND(mean_cost, 6) AS mean_cost FROM gated", "gated")
oracle(
    "cost_outlier",
    """SELECT work_id, cost_variant, ROUND(CASE WHEN median_cost > 0 THEN sanctioned_amount_inr / median_cost END, 6) AS cost_multiple
FROM found WHERE cost_variant IS NOT NULL""",
    "found",
)
oracle(
    "stalled_work",
    """SELECT work_id, stall_variant AS stalled_variant, months AS stalled_months, ROUND(CASE WHEN stall_variant = 'part_spend' THEN spend * 100 END, 6) AS stalled_percent
FROM variants WHERE stall_variant IS NOT NULL""",
    "variants",
)
oracle(
    "expenditure_mismatch",
    """SELECT work_id, over_variant AS mismatch_variant, ROUND(CASE WHEN over_variant = 'over_sanction' THEN (spend - 1) * 100 END, 6) AS mismatch_percent_over
FROM variants WHERE over_variant IS NOT NULL""",
    "variants",
)
oracle(
    "agency_concentration",
    """SELECT work_id, conc_variant AS concentration_variant, coalesce(conc_mps, -1) AS mps, coalesce(conc_districts, -1) AS districts
FROM found WHERE conc_variant IS NOT NULL""",
    "found",
)
oracle(
    "flag_assemble",
    """SELECT work_id, array_to_string(flags, ',') AS flags, len(flags) AS sentences,
  CASE WHEN len(flags) > 0 THEN peer_label ELSE '' END AS peer_label, CASE WHEN len(flags) > 0 THEN peer_n ELSE 0 END AS peer_n FROM flagged""",
    "flagged",
)
cut = """CASE WHEN length(lower(work_category)) <= 14 THEN lower(work_category)
  WHEN contains(lower(work_category)[1:14], ' ') THEN regexp_replace(lower(work_category)[1:14], ' [^ ]*$', '') ELSE lower(work_category)[1:14] END"""


def whole(x: str, width: int) -> str:
    digits = f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"
    return f"CASE WHEN length({digits}) > {width} THEN '{'9' * width}' ELSE {digits} END"


multiple = "CASE WHEN sanctioned_amount_inr / median_cost >= 100 THEN printf('%.0f', sanctioned_amount_inr / median_cost) ELSE printf('%.1f', sanctioned_amount_inr / median_cost) END"
cte(
    "sentences",
    f"""SELECT work_id, 'cost_outlier' AS flag, CASE cost_variant WHEN 'default' THEN concat('Cost is ', {multiple}, 'x the median for ', {cut}, ' works in this state.')
  ELSE concat('Cost is above the usual range for ', {cut}, ' works here.') END AS sentence FROM flagged WHERE cost_variant IS NOT NULL
UNION ALL SELECT work_id, 'stalled_work', CASE stall_variant WHEN 'zero_spend' THEN concat('Sanctioned ', {whole('months', 3)}, ' months ago, zero expenditure recorded.')
  ELSE concat('Sanctioned ', {whole('months', 3)}, ' months ago, ', {whole('spend * 100', 3)}, ' percent spent.') END FROM flagged WHERE stall_variant IS NOT NULL
UNION ALL SELECT work_id, 'expenditure_mismatch', CASE over_variant WHEN 'over_sanction' THEN concat('Expenditure is ', {whole('(spend - 1) * 100', 4)}, ' percent above sanction.')
  ELSE 'Full amount spent, work still under implementation.' END FROM flagged WHERE over_variant IS NOT NULL
UNION ALL SELECT work_id, 'agency_concentration', CASE gated_conc WHEN 'mps' THEN concat('Agency holds works from ', {whole('conc_mps', 3)}, ' different MPs.')
  WHEN 'districts_and_mps' THEN concat('Agency holds works in ', {whole('conc_districts', 3)}, ' districts, ', {whole('conc_mps', 3)}, ' MPs.')
  ELSE concat('Vendor appears in ', {whole('conc_districts', 3)}, ' districts this year.') END FROM flagged WHERE gated_conc IS NOT NULL""",
    "flagged",
)
oracle("why_flagged", "SELECT * FROM sentences", "sentences")

# -- score and rank ---------------------------------------------------------------------------

cte(
    "raw_features",
    f"""SELECT work_id, greatest(0.0, coalesce(sanctioned_amount_inr, 0)) AS s, greatest(0.0, coalesce(expenditure_amount_inr, 0)) AS e, {MONTHS} AS m FROM works""",
    "works",
)
cte(
    "features",
    """SELECT work_id, s, e, m, ln(1 + s) AS a, ln(1 + e) AS b, CASE WHEN s > 0 THEN least(e / s, 5.0) ELSE 0.0 END AS c, CAST(m AS DOUBLE) AS d FROM raw_features""",
    "raw_features",
)
scaled = ", ".join(f"({c} - AVG({c}) OVER ()) / (CASE WHEN STDDEV_POP({c}) OVER () > 0 THEN STDDEV_POP({c}) OVER () ELSE 1 END) AS {n}" for c, n in zip("abcd", ("fa", "fb", "fc", "fd")))
cte("scaled", f"SELECT work_id, s, e, m, {scaled} FROM features", "features")
oracle(
    "anomaly_features",
    "SELECT work_id, ROUND(fa, 6) AS f_sanctioned, ROUND(fb, 6) AS f_spent, ROUND(fc, 6) AS f_ratio, ROUND(fd, 6) AS f_months FROM scaled",
    "scaled",
)
# The forest. A tree's sample are the works with its smallest draws; a node's two
# draws choose a feature that varies in it and the place of the cut.
FOREST_SAMPLE, FOREST_HEIGHT, EULER = 256, 8, 0.5772156649015329
_node_md5 = "md5(concat(seed, ':', tree, ':', node))"
_varies = "list_filter([1, 2, 3, 4], lambda i: h[i] > l[i])"
_axis = f"CASE WHEN level < {FOREST_HEIGHT} AND len({_varies}) > 0 THEN ({_varies})[1 + CAST('0x' || {_node_md5}[1:8] AS BIGINT) % len({_varies})] END"
_place = f"(l[axis] + (h[axis] - l[axis]) * (CAST('0x' || {_node_md5}[9:16] AS BIGINT) / 4294967296.0))"
_cut = f"CASE WHEN {_place} >= h[axis] THEN l[axis] ELSE {_place} END"
_depth = f"level + CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1 ELSE 2 * (ln(n - 1) + {EULER}) - 2.0 * (n - 1) / n END"
NORMAL = f"(2 * (ln({FOREST_SAMPLE} - 1) + {EULER}) - 2.0 * ({FOREST_SAMPLE} - 1) / {FOREST_SAMPLE})"


def forest_ctes(name: str, seeds: tuple[int, ...], trees: int) -> None:
    """``<name>_paths``: the depth at which each point ends in each tree."""
    cte(
        f"{name}_sample",
        f"""SELECT seed, tree, f FROM (
    SELECT work_id, f, seed, tree, (a + ((seed * 65537 + tree) % 16777216) * b) % 4294967296 AS pick FROM (
      SELECT work_id, [ROUND(fa, 9), ROUND(fb, 9), ROUND(fc, 9), ROUND(fd, 9)] AS f, CAST('0x' || md5(work_id)[1:8] AS BIGINT) AS a, CAST('0x' || md5(work_id)[9:16] AS BIGINT) | 1 AS b FROM scaled),
    (SELECT unnest([{", ".join(map(str, seeds))}]) AS seed), (SELECT unnest(range({trees})) AS tree))
  QUALIFY ROW_NUMBER() OVER (PARTITION BY seed, tree ORDER BY pick, work_id) <= {FOREST_SAMPLE}""",
        "scaled",
    )
    cte(
        f"{name}_grown",
        f"""SELECT seed, tree, f, 0 AS node, 0 AS level FROM {name}_sample
  UNION ALL
  SELECT seed, tree, f, 2 * node + CASE WHEN f[axis] <= {_cut} THEN 1 ELSE 2 END, level + 1 FROM (
    SELECT *, {_axis} AS axis FROM (
      SELECT *, [MIN(f[1]) OVER w, MIN(f[2]) OVER w, MIN(f[3]) OVER w, MIN(f[4]) OVER w] AS l, [MAX(f[1]) OVER w, MAX(f[2]) OVER w, MAX(f[3]) OVER w, MAX(f[4]) OVER w] AS h
      FROM {name}_grown WINDOW w AS (PARTITION BY seed, tree, node)))
  WHERE axis IS NOT NULL""",
        f"{name}_sample",
    )
    cte(
        f"{name}_nodes",
        f"""SELECT seed, tree, node, axis, {_cut} AS cut, {_depth} AS depth FROM (SELECT *, {_axis} AS axis FROM (
    SELECT seed, tree, node, level, COUNT(*) AS n, [MIN(f[1]), MIN(f[2]), MIN(f[3]), MIN(f[4])] AS l, [MAX(f[1]), MAX(f[2]), MAX(f[3]), MAX(f[4])] AS h
    FROM {name}_grown GROUP BY seed, tree, node, level))""",
        f"{name}_grown",
    )
    walk = f"""SELECT p, [ROUND(fa, 9), ROUND(fb, 9), ROUND(fc, 9), ROUND(fd, 9)] AS f, seed, tree, 0 AS node FROM points, (SELECT DISTINCT seed, tree FROM {name}_nodes)"""
    for _ in range(FOREST_HEIGHT):
        walk = f"""SELECT p, f, seed, tree, CASE WHEN axis IS NULL THEN node WHEN f[axis] > cut THEN 2 * node + 2 ELSE 2 * node + 1 END AS node
FROM ({walk}) JOIN {name}_nodes USING (seed, tree, node)"""
    cte(f"{name}_paths", f"SELECT p, seed, tree, depth FROM ({walk}) JOIN {name}_nodes USING (seed, tree, node)", f"{name}_nodes", "points")


# Neighbours of one representative of each pile of equal works; its twins come first, at 0.
cte("points", "SELECT s, e, m, any_value(fa) AS fa, any_value(fb) AS fb, any_value(fc) AS fc, any_value(fd) AS fd, COUNT(*) AS weight, ROW_NUMBER() OVER (ORDER BY s, e, m) AS p FROM scaled GROUP BY s, e, m", "scaled")
cte(
    "near_lists",
    """SELECT a.p, min_by({'q': b.p, 'd': ROUND(sqrt((a.fa - b.fa)*(a.fa - b.fa) + (a.fb - b.fb)*(a.fb - b.fb) + (a.fc - b.fc)*(a.fc - b.fc) + (a.fd - b.fd)*(a.fd - b.fd)), 9),
    'w': b.weight - CASE WHEN a.p = b.p THEN 1 ELSE 0 END},
    {'d': ROUND(sqrt((a.fa - b.fa)*(a.fa - b.fa) + (a.fb - b.fb)*(a.fb - b.fb) + (a.fc - b.fc)*(a.fc - b.fc) + (a.fd - b.fd)*(a.fd - b.fd)), 9), 'q': b.p}, 21) AS l
FROM points a, points b GROUP BY a.p""",
    "points",
)
cte("near_all", "SELECT p, u.q, u.d, u.w, SUM(u.w) OVER (PARTITION BY p ORDER BY u.d, u.q ROWS UNBOUNDED PRECEDING) - u.w AS before FROM (SELECT p, unnest(l) AS u FROM near_lists)", "near_lists")
cte("near20", "SELECT p, q, d, CAST(least(w, 20 - before) AS BIGINT) AS w FROM near_all WHERE w > 0 AND before < 20", "near_all")
cte("k_distance", "SELECT p, MAX(d) AS k FROM near20 GROUP BY p", "near20")
cte("density", "SELECT n.p, 1 / (SUM(n.w * greatest(k.k, n.d)) / SUM(n.w) + 1e-10) AS r FROM near20 n JOIN k_distance k ON k.p = n.q GROUP BY n.p", "near20", "k_distance")
cte("factor", "SELECT n.p, SUM(n.w * o.r) / SUM(n.w) / any_value(me.r) AS f FROM near20 n JOIN density o ON o.p = n.q JOIN density me ON me.p = n.p GROUP BY n.p", "density")
oracle(
    "local_outlier_factor",
    """SELECT s AS point_sanctioned, e AS point_spent, m AS point_months, weight, ROUND(f, 6) AS outlier_factor FROM points JOIN factor USING (p)""",
    "points",
    "factor",
)
WITH_SIGNAL = "least(100.0, least(80.0, points) + 20.0 * (CAST(work_id AS BIGINT) % 8) / 8.0)"
oracle("risk_score", f"SELECT work_id, ROUND({WITH_SIGNAL}, 2) AS risk_score FROM flagged", "flagged")
oracle("inspection_rank", "SELECT work_id, inspection_rank, risk_score FROM scored", "scored")
cte(
    "parts",
    f"""SELECT work_id, flags, points AS raw, least(80.0, points) AS capped, greatest(0.0, ROUND({WITH_SIGNAL}, 2) - least(80.0, points)) AS rest,
  unnest(CASE WHEN greatest(0.0, ROUND({WITH_SIGNAL}, 2) - least(80.0, points)) > 0.005 THEN list_append(flags, 'ensemble') ELSE flags END) AS part FROM flagged""",
    "flagged",
)
weights = "CASE part WHEN 'cost_outlier' THEN 30.0 WHEN 'stalled_work' THEN 25.0 WHEN 'expenditure_mismatch' THEN 25.0 ELSE 20.0 END"
oracle(
    "risk_breakdown",
    f"""SELECT work_id, part, ROUND(points, 6) AS points, ROUND(points / SUM(points) OVER (PARTITION BY work_id), 6) AS share, ROUND(capped_by, 6) AS capped_by
FROM (SELECT work_id, part, CAST(raw - capped AS DOUBLE) AS capped_by, CAST(CASE WHEN part = 'ensemble' THEN rest ELSE {weights} * capped / raw END AS DOUBLE) AS points FROM parts)""",
    "parts",
)
oracle(
    "risk_band_counts",
    """SELECT CASE WHEN len(flags) = 0 THEN 0 WHEN risk_score > 75 THEN 4 WHEN risk_score > 50 THEN 3 WHEN risk_score > 25 THEN 2 ELSE 1 END AS band,
  COUNT(*) AS works FROM scored GROUP BY 1""",
    "scored",
)
cte(
    "runs",
    """SELECT work_id, risk_score AS a, coalesce(sanctioned_amount_inr, 0.0) AS b FROM scored""",
    "scored",
)
cte(
    "run_ranks",
    """SELECT work_id, RANK() OVER (ORDER BY a) + (COUNT(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, RANK() OVER (ORDER BY b) + (COUNT(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb,
  ROW_NUMBER() OVER (ORDER BY a DESC, work_id) <= 1000 AS ta, ROW_NUMBER() OVER (ORDER BY b DESC, work_id) <= 1000 AS tb FROM runs""",
    "runs",
)
oracle(
    "rank_stability",
    """SELECT ROUND(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 6) AS spearman, ROUND(COUNT(*) FILTER (ta AND tb) / CAST(COUNT(*) FILTER (ta OR tb) AS DOUBLE), 6) AS jaccard_top_k FROM run_ranks""",
    "run_ranks",
)

forest_ctes("forest", (42,), 200)
cte("isolation", f"SELECT p, pow(2.0, -SUM(depth) / 200 / {NORMAL}) AS isolation FROM forest_paths GROUP BY p", "forest_paths")
oracle(
    "isolation_forest",
    "SELECT s AS point_sanctioned, e AS point_spent, m AS point_months, weight, ROUND(isolation, 6) AS isolation FROM points JOIN isolation USING (p)",
    "isolation",
)


def unit(x: str) -> str:
    return f"CASE WHEN MAX({x}) OVER () - MIN({x}) OVER () < 1e-12 THEN 0.0 ELSE ({x} - MIN({x}) OVER ()) / (MAX({x}) OVER () - MIN({x}) OVER ()) END"


cte("ensemble", f"SELECT s, e, m, ({unit('isolation')} + {unit('f')}) / 2 AS ensemble FROM points JOIN isolation USING (p) JOIN factor USING (p)", "isolation", "factor")
oracle("ensemble_score", "SELECT s AS point_sanctioned, e AS point_spent, m AS point_months, ROUND(ensemble, 6) AS ensemble FROM ensemble", "ensemble")
oracle(
    "score_all",
    """SELECT work_id, ROW_NUMBER() OVER (ORDER BY score DESC, work_id) AS inspection_rank, score AS risk_score, array_to_string(flags, ',') AS flags, concat('{', coalesce(why, ''), '}') AS why_flagged,
  CASE WHEN len(flags) > 0 THEN concat('{"label":"', peer_label, '","n":', peer_n, '}') END AS peer_group
FROM (SELECT f.*, ROUND(least(100.0, least(80, points) + 20 * greatest(0.0, least(1.0, ensemble))), 2) AS score FROM flagged f JOIN raw_features r USING (work_id) JOIN ensemble x ON x.s = r.s AND x.e = r.e AND x.m = r.m)
LEFT JOIN (SELECT work_id, string_agg(concat('"', flag, '":"', sentence, '"'), ',' ORDER BY list_position(flags, flag)) AS why FROM sentences JOIN flagged USING (work_id) GROUP BY 1) USING (work_id)""",
    "flagged",
    "ensemble",
    "sentences",
)
forest_ctes("trial", (42, 99), 100)
cte(
    "trial_runs",
    f"""SELECT size, seed, work_id, score, RANK() OVER (PARTITION BY size, seed ORDER BY score) + (COUNT(*) OVER (PARTITION BY size, seed, score) - 1) / 2.0 AS place,
  ROW_NUMBER() OVER (PARTITION BY size, seed ORDER BY score DESC, work_id) <= 1000 AS top FROM (
  SELECT p, seed, size, ROUND(pow(2.0, -SUM(depth) / size / {NORMAL}), 9) AS score FROM trial_paths, (SELECT unnest([25, 50, 100]) AS size) WHERE tree < size GROUP BY p, seed, size)
JOIN points USING (p) JOIN raw_features USING (s, e, m)""",
    "trial_paths",
    "raw_features",
)
oracle(
    "forest_stability",
    """SELECT size AS trees, ROUND(corr(a.place, b.place), 6) AS spearman, ROUND(COUNT(*) FILTER (a.top AND b.top) / CAST(COUNT(*) FILTER (a.top OR b.top) AS DOUBLE), 6) AS jaccard_top_k
FROM (SELECT * FROM trial_runs WHERE seed = 42) a JOIN (SELECT * FROM trial_runs WHERE seed = 99) b USING (size, work_id) GROUP BY size""",
    "trial_runs",
)

# -- fund flow --------------------------------------------------------------------------------

SLUG = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_')"
cte(
    "facts",
    f"""SELECT work_id, mp_name, implementing_agency AS agency_name, vendor_name, concat('mp_', {SLUG.format(x='mp_name')}) AS mp_id,
  CASE WHEN implementing_agency IS NOT NULL THEN concat('agency_', {SLUG.format(x='implementing_agency')}) END AS agency_id,
  CASE WHEN vendor_id IS NOT NULL THEN concat('vendor_', vendor_id) END AS vendor_node, coalesce(sanctioned_amount_inr, 0.0) AS amount, len(flags) > 0 AS flagged FROM scored""",
    "scored",
)
cte(
    "nodes",
    """SELECT mp_id AS id, 'MP' AS type, arg_min(mp_name, work_id) AS label, CAST(COUNT(*) FILTER (flagged) AS DOUBLE) AS risk_weight FROM facts GROUP BY 1
UNION ALL SELECT agency_id, 'Agency', arg_min(agency_name, work_id), CAST(COUNT(*) FILTER (flagged) AS DOUBLE) FROM facts WHERE agency_id IS NOT NULL GROUP BY 1
UNION ALL SELECT vendor_node, 'Vendor', mode(vendor_name), CAST(COUNT(*) FILTER (flagged) AS DOUBLE) FROM facts WHERE vendor_node IS NOT NULL GROUP BY 1""",
    "facts",
)
cte(
    "edge_rows",
    """SELECT mp_id AS source, agency_id AS target, 'MP' AS source_type, work_id, amount, flagged FROM facts WHERE agency_id IS NOT NULL
UNION ALL SELECT agency_id, vendor_node, 'Agency', work_id, amount, flagged FROM facts WHERE agency_id IS NOT NULL AND vendor_node IS NOT NULL""",
    "facts",
)
EDGE = f"COUNT(*) AS work_count, {rupees('amount')} AS total_amount_inr, COUNT(*) FILTER (flagged) AS flagged_work_count"
cte("edges", f"SELECT source, target, source_type, {EDGE} FROM edge_rows GROUP BY 1, 2, 3", "edge_rows")
oracle("graph_nodes", "SELECT * FROM nodes", "nodes")
oracle("graph_edges", "SELECT * FROM edges", "edges")
oracle(
    "graph_edge_work_ids",
    """SELECT source, target, CAST(part AS INT) AS part, string_agg(work_id, ',' ORDER BY work_id) AS work_ids FROM (
  SELECT source, target, work_id, (ROW_NUMBER() OVER (PARTITION BY source, target ORDER BY work_id) - 1) // 10000 AS part FROM edge_rows) GROUP BY 1, 2, 3""",
    "edge_rows",
)
oracle(
    "graph_integrity",
    """SELECT 'source' AS "end", source, target FROM edges WHERE source = 'mp_mp_7'""",
    "edges",
)
cte(
    "members",
    """SELECT target AS id, 'Agency' AS type, COUNT(*) AS members FROM edges WHERE source_type = 'MP' GROUP BY 1
UNION ALL SELECT v.target, 'Vendor', COUNT(DISTINCT m.source) FROM edges v JOIN edges m ON m.target = v.source AND m.source_type = 'MP' WHERE v.source_type = 'Agency' GROUP BY 1""",
    "edges",
)
cte(
    "eligible",
    """SELECT n.id, n.type, n.label, coalesce(m.members, 0) AS members FROM nodes n
JOIN (SELECT id, SUM(work_count) AS works FROM (SELECT source AS id, work_count FROM edges UNION ALL SELECT target, work_count FROM edges) GROUP BY 1 HAVING SUM(work_count) >= 5) b ON b.id = n.id
LEFT JOIN members m ON m.id = n.id WHERE n.type <> 'MP'""",
    "nodes",
    "members",
)
oracle(
    "concentration_clusters",
    """SELECT id AS node_id, label, members, concat(label, ' is connected to ', members, ' distinct MPs, ', printf('%.1f', (members - mean) / std),
  ' standard deviations above the average of ', printf('%.1f', mean), ' among ', lower(type), 's with at least 5 works recorded.') AS reason
FROM eligible JOIN (SELECT type, AVG(members) AS mean, STDDEV_SAMP(members) AS std FROM eligible GROUP BY 1) USING (type) WHERE std > 0 AND (members - mean) / std > 2.0""",
    "eligible",
)
cte(
    "concentrations",
    f"""SELECT n.id AS vendor_id, n.label AS vendor_label, coalesce(m, 0) AS member_count, coalesce(a, 0) AS agency_count, coalesce(w, 0) AS work_count,
  coalesce(r, 0.0) AS sanctioned_inr, coalesce(f, 0) AS flagged_work_count FROM nodes n LEFT JOIN (
  SELECT vendor_node, COUNT(DISTINCT mp_id) AS m, COUNT(DISTINCT agency_id) AS a, COUNT(*) AS w, {rupees('amount')} AS r, COUNT(*) FILTER (flagged) AS f
  FROM facts WHERE agency_id IS NOT NULL AND vendor_node IS NOT NULL GROUP BY 1) v ON v.vendor_node = n.id WHERE n.type = 'Vendor'""",
    "nodes",
)
oracle("vendor_concentration", "SELECT * FROM concentrations", "concentrations")
oracle(
    "vendor_match",
    """SELECT *, (SELECT COUNT(*) FROM concentrations WHERE member_count >= 75) AS matching_count FROM concentrations WHERE member_count >= 75
ORDER BY member_count DESC, vendor_label, vendor_id LIMIT 10""",
    "concentrations",
)
oracle("vendor_median", "SELECT CAST(coalesce(floor(median(member_count) + 0.5), 0) AS BIGINT) AS median_member_count FROM concentrations", "concentrations")
cte("cluster_paid", "SELECT * FROM edge_rows WHERE source_type = 'Agency' AND target IN ('vendor_3', 'vendor_7')", "edge_rows")
cte(
    "cluster_member_edges",
    f"""SELECT source, target, source_type, {EDGE} FROM edge_rows e WHERE source_type = 'MP' AND EXISTS (
  SELECT 1 FROM edge_rows x JOIN cluster_paid p ON p.source = x.target AND p.work_id = x.work_id WHERE x.source_type = 'MP' AND x.source = e.source AND x.target = e.target) GROUP BY 1, 2, 3""",
    "cluster_paid",
)
cte("cluster_edges", f"SELECT * FROM cluster_member_edges UNION ALL SELECT source, target, source_type, {EDGE} FROM cluster_paid GROUP BY 1, 2, 3", "cluster_member_edges")
oracle(
    "vendor_cluster",
    """SELECT 'node' AS kind, id AS a, '' AS b, CAST(0 AS BIGINT) AS work_count FROM nodes WHERE id IN (SELECT source FROM cluster_edges UNION SELECT target FROM cluster_edges) OR id IN ('vendor_3', 'vendor_7')
UNION ALL SELECT 'edge', source, target, work_count FROM cluster_edges""",
    "nodes",
    "cluster_edges",
)
oracle(
    "cluster_restrict",
    f"""SELECT e.source, e.target, e.source_type, {EDGE.replace('amount', 'e.amount').replace('total_e.amount', 'total_amount').replace('(flagged)', '(e.flagged)')}
FROM edge_rows e JOIN cluster_paid p ON p.source = e.target AND p.work_id = e.work_id WHERE e.source_type = 'MP' GROUP BY 1, 2, 3
UNION ALL SELECT source, target, source_type, {EDGE} FROM cluster_paid GROUP BY 1, 2, 3""",
    "cluster_paid",
)
oracle(
    "graph_totals",
    f"""SELECT COUNT(*) FILTER (type = 'MP') AS mp_count, COUNT(*) FILTER (type = 'Agency') AS agency_count, COUNT(*) FILTER (type = 'Vendor') AS vendor_count,
  (SELECT {rupees('total_amount_inr')} FROM edges WHERE source_type = 'Agency') AS flow_inr FROM nodes""",
    "nodes",
    "edges",
)
cte(
    "seeds",
    """SELECT id FROM nodes WHERE (type = 'Agency' AND contains(lower(label), 'ag-39')) OR (type = 'Vendor' AND contains(lower(label), 'supplier#000000001'))""",
    "nodes",
)
cte("hop", "SELECT * FROM edges WHERE source IN (SELECT id FROM seeds) OR target IN (SELECT id FROM seeds)", "seeds", "edges")
oracle(
    "graph_one_hop",
    """SELECT 'node' AS kind, id AS a, '' AS b FROM nodes WHERE id IN (SELECT id FROM seeds UNION SELECT source FROM hop UNION SELECT target FROM hop)
UNION ALL SELECT 'edge', source, target FROM hop""",
    "hop",
)
oracle(
    "graph_reach_counts",
    """SELECT COUNT(*) FILTER (type = 'Agency' AND members >= 3) AS agencies_wide, COUNT(*) FILTER (type = 'Vendor' AND members >= 3) AS vendors_wide FROM members""",
    "members",
)
cte(
    "ribbon",
    """SELECT id, type, ROW_NUMBER() OVER (PARTITION BY type ORDER BY greatest(coalesce(o, 0.0), coalesce(i, 0.0)) DESC, label, id) AS rn, COUNT(*) OVER (PARTITION BY type) AS cnt FROM nodes
LEFT JOIN (SELECT source, CAST(SUM(CAST(greatest(0.0, total_amount_inr) AS DECIMAL(28,4))) AS DOUBLE) AS o FROM edges GROUP BY 1) ON source = id
LEFT JOIN (SELECT target, CAST(SUM(CAST(greatest(0.0, total_amount_inr) AS DECIMAL(28,4))) AS DOUBLE) AS i FROM edges GROUP BY 1) ON target = id""",
    "nodes",
    "edges",
)
cte("fold", "SELECT id, CASE WHEN cnt <= 7 OR rn <= 6 THEN id ELSE concat('more:', type) END AS shown FROM ribbon", "ribbon")
oracle(
    "flow_fold_topk",
    f"""SELECT *, CASE WHEN work_count <= 0 OR flagged_work_count <= 0 THEN 'plain' WHEN flagged_work_count >= work_count THEN 'high' ELSE 'elevated' END AS tier FROM (
  SELECT a.shown AS source, b.shown AS target, {rupees('greatest(0.0, total_amount_inr)')} AS amount, CAST(SUM(work_count) AS BIGINT) AS work_count,
    CAST(SUM(flagged_work_count) AS BIGINT) AS flagged_work_count FROM edges e JOIN fold a ON a.id = e.source JOIN fold b ON b.id = e.target GROUP BY 1, 2)""",
    "fold",
    "edges",
)
cte(
    "alias_works",
    """SELECT work_id, vendor_id, CASE WHEN CAST(vendor_id AS BIGINT) % 5 IN (0, 1) AND CAST(work_id AS BIGINT) % 11 = 0 THEN concat(shared, ' & Co') ELSE shared END AS vendor_name FROM (
  SELECT work_id, vendor_id, CASE WHEN CAST(vendor_id AS BIGINT) % 5 IN (0, 2) THEN concat('V', CAST(vendor_id AS BIGINT) % 7) ELSE vendor_name END AS shared FROM works WHERE vendor_id IS NOT NULL)""",
    "works",
)
cte(
    "alias_pairs",
    """SELECT vendor_id, vendor_name, COUNT(*) AS pair, COUNT(*) OVER (PARTITION BY vendor_id) AS names, COUNT(*) OVER (PARTITION BY vendor_name) AS ids FROM alias_works GROUP BY 1, 2""",
    "alias_works",
)
cte(
    "alias_rows",
    """SELECT DISTINCT p.vendor_id AS proposed_canonical_id, p.vendor_name AS alias_label, w.work_id FROM alias_pairs p JOIN alias_works w
ON (p.names > 1 AND w.vendor_id = p.vendor_id) OR (p.ids > 1 AND w.vendor_name = p.vendor_name)""",
    "alias_pairs",
)
oracle(
    "alias_candidates",
    """SELECT 'vendor' AS entity_type, proposed_canonical_id, alias_label, CASE WHEN any_value(names) > 1 AND any_value(ids) > 1 THEN 'identifier_and_label_ambiguous'
  WHEN any_value(names) > 1 THEN 'identifier_has_multiple_labels' ELSE 'label_has_multiple_identifiers' END AS reason, COUNT(*) AS evidence_count
FROM alias_rows JOIN alias_pairs ON vendor_id = proposed_canonical_id AND vendor_name = alias_label GROUP BY 2, 3""",
    "alias_rows",
)
oracle(
    "alias_evidence",
    """SELECT DISTINCT 'identifier' AS kind, vendor_id AS key, work_id FROM alias_works SEMI JOIN (SELECT vendor_id FROM alias_pairs WHERE names > 1) USING (vendor_id)
UNION ALL SELECT DISTINCT 'label', vendor_name, work_id FROM alias_works SEMI JOIN (SELECT vendor_name FROM alias_pairs WHERE ids > 1) USING (vendor_name)""",
    "alias_pairs",
    "alias_works",
)
oracle(
    "contract_cross_checks",
    """SELECT "check", COUNT(*) AS findings, COUNT(DISTINCT subject) AS subjects FROM (
  SELECT 'scored_without_work' AS "check", work_id AS subject FROM works WHERE implementing_agency IS NULL
  UNION ALL SELECT 'edge_source_unknown', concat(source, '->', target) FROM edges WHERE source = 'mp_mp_7') GROUP BY 1""",
    "edges",
)

# -- duplicates -------------------------------------------------------------------------------

CANON = "trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g'))"
cte(
    "docs",
    f"""SELECT CAST(doc_id AS VARCHAR) AS work_id, source, lang, text, {CANON.format(x='text')} AS canonical, n_chars * 1000.0 AS amount,
  concat('AG-', doc_id % 7) AS agency, CASE doc_id % 3 WHEN 0 THEN 'Completed' WHEN 1 THEN 'In Progress' ELSE 'Sanctioned' END AS status,
  DATE '2000-01-01' + CAST(doc_id % 700 AS INT) AS sanction_date FROM documents""",
)
cte("described", "SELECT *, sha256(canonical)[1:16] AS fingerprint FROM docs WHERE canonical <> ''", "docs")
cte(
    "grouped_texts",
    """SELECT 'constituency' AS scope_kind, source AS scope, fingerprint, COUNT(*) AS work_count, COUNT(DISTINCT source) AS constituency_count, MAX(amount) AS largest, SUM(amount) AS total, MIN(source) AS c_first, MAX(source) AS c_last FROM described GROUP BY 2, 3
UNION ALL SELECT 'authority', lang, fingerprint, COUNT(*), COUNT(DISTINCT source), MAX(amount), SUM(amount), MIN(source), MAX(source) FROM described GROUP BY 2, 3""",
    "described",
)
oracle("text_groups", "SELECT scope_kind, scope, fingerprint, work_count, constituency_count FROM grouped_texts", "grouped_texts")


def summary(kind: str, scope: str, members: str = "") -> str:
    statuses = "concat_ws(',', " + ", ".join(
        f"CASE WHEN COUNT(*) FILTER (status = {q(s)}) > 0 THEN concat({q(s + '=')}, COUNT(*) FILTER (status = {q(s)})) END"
        for s in STATUSES
    ) + ")"
    usual = lambda c: f"(SELECT {c} FROM described u WHERE u.{scope} = d.{scope} AND u.fingerprint = d.fingerprint GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)"
    return f"""SELECT {q(kind)} AS scope_kind, {scope} AS scope, fingerprint, {usual('text')} AS text, {usual('lang')} AS activity,{members}
  array_to_string(list_sort(list(DISTINCT source)), ',') AS constituencies, array_to_string(list_sort(list(DISTINCT agency)), ',') AS agencies,
  COUNT(DISTINCT source) AS constituencies_count, COUNT(DISTINCT agency) AS agencies_count, COUNT(*) AS work_count,
  ROUND(MIN(amount), 2) AS amount_min_inr, ROUND(MAX(amount), 2) AS amount_max_inr, {rupees('amount')} AS amount_total_inr,
  CAST(MIN(sanction_date) AS VARCHAR) AS sanction_date_first, CAST(MAX(sanction_date) AS VARCHAR) AS sanction_date_last, {statuses} AS statuses
FROM described d GROUP BY {scope}, fingerprint"""


cte("summaries", summary("constituency", "source"), "described")
MEMBERS = "\n  array_to_string(list_sort(list(work_id)), ',') AS work_ids,"
oracle("text_group_summary", f"{summary('constituency', 'source', MEMBERS)} UNION ALL {summary('authority', 'lang', MEMBERS)}", "described")

oracle(
    "text_group_names",
    " UNION ALL ".join(
        f"""SELECT {q(kind)} AS scope_kind, {scope} AS scope, fingerprint, {q(name)} AS list, 0 AS part, array_to_string(list_sort(list(DISTINCT {column})), ',') AS names
FROM described WHERE {column} <> '' GROUP BY {scope}, fingerprint"""
        for kind, scope in (("constituency", "source"), ("authority", "lang"))
        for name, column in (("constituencies", "source"), ("agencies", "agency"))
    ),
    "described",
)


def batches(finder: str, kind: str, having: str) -> str:
    return f"""SELECT sha256(concat_ws('|', {q(FINDER_VERSION)}, {q(finder)}, scope, fingerprint))[1:16] AS candidate_id, {q(finder)} AS finder, scope, fingerprint, work_count,
  largest < 1500000 AND total >= 2500000 AS threshold_crossing_batch FROM grouped_texts WHERE scope_kind = {q(kind)} AND {having}"""


cte("identical", batches("identical_batch", "constituency", "work_count >= 2"), "grouped_texts")
cte("district_identical", batches("district_identical_batch", "authority", "constituency_count >= 2"), "grouped_texts")
oracle("identical_batches", "SELECT * FROM identical", "identical")
oracle("district_identical_batches", "SELECT * FROM district_identical", "district_identical")
cte("distinct_texts", "SELECT DISTINCT canonical, fingerprint, ROW_NUMBER() OVER (ORDER BY canonical) AS t FROM (SELECT DISTINCT canonical, fingerprint FROM described)", "described")
cte("text_words", "SELECT t, word, COUNT(*) AS n FROM (SELECT t, unnest(string_split(canonical, ' ')) AS word FROM distinct_texts) GROUP BY 1, 2", "distinct_texts")
cte(
    "piece_rows",
    """SELECT t, n, concat(' ', word, ' ')[i : i + size - 1] AS gram FROM text_words, (VALUES (3), (4), (5)) s(size), LATERAL (SELECT unnest(range(1, CAST(length(word) + 4 - size AS BIGINT))) AS i)""",
    "text_words",
)
cte("tf", "SELECT t, gram, SUM(n) AS tf FROM piece_rows GROUP BY 1, 2", "piece_rows")
cte("idf", "SELECT gram, COUNT(*) AS df, ln((1.0 + (SELECT COUNT(*) FROM distinct_texts)) / (1.0 + COUNT(*))) + 1 AS idf FROM tf GROUP BY 1", "tf", "distinct_texts")
oracle(
    "char_tfidf",
    "SELECT gram, any_value(df) AS df, ROUND(any_value(idf), 6) AS idf, ROUND(SUM(tf * idf), 4) AS mass FROM tf JOIN idf USING (gram) GROUP BY 1",
    "tf",
    "idf",
)
cte(
    "vectors",
    """SELECT t, hash(gram) AS gram, tf * idf / sqrt(SUM(tf * idf * tf * idf) OVER (PARTITION BY t)) AS w FROM tf JOIN idf USING (gram)""",
    "tf",
    "idf",
)
cte("tokens", "SELECT t, list_sort(list_distinct(string_split(canonical, ' '))) AS tokens FROM distinct_texts", "distinct_texts")


def pair_ctes(prefix: str, scope: str) -> None:
    cte(f"{prefix}_members", f"SELECT DISTINCT {scope} AS scope, t, MIN(source) OVER (PARTITION BY {scope}, t) AS c_first, MAX(source) OVER (PARTITION BY {scope}, t) AS c_last FROM described JOIN distinct_texts USING (canonical, fingerprint)", "distinct_texts")
    cte(
        f"{prefix}_cosines",
        f"""SELECT a.scope, a.t AS a, b.t AS b, ROUND(SUM(a.w * b.w), 4) AS cosine FROM (SELECT scope, t, gram, w FROM {prefix}_members JOIN vectors USING (t)) a
JOIN (SELECT scope, t, gram, w FROM {prefix}_members JOIN vectors USING (t)) b ON a.scope = b.scope AND a.gram = b.gram AND a.t < b.t GROUP BY 1, 2, 3""",
        f"{prefix}_members",
        "vectors",
    )
    cte(
        f"{prefix}_overlaps",
        f"""SELECT c.*, len(list_intersect(x.tokens, y.tokens)) AS shared, len(x.tokens) + len(y.tokens) AS both_sizes
FROM {prefix}_cosines c JOIN tokens x ON x.t = a JOIN tokens y ON y.t = b""",
        f"{prefix}_cosines",
        "tokens",
    )
    cte(
        f"{prefix}_pairs",
        f"""SELECT scope, a, b, cosine, CAST(printf('%.4f', shared / CAST(both_sizes - shared AS DOUBLE)) AS DOUBLE) AS jaccard, cosine >= 0.8 AS by_character,
  shared >= 3 AND ROUND(shared / CAST(both_sizes - shared AS DOUBLE), 4) >= 0.75 AS by_token FROM {prefix}_overlaps""",
        f"{prefix}_overlaps",
    )
    cte(
        f"{prefix}_near",
        f"""SELECT sha256(concat_ws('|', {q(FINDER_VERSION)}, 'near_copy', scope, x.fingerprint, y.fingerprint))[1:16] AS candidate_id, 'near_copy' AS finder, scope,
  a, b, x.fingerprint AS fingerprint_a, y.fingerprint AS fingerprint_b, cosine AS character_similarity, jaccard AS token_overlap,
  concat_ws(',', CASE WHEN by_character THEN 'character' END, CASE WHEN by_token THEN 'token' END) AS hits
FROM {prefix}_pairs JOIN distinct_texts x ON x.t = a JOIN distinct_texts y ON y.t = b WHERE by_character OR by_token""",
        f"{prefix}_pairs",
    )


pair_ctes("lang", "lang")
pair_ctes("source", "source")
oracle("near_copy_pairs", "SELECT * EXCLUDE (a, b) FROM lang_near", "lang_near")
cte(
    "district_near",
    f"""SELECT sha256(concat_ws('|', {q(FINDER_VERSION)}, 'district_near_copy', c.scope, x.fingerprint, y.fingerprint))[1:16] AS candidate_id, 'district_near_copy' AS finder, c.scope,
  x.fingerprint AS fingerprint_a, y.fingerprint AS fingerprint_b, cosine AS character_similarity, 'character' AS hits FROM lang_cosines c
JOIN lang_members m ON m.scope = c.scope AND m.t = a JOIN lang_members n ON n.scope = c.scope AND n.t = b
JOIN distinct_texts x ON x.t = a JOIN distinct_texts y ON y.t = b WHERE cosine >= 0.9 AND least(m.c_first, n.c_first) <> greatest(m.c_last, n.c_last)""",
    "lang_cosines",
)
oracle("district_near_copy_pairs", "SELECT * FROM district_near", "district_near")
cte(
    "differences",
    """SELECT n.*, list_sort(list_intersect(x.tokens, y.tokens)) AS s, list_sort([k FOR k IN x.tokens IF NOT list_contains(y.tokens, k)]) AS oa,
  list_sort([k FOR k IN y.tokens IF NOT list_contains(x.tokens, k)]) AS ob FROM source_near n JOIN tokens x ON x.t = a JOIN tokens y ON y.t = b""",
    "source_near",
    "tokens",
)
KIND = "CASE WHEN len(oa) = 0 AND len(ob) = 0 THEN 'reworded_match' WHEN len(oa) = 0 OR len(ob) = 0 THEN 'one_sided_detail' ELSE 'conflicting_detail' END"
oracle(
    "pair_difference",
    f"""SELECT scope, fingerprint_a, fingerprint_b, CAST(printf('%.4f', len(s) / CAST(len(s) + len(oa) + len(ob) AS DOUBLE)) AS DOUBLE) AS token_overlap, {KIND} AS difference_group,
  array_to_string(s, ',') AS shared_tokens, array_to_string(oa, ',') AS only_a_tokens, array_to_string(ob, ',') AS only_b_tokens FROM differences""",
    "differences",
)
cte("all_batches", "SELECT * FROM identical UNION ALL SELECT * FROM district_identical", "identical", "district_identical")
cte(
    "referenced",
    """SELECT 'constituency' AS scope_kind, scope, fingerprint FROM identical UNION SELECT 'authority', scope, fingerprint FROM district_identical
UNION SELECT 'constituency', scope, fingerprint_a FROM source_near UNION SELECT 'constituency', scope, fingerprint_b FROM source_near
UNION SELECT 'authority', scope, fingerprint_a FROM district_near UNION SELECT 'authority', scope, fingerprint_b FROM district_near""",
    "all_batches",
    "source_near",
    "district_near",
)
oracle(
    "duplicate_counts",
    f"""SELECT (SELECT COUNT(*) FROM described) AS works_considered, (SELECT COUNT(*) FROM referenced) AS groups, (SELECT COUNT(*) FROM identical) AS identical_batches,
  (SELECT COUNT(*) FROM identical WHERE threshold_crossing_batch) AS threshold_crossing_batches, (SELECT COUNT(*) FROM district_identical) AS district_identical_batches,
  COUNT(*) AS near_copy_pairs, COUNT(*) FILTER ({KIND} = 'reworded_match') AS reworded_match, COUNT(*) FILTER ({KIND} = 'one_sided_detail') AS one_sided_detail,
  COUNT(*) FILTER ({KIND} = 'conflicting_detail') AS conflicting_detail, (SELECT COUNT(*) FROM district_near) AS district_near_copy_pairs FROM differences""",
    "referenced",
    "differences",
)
oracle(
    "duplicate_integrity",
    "SELECT 'unreferenced_group' AS problem, scope, fingerprint FROM grouped_texts g WHERE NOT EXISTS (SELECT 1 FROM referenced r WHERE r.scope_kind = g.scope_kind AND r.scope = g.scope AND r.fingerprint = g.fingerprint)",
    "referenced",
)

oracle(
    "snapshot_write",
    """SELECT *, TRUE AS complete FROM (SELECT 'works' AS "table", COUNT(*) AS rows FROM works UNION ALL SELECT 'scored', COUNT(*) FROM works UNION ALL SELECT 'nodes', COUNT(*) FROM nodes
UNION ALL SELECT 'edges', COUNT(*) FROM edges UNION ALL SELECT 'edge_works', COUNT(*) FROM edge_rows
UNION ALL SELECT 'alias_candidates', COUNT(*) FROM alias_pairs WHERE names > 1 OR ids > 1
UNION ALL SELECT 'duplicate_groups', COUNT(*) FROM grouped_texts UNION ALL SELECT 'duplicate_batches', COUNT(*) FROM all_batches
UNION ALL SELECT 'duplicate_pairs', (SELECT COUNT(*) FROM source_near) + (SELECT COUNT(*) FROM district_near))""",
    "nodes",
    "edges",
    "alias_pairs",
    "referenced",
)

# -- judged pairs -----------------------------------------------------------------------------

LINE = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
cte(
    "items",
    f"""SELECT n.scope, n.fingerprint_a, n.fingerprint_b, text_a, text_b, activity_a, activity_b,
  sha256(concat('[', concat_ws(', ', to_json(n.scope), to_json(text_a), to_json(activity_a), to_json(text_b), to_json(activity_b)), ']'))[1:16] AS input_fingerprint
FROM (SELECT scope, fingerprint_a, fingerprint_b FROM source_near) n
JOIN (SELECT scope, fingerprint AS fingerprint_a, {LINE.format(x='text')} AS text_a, activity AS activity_a FROM summaries) USING (scope, fingerprint_a)
JOIN (SELECT scope, fingerprint AS fingerprint_b, {LINE.format(x='text')} AS text_b, activity AS activity_b FROM summaries) USING (scope, fingerprint_b)""",
    "source_near",
    "summaries",
)
oracle("judge_items", "SELECT * FROM items", "items")
cte("digits", "SELECT *, CAST(concat('0x', fingerprint_a[1:2]) AS INT) AS da, CAST(concat('0x', fingerprint_b[1:2]) AS INT) AS db FROM items", "items")
cte(
    "judgments",
    """SELECT *, CASE WHEN da % 11 = 0 THEN 'rejected' ELSE 'judged' END AS status,
  CASE WHEN da % 11 = 0 THEN NULL WHEN db % 5 = 0 THEN 'not_enough_detail' WHEN db % 5 = 1 THEN 'different_asset' ELSE 'same_asset_same_place' END AS relation,
  CASE WHEN da % 3 = 0 THEN 'Gram village, WARD' ELSE concat('ward ', text_a[1:8]) END AS place, CASE WHEN db % 7 = 0 THEN 'm2' ELSE 'm1' END AS model_id
FROM digits WHERE da % 13 <> 0""",
    "digits",
)
cte("todo", "SELECT scope, fingerprint_a, fingerprint_b FROM digits WHERE da % 13 = 0 OR db % 7 = 0", "digits")
oracle("judge_pending", "SELECT * FROM todo", "todo")
oracle(
    "judge_pending_sample",
    """SELECT scope, fingerprint_a, fingerprint_b FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY scope, fingerprint_a, fingerprint_b) - 1 AS n, greatest(1, COUNT(*) OVER () // 20) AS step FROM todo)
WHERE n % step = 0 AND n < step * 20""",
    "todo",
)
oracle(
    "judge_verify",
    f"""SELECT doc_id, CASE
  WHEN asset IS NOT NULL AND NOT contains(text, asset) THEN 'asset_a_not_in_text'
  WHEN place_a IS NOT NULL AND (trim(place_a) = '' OR NOT contains(text, place_a)) THEN 'place_a_not_in_text'
  WHEN place_b IS NOT NULL AND (trim(place_b) = '' OR NOT contains(passage, place_b)) THEN 'place_b_not_in_text'
  WHEN same AND (place_a IS NULL OR place_b IS NULL) THEN 'same_place_without_quotes'
  WHEN same AND {CANON.format(x='place_a')} = '' THEN 'place_quote_without_words'
  WHEN same AND {CANON.format(x='place_a')} <> {CANON.format(x='place_b')} THEN 'place_quotes_differ' ELSE 'holds' END AS verdict
FROM (SELECT doc_id, d.text, b.text AS passage, doc_id % 10 <> 0 AS same, CASE WHEN doc_id % 5 = 0 THEN b.text END AS asset,
  CASE doc_id % 5 WHEN 1 THEN d.text[1:12] WHEN 2 THEN '.' WHEN 3 THEN d.text[1:12] WHEN 4 THEN 'o' END AS place_a,
  CASE doc_id % 5 WHEN 2 THEN '.' WHEN 3 THEN b.text[1:12] WHEN 4 THEN 'O' END AS place_b
FROM documents d JOIN benchmark b ON d.doc_id % (SELECT MAX(item_id) + 1 FROM benchmark) = b.item_id)""",
)
oracle(
    "judge_rates",
    """SELECT ROUND(100.0 * COUNT(*) FILTER (status = 'judged' AND relation = 'not_enough_detail') / COUNT(*), 1) AS abstention_rate,
  ROUND(100.0 * COUNT(*) FILTER (status = 'rejected') / COUNT(*), 1) AS quote_rejection_rate, COUNT(*) AS pairs_total FROM judgments""",
    "judgments",
)
PLACE_WORDS = "[k FOR k IN string_split(" + CANON.format(x="place") + ", ' ') IF k <> '' AND NOT list_contains([" + ", ".join(q(w) for w in PLACE_STOPLIST) + "], k)]"
MARKED = " OR ".join(f"contains({CANON.format(x='x.text')}, {q(m)}) OR contains({CANON.format(x='y.text')}, {q(m)})" for m in CONTINUATION_MARKERS)
cte(
    "from_judge",
    f"""SELECT j.scope, least(fingerprint_a, fingerprint_b) AS fingerprint_a, greatest(fingerprint_a, fingerprint_b) AS fingerprint_b, place AS quote_a, place AS quote_b,
  CASE WHEN NOT ({MARKED}) AND x.work_count = 1 AND y.work_count = 1
    AND abs(CAST(x.sanction_date_first AS DATE) - CAST(y.sanction_date_first AS DATE)) <= 365 AND x.amount_total_inr <> 0 AND y.amount_total_inr <> 0
    AND least(x.amount_total_inr, y.amount_total_inr) / greatest(x.amount_total_inr, y.amount_total_inr) >= 0.5 THEN 'duplicate_candidate' ELSE 'split_or_phase_candidate' END AS work_relation,
  x.work_count + y.work_count AS work_count
FROM judgments j JOIN summaries x ON x.scope = j.scope AND x.fingerprint = fingerprint_a JOIN summaries y ON y.scope = j.scope AND y.fingerprint = fingerprint_b
WHERE status = 'judged' AND relation = 'same_asset_same_place' AND len({PLACE_WORDS}) > 0""",
    "judgments",
)
oracle(
    "judged_candidates",
    f"""SELECT scope, fingerprint_a, fingerprint_b, {q(JUDGED_FINDER)} AS finder, {q(JUDGED_VERSION)} AS finder_version, quote_a, quote_b, work_relation, work_count FROM from_judge""",
    "from_judge",
)
oracle("work_relation", "SELECT work_relation, COUNT(*) AS pairs FROM from_judge GROUP BY 1", "from_judge")

# -- ledgers ----------------------------------------------------------------------------------

cte(
    "reviews",
    """SELECT conv_id * 100 + turn AS review_id, conv_id AS candidate_id, CASE WHEN role = 'user' THEN 'confirmed_same' ELSE 'rejected_different' END AS status,
  role AS reviewed_by, CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 END AS supersedes, turn FROM conversations""",
)
oracle(
    "review_resolve",
    """SELECT candidate_id, status AS current_status, review_id FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY candidate_id ORDER BY review_id DESC) AS rn FROM reviews r
  WHERE NOT EXISTS (SELECT 1 FROM reviews l WHERE l.supersedes = r.review_id AND l.turn <> 3)) WHERE rn = 1""",
    "reviews",
)
oracle("review_history", "SELECT candidate_id, review_id, status, reviewed_by FROM reviews", "reviews")
oracle(
    "candidate_upsert",
    """SELECT ROW_NUMBER() OVER (ORDER BY scope, fingerprint) AS candidate_id, scope, fingerprint AS fingerprint_a, finder, work_count FROM identical
UNION ALL SELECT (SELECT COUNT(*) FROM identical) + ROW_NUMBER() OVER (ORDER BY scope, fingerprint), scope, fingerprint, finder, work_count FROM district_identical""",
    "all_batches",
)
cte(
    "decisions",
    """SELECT *, CASE WHEN turn = 5 THEN 'unknown_status' WHEN turn = 6 THEN 'blank_reviewer' WHEN candidate_id % 2 = 1 THEN 'candidate_not_found' ELSE '' END AS problem
FROM reviews WHERE turn > 0""",
    "reviews",
)
cte(
    "appended",
    """SELECT review_id AS position, candidate_id, reviewed_by, (SELECT MAX(review_id) FROM reviews WHERE turn = 0) + ROW_NUMBER() OVER (ORDER BY review_id) AS new_id FROM decisions WHERE problem = ''""",
    "decisions",
)
oracle(
    "review_append",
    """SELECT position, candidate_id, reviewed_by, '' AS problem, new_id AS review_id,
  coalesce(LAG(new_id) OVER (PARTITION BY candidate_id ORDER BY position), candidate_id * 100) AS supersedes FROM appended
UNION ALL SELECT review_id, candidate_id, CASE WHEN turn = 6 THEN '  ' ELSE concat(' ', reviewed_by) END, problem, -1, -1 FROM decisions WHERE problem <> ''""",
    "appended",
)
oracle(
    "candidate_page",
    """SELECT candidate_id, CASE WHEN candidate_id % 3 = 0 THEN 'identical_batch' ELSE 'district_identical_batch' END AS finder, current_status, coalesce(n, 0) AS evidence_works, total,
  CAST(ceil(total / 10.0) AS BIGINT) AS total_pages FROM (
  SELECT candidate_id, arg_max(status, review_id) AS current_status, COUNT(*) OVER () AS total FROM reviews WHERE candidate_id % 3 IN (0, 1) GROUP BY 1)
LEFT JOIN (SELECT o_orderkey % 500 AS c, COUNT(*) AS n FROM orders GROUP BY 1) ON c = candidate_id ORDER BY candidate_id LIMIT 10 OFFSET 10""",
    "reviews",
)
cte(
    "standing",
    """SELECT candidate_id, arg_max(status, review_id) AS status FROM reviews r WHERE NOT EXISTS (SELECT 1 FROM reviews l WHERE l.supersedes = r.review_id) GROUP BY 1""",
    "reviews",
)
cte(
    "served",
    f"""SELECT c.*, coalesce(s.status, 'pending') AS status FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY finder, scope, fingerprint_a, fingerprint_b) AS candidate_id FROM (
    SELECT 'identical_batch' AS finder, i.scope, i.fingerprint AS fingerprint_a, i.fingerprint AS fingerprint_b, threshold_crossing_batch, text, CAST(NULL AS VARCHAR) AS text_b,
      CAST(NULL AS VARCHAR) AS quote_a, CAST(NULL AS VARCHAR) AS quote_b, CAST(NULL AS VARCHAR) AS work_relation FROM identical i JOIN summaries s ON s.scope = i.scope AND s.fingerprint = i.fingerprint
    UNION ALL SELECT {q(JUDGED_FINDER)}, j.scope, fingerprint_a, fingerprint_b, FALSE, x.text, y.text, quote_a, quote_b, work_relation FROM from_judge j
      JOIN summaries x ON x.scope = j.scope AND x.fingerprint = fingerprint_a JOIN summaries y ON y.scope = j.scope AND y.fingerprint = fingerprint_b)) c
LEFT JOIN standing s USING (candidate_id)""",
    "identical",
    "from_judge",
    "standing",
)
cte(
    "served_works",
    """SELECT DISTINCT candidate_id, work_id FROM served s JOIN described d ON d.source = s.scope AND d.fingerprint IN (s.fingerprint_a, s.fingerprint_b)""",
    "served",
)
cte(
    "context",
    """SELECT w.work_id, s.candidate_id, finder, threshold_crossing_batch, text, text_b, quote_a, quote_b, work_relation, status, n AS work_count, n - 1 AS other_work_count,
  ROW_NUMBER() OVER (PARTITION BY w.work_id ORDER BY s.candidate_id DESC) AS place
FROM served_works w JOIN served s USING (candidate_id) JOIN (SELECT candidate_id, COUNT(*) AS n FROM served_works GROUP BY 1) USING (candidate_id)""",
    "served_works",
)
oracle("duplicate_context", "SELECT * FROM context", "context")
cte(
    "shown_work",
    f"""SELECT CAST(coalesce(min(CAST(work_id AS BIGINT)), 42) AS VARCHAR) AS shown FROM served_works JOIN served USING (candidate_id) JOIN works USING (work_id) WHERE finder = {q(JUDGED_FINDER)}""",
    "served_works",
    "works",
)
oracle(
    "other_works",
    """SELECT shown AS work_id, m.candidate_id, m.work_id AS other_work_id, ROW_NUMBER() OVER (PARTITION BY m.candidate_id ORDER BY m.work_id) AS place
FROM shown_work JOIN served_works o ON o.work_id = shown JOIN served_works m ON m.candidate_id = o.candidate_id AND m.work_id <> shown""",
    "shown_work",
)
cte(
    "outcome_events",
    """SELECT event_id AS outcome_id, CAST(event_id % 50 AS VARCHAR) AS work_id, CAST(ts AS DATE) AS inspected_on, user_id AS inspector_id,
  CASE event_type WHEN 'view' THEN FALSE WHEN 'error' THEN NULL ELSE TRUE END AS issue, event_id % 3 = 0 AS in_control_sample FROM events""",
)
cte(
    "requests",
    """SELECT outcome_id AS id, work_id, inspected_on AS d, inspector_id AS who, CASE WHEN target >= 0 THEN target END AS sup,
    CASE WHEN inspected_on < DATE '2024-01-11' THEN -1 ELSE outcome_id END AS pos,
    CASE WHEN inspected_on < DATE '2024-01-11' THEN 'accepted' WHEN work_id = '13' THEN 'work_not_found' WHEN inspected_on > DATE '2024-01-29' THEN 'bad_date' END AS st
  FROM (SELECT *, CASE WHEN outcome_id % 3 = 0 AND outcome_id % 13 = 2 THEN outcome_id - 300 WHEN outcome_id % 3 = 0 THEN outcome_id - 150
    WHEN outcome_id % 11 = 5 THEN outcome_id - 149 WHEN outcome_id % 7 = 0 THEN outcome_id - 50 END AS target FROM outcome_events)""",
    "outcome_events",
)
# One request after the other: a row is decided once every earlier row that it depends on is.
cte(
    "acceptance",
    """SELECT 0 AS k, * FROM requests
  UNION ALL
  SELECT k + 1, id, work_id, d, who, sup, pos, CASE
      WHEN st IS NOT NULL THEN st
      WHEN sup IS NOT NULL AND (target_pos IS NULL OR target_pos >= pos OR target_work <> work_id OR coalesce(target_st, 'accepted') <> 'accepted') THEN 'invalid_supersedes'
      WHEN sup IS NOT NULL AND target_st IS NULL THEN NULL
      WHEN sup IS NOT NULL AND amended THEN 'already_superseded'
      WHEN sup IS NOT NULL AND first_amends < pos THEN NULL
      WHEN taken THEN 'duplicate_outcome'
      WHEN first_of_triple < pos THEN NULL
      ELSE 'accepted' END
  FROM (
    SELECT s.*, t.st AS target_st, t.pos AS target_pos, t.work_id AS target_work,
      bool_or(coalesce(s.st = 'accepted', false)) OVER (PARTITION BY s.sup) AS amended, min(CASE WHEN s.st IS NULL THEN s.pos END) OVER (PARTITION BY s.sup) AS first_amends,
      bool_or(coalesce(s.st = 'accepted', false)) OVER (PARTITION BY s.work_id, s.d, s.who) AS taken,
      min(CASE WHEN s.st IS NULL THEN s.pos END) OVER (PARTITION BY s.work_id, s.d, s.who) AS first_of_triple,
      count(*) FILTER (s.st IS NULL) OVER () AS waiting
    FROM acceptance s LEFT JOIN acceptance t ON t.id = s.sup)
  WHERE waiting > 0""",
    "requests",
)
oracle(
    "outcome_accept",
    """SELECT id AS outcome_id, st AS verdict FROM acceptance WHERE pos >= 0 AND k = (SELECT max(k) FROM acceptance)""",
    "acceptance",
)
oracle(
    "outcome_context",
    f"""SELECT work_id, before + 1 AS inspection_rank_at_time, n AS population_n_at_time, CASE WHEN n = 0 THEN 0 ELSE greatest(1, (n * 10 + 99) // 100) END AS cutoff_rank_at_time FROM (
  SELECT work_id, CAST(coalesce(SUM(CASE WHEN {UNDER} THEN 1 ELSE 0 END) OVER (PARTITION BY implementing_district_authority ORDER BY risk_score DESC, work_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    COUNT(*) FILTER ({UNDER}) OVER (PARTITION BY implementing_district_authority) AS n FROM scored)""",
    "scored",
)
cte(
    "recorded",
    """SELECT *, CASE WHEN outcome_id % 7 = 0 AND outcome_id >= 50 THEN outcome_id - 50 END AS supersedes, outcome_id % 40 + 1 AS rank_then FROM outcome_events""",
    "outcome_events",
)
AUTHORITY = "CASE WHEN outcome_id % 2 = 0 THEN concat('DA-', outcome_id % 5) ELSE concat('DA-', outcome_id % 9) END"
oracle(
    "outcome_read",
    f"""SELECT outcome_id, {AUTHORITY} AS implementing_district_authority, CASE WHEN outcome_id % 2 = 0 THEN concat('DA-', outcome_id % 9) END AS implementing_agency FROM recorded""",
    "recorded",
)
oracle(
    "outcome_history",
    f"""SELECT e.event_id AS outcome_id, work_id, CAST(inspected_on AS VARCHAR) AS inspected_on, CASE event_type WHEN 'view' THEN 'work_present_and_matches' WHEN 'click' THEN 'work_present_but_differs'
  WHEN 'error' THEN 'agency_unresponsive' WHEN 'purchase' THEN 'documentation_incomplete' ELSE 'work_not_found_at_site' END AS outcome, {AUTHORITY} AS implementing_district_authority
FROM recorded JOIN events e ON e.event_id = outcome_id WHERE work_id = '7'""",
    "recorded",
)
cte(
    "outcome_counts",
    """SELECT CASE WHEN in_control_sample THEN 'spot_check' ELSE 'ranked' END AS "group", COUNT(*) AS n, COUNT(issue) AS reached_work, COUNT(*) FILTER (issue) AS issues,
  COUNT(*) FILTER (rank_then <= 10) AS within_quota FROM recorded r WHERE NOT EXISTS (SELECT 1 FROM recorded l WHERE l.supersedes = r.outcome_id) GROUP BY 1""",
    "recorded",
)
oracle("outcome_groups", "SELECT * FROM outcome_counts", "outcome_counts")
Z2 = f"({WILSON_Z} * {WILSON_Z})"
oracle(
    "wilson_rate",
    f"""SELECT "group", reached_work, ROUND(p, 9) AS issue_rate, ROUND(greatest(0.0, centre - margin), 9) AS rate_low, ROUND(least(1.0, centre + margin), 9) AS rate_high, TRUE AS comparison_ready FROM (
  SELECT *, (p + {Z2} / (2 * k)) / (1 + {Z2} / k) AS centre, {WILSON_Z} * sqrt(p * (1 - p) / k + {Z2} / (4 * k * k)) / (1 + {Z2} / k) AS margin FROM (
    SELECT *, CAST(reached_work AS DOUBLE) AS k, issues / CAST(reached_work AS DOUBLE) AS p FROM outcome_counts))""",
    "outcome_counts",
)

# -- serving ----------------------------------------------------------------------------------

ROW = "work_id, state, constituency, vendor_id, inspection_rank, risk_score, array_to_string(flags, ',') AS flags, ROUND(sanctioned_amount_inr, 4) AS sanctioned_amount_inr"
WATCHED = f"({DAY} - sanction_date BETWEEN 0 AND 365 AND coalesce(sanctioned_amount_inr > 300000, FALSE))"
oracle("works_merged", f"SELECT {ROW}, CAST(last_updated AS VARCHAR) AS last_updated, len(flags) AS sentences FROM scored", "scored")
FILTERED = f"{UNDER} AND state IN ('ASIA', 'EUROPE') AND list_contains(flags, 'agency_concentration') AND {DAY} - sanction_date > 365"
oracle("works_filter", f"SELECT {ROW} FROM scored WHERE {FILTERED}", "scored")
oracle("works_filter_watch", f"SELECT {ROW} FROM scored WHERE {WATCHED} AND work_category = '5-LOW'", "scored")
FOUND = " OR ".join(
    f"contains(lower(coalesce({c}, '')), 'nation_1-da-2')"
    for c in ("work_id", "constituency", "implementing_district_authority", "implementing_agency", "mp_name", "state", "vendor_name", "vendor_id")
)
oracle("works_search", f"SELECT {ROW} FROM scored WHERE {FOUND}", "scored")
oracle("works_year_filter", f"SELECT {ROW} FROM scored WHERE financial_year = '1999-00'", "scored")
cte(
    "paged",
    f"""SELECT *, ROW_NUMBER() OVER (ORDER BY inspection_rank) AS display_rank, COUNT(*) OVER () AS total FROM scored WHERE {UNDER} AND state = 'ASIA' AND work_category = '2-HIGH'""",
    "scored",
)
oracle("works_page", f"SELECT {ROW}, display_rank FROM paged WHERE display_rank BETWEEN 26 AND 50", "paged")
oracle(
    "works_page_meta",
    """SELECT COUNT(*) AS total, CAST(ceil(COUNT(*) / 25.0) AS BIGINT) AS total_pages, (COUNT(*) * 10 + 99) // 100 AS quota_n, COUNT(*) FILTER (len(flags) > 0) AS flagged_total,
  COUNT(*) FILTER (len(flags) > 0 AND display_rank > (total * 10 + 99) // 100) AS flagged_beyond_quota FROM paged""",
    "paged",
)
oracle(
    "filtered_rank",
    f"""SELECT *, display_rank <= (COUNT(*) OVER () * 10 + 99) // 100 AS inside_quota FROM (
  SELECT work_id, inspection_rank, len(flags) > 0 AS flagged, ROW_NUMBER() OVER (ORDER BY inspection_rank) AS display_rank FROM scored WHERE {FILTERED})""",
    "scored",
)
DAYS = f"sanction_date - recommendation_date AS days_to_sanction, {DAY} - sanction_date AS days_since_sanction"
oracle(
    "work_day_counts",
    f"SELECT work_id, {DAYS}, greatest(0, {DAY} - last_updated) AS days_stale, {WATCHED} AS early_warning FROM works",
    "works",
)
oracle(
    "work_detail",
    f"""SELECT w.*, c.* EXCLUDE (work_id) FROM (SELECT {ROW}, {DAYS}, {WATCHED} AS early_warning FROM scored JOIN shown_work ON shown = work_id) w LEFT JOIN context c USING (work_id)""",
    "scored",
    "context",
    "shown_work",
)
facet = lambda name, value, detail="CAST(NULL AS VARCHAR)": f"SELECT '{name}' AS facet, {value} AS value, {detail} AS detail, COUNT(*) AS count FROM scored WHERE {UNDER} GROUP BY 2, 3"
oracle(
    "works_facets",
    " UNION ALL ".join(
        [
            facet("state", "state"),
            facet("category", "work_category"),
            facet("district_authority", "implementing_district_authority"),
            facet("constituency", "constituency", "mp_name"),
            facet("year", "financial_year"),
            *[f"SELECT 'flag', {q(f)}, NULL, COUNT(*) FILTER (list_contains(flags, {q(f)})) FROM scored WHERE {UNDER}" for f in FLAGS],
        ]
    ),
    "scored",
)
IDLE = f"{UNDER} AND expenditure_amount_inr = 0 AND (year(newest) * 12 + month(newest)) - (year(sanction_date) * 12 + month(sanction_date)) > 12"
cte(
    "summary",
    f"""SELECT COUNT(*) FILTER ({UNDER}) AS works_under_implementation, COUNT(*) FILTER ({UNDER} AND len(flags) > 0) AS flagged_count,
  {rupees('sanctioned_amount_inr', UNDER + ' AND len(flags) > 0')} AS total_flagged_amount_inr, {rupees('sanctioned_amount_inr', IDLE)} AS idle_beyond_12_months_amount_inr,
  COUNT(*) AS total_works_all_statuses, COUNT(*) FILTER ({IDLE}) AS idle_work_count, {rupees('sanctioned_amount_inr', UNDER)} AS total_sanctioned_under_implementation_inr,
  COUNT(DISTINCT CASE WHEN {UNDER} THEN state END) AS state_count, COUNT(DISTINCT CASE WHEN {UNDER} THEN constituency END) AS constituency_count
FROM scored, (SELECT MAX(last_updated) AS newest FROM works)""",
    "scored",
)
oracle("summary_figures", "SELECT * FROM summary", "summary")
oracle(
    "summary_ratios",
    """SELECT ROUND(100.0 * flagged_count / works_under_implementation, 6) AS flagged_percent,
  ROUND(total_flagged_amount_inr / total_sanctioned_under_implementation_inr * 100, 6) AS value_flagged_percent, ROUND(coalesce(total_flagged_amount_inr / nullif(flagged_count, 0), 0.0), 6) AS average_flagged_inr FROM summary""",
    "summary",
)
oracle("early_warning_read", "SELECT state, COUNT(*) AS scored_n, 'shipped' AS status FROM works WHERE state IN ('ASIA', 'EUROPE') GROUP BY 1", "works")

# -- pendency ---------------------------------------------------------------------------------

QUOTA = "CASE WHEN population_n = 0 THEN 0 ELSE greatest(1, (population_n * 10 + 99) // 100) END AS quota_n"
cte("quotas", f"SELECT *, {QUOTA} FROM (SELECT implementing_district_authority, COUNT(*) AS population_n FROM works WHERE {UNDER} AND implementing_district_authority IS NOT NULL GROUP BY 1)", "works")
oracle("quota_by_authority", "SELECT * FROM quotas", "quotas")
oracle("quota_sum", "SELECT COUNT(*) AS district_authority_n, CAST(coalesce(SUM(quota_n), 0) AS BIGINT) AS quota_sum FROM quotas", "quotas")
CHECKS = {
    "late_sanction": "sanction_date - recommendation_date > 45",
    "open_past_one_year": f"{DAY} - sanction_date > 365",
    "no_payment_90_days": f"{DAY} - sanction_date > 90 AND coalesce(expenditure_amount_inr, 0) = 0",
}
oracle(
    "pendency_kinds",
    " UNION ALL ".join(
        f"SELECT {q(kind)} AS kind, COUNT(*) AS count, {rupees('sanctioned_amount_inr')} AS sanctioned_inr FROM works WHERE {UNDER} AND {check}"
        for kind, check in {"population": "TRUE", **CHECKS}.items()
    ),
    "works",
)
oracle("pendency_median", f"SELECT CAST(round_even(median(sanction_date - recommendation_date), 0) AS BIGINT) AS median_days_to_sanction FROM works WHERE {UNDER}", "works")
oracle(
    "pendency_groups",
    " UNION ALL ".join(
        f"SELECT *, {QUOTA}, {q(by)} AS group_by FROM (SELECT {column} AS \"group\", COUNT(*) AS population_n, "
        + ", ".join(f"COUNT(*) FILTER ({check}) AS {kind}" for kind, check in CHECKS.items())
        + f" FROM works WHERE {UNDER} AND {column} IS NOT NULL GROUP BY 1)"
        for by, column in (("state", "state"), ("district_authority", "implementing_district_authority"), ("constituency", "constituency"))
    ),
    "works",
)
oracle(
    "third_party",
    f"""SELECT *, at_or_above_25_lakh + CAST(ceil(between_15_and_25_lakh / 2.0) AS BIGINT) AS required_n FROM (
  SELECT COUNT(*) FILTER (x >= 2500000) AS at_or_above_25_lakh, COUNT(*) FILTER (x >= 1500000 AND x < 2500000) AS between_15_and_25_lakh
  FROM (SELECT sanctioned_amount_inr * 5 AS x FROM works WHERE {UNDER}))""",
    "works",
)
oracle("early_warning_scope", f"SELECT COUNT(*) AS early_warning_n FROM works WHERE {UNDER} AND {WATCHED}", "works")

# -- delay model and evaluation ---------------------------------------------------------------

START, CUTOFF, END = "DATE '1999-07-01'", "DATE '2000-01-01'", "DATE '2000-04-01'"
cte(
    "cohort",
    f"""SELECT *, CASE WHEN completion_status = 'Completed' THEN 0 ELSE 1 END AS y, CASE WHEN sanction_date < {CUTOFF} THEN 'train' ELSE 'test' END AS part
FROM works WHERE sanction_date BETWEEN {START} AND {END}""",
    "works",
)
cte("history", f"SELECT *, CASE WHEN completion_status = 'Completed' THEN 0.0 ELSE 1.0 END AS y FROM works WHERE sanction_date < {CUTOFF}", "works")
cte(
    "prior",
    """SELECT implementing_agency, (CAST(SUM(y) AS DOUBLE) + 20 * (SELECT AVG(CAST(y AS DOUBLE)) FROM history)) / (COUNT(*) + 20) AS prior FROM history WHERE implementing_agency IS NOT NULL GROUP BY 1""",
    "history",
)
oracle("delay_cohort", "SELECT work_id, y, part FROM cohort", "cohort")
oracle(
    "agency_prior",
    "SELECT implementing_agency AS agency, ROUND(prior, 9) AS agency_prior FROM prior UNION ALL SELECT '(overall)', ROUND(AVG(CAST(y AS DOUBLE)), 9) FROM history",
    "prior",
)
oracle(
    "delay_features",
    f"""SELECT work_id, ROUND(ln(1 + coalesce(sanctioned_amount_inr, 0)), 6) AS log_sanctioned, ROUND(coalesce(prior, (SELECT AVG(CAST(y AS DOUBLE)) FROM history)), 6) AS agency_prior,
  CAST(month(sanction_date) AS DOUBLE) AS sanction_month, ROUND(({DAY} - sanction_date) / 30.44, 1) AS exposure_months FROM cohort LEFT JOIN prior USING (implementing_agency)""",
    "cohort",
    "prior",
)
cte(
    "metric_rows",
    "SELECT work_id, y, coalesce(ROUND(expenditure_amount_inr / sanctioned_amount_inr * 100, 0), 0.0) AS score FROM cohort",
    "cohort",
)
cte("metric_scores", "SELECT score, SUM(y) AS pos, COUNT(*) - SUM(y) AS neg FROM metric_rows GROUP BY 1", "metric_rows")
cte("metric_curve", "SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER () AS pp, SUM(neg) OVER () AS nn FROM metric_scores WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)", "metric_scores")
oracle(
    "delay_metrics",
    """SELECT ROUND(CAST(SUM(pos * (nn - fp) + pos * neg / 2.0) AS DOUBLE) / CAST(MAX(pp) * MAX(nn) AS DOUBLE), 3) AS roc_auc,
  ROUND(SUM(CAST(pos AS DOUBLE) / CAST(pp AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)), 3) AS average_precision,
  ROUND(CAST(MAX(pp) AS DOUBLE) / CAST(MAX(pp + nn) AS DOUBLE), 3) AS base_rate,
  ROUND((SELECT AVG(CAST(y AS DOUBLE)) FROM (SELECT y, ROW_NUMBER() OVER (ORDER BY score DESC, work_id) AS rn, COUNT(*) OVER () AS n FROM metric_rows) WHERE rn <= greatest(1, floor(n * 0.10)))
    / (CAST(MAX(pp) AS DOUBLE) / CAST(MAX(pp + nn) AS DOUBLE)), 3) AS lift_at_10 FROM metric_curve""",
    "metric_curve",
)
oracle(
    "delay_artifact",
    f"""SELECT 'not_shipped' AS status, CAST(0 AS BIGINT) AS scored_n, CAST(0 AS BIGINT) AS watch_n, 'delay_logistic_v1' AS model_version, CAST({DAY} AS VARCHAR) AS data_as_of,
  CAST({START} AS VARCHAR) AS cohort_start, CAST({CUTOFF} AS VARCHAR) AS cohort_cutoff, CAST({END} AS VARCHAR) AS cohort_end, COUNT(*) FILTER (part = 'train') AS train_n,
  COUNT(*) FILTER (part = 'test') AS test_n, 'log_sanctioned,agency_prior,sanction_month' AS numeric, 'work_category,state' AS categorical FROM cohort""",
    "cohort",
)
oracle(
    "delay_watch_ranked",
    f"""SELECT work_id, score, place, scored_n, CAST(ceil(scored_n * 0.10) AS BIGINT) AS watch_n FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, work_id) AS place, COUNT(*) OVER () AS scored_n FROM (
    SELECT work_id, coalesce(ROUND(expenditure_amount_inr / sanctioned_amount_inr * 100, 0), 0.0) AS score FROM works WHERE {UNDER} AND {DAY} - sanction_date BETWEEN 0 AND 365))
WHERE place <= ceil(scored_n * 0.10)""",
    "works",
)
cte(
    "planted",
    """SELECT *, CASE WHEN CASE WHEN CAST(work_id AS BIGINT) % 10 = 3 THEN number % 7 <> 0 ELSE number % 7 = 0 END THEN 1 ELSE 0 END AS y
  FROM (SELECT *, CAST(regexp_extract(coalesce(implementing_agency, 'AG-0'), '(\\d+)', 1) AS INT) AS number FROM works)""",
    "works",
)
cte("planted_rate", f"SELECT AVG(CAST(y AS DOUBLE)) AS rate FROM planted WHERE sanction_date < {CUTOFF}", "planted")
cte(
    "planted_prior",
    f"""SELECT implementing_agency, (SUM(y) + 20 * any_value(rate)) / (COUNT(*) + 20) AS prior FROM planted, planted_rate WHERE sanction_date < {CUTOFF} AND implementing_agency IS NOT NULL GROUP BY 1""",
    "planted_rate",
)
cte(
    "planted_train",
    f"""SELECT y, ln(1 + coalesce(sanctioned_amount_inr, 0)) AS log_sanctioned, coalesce(prior, rate) AS agency_prior, CAST(month(sanction_date) AS DOUBLE) AS sanction_month,
  CASE WHEN COUNT(*) OVER (PARTITION BY work_category) < 30 THEN '(few)' ELSE work_category END AS work_category, CASE WHEN COUNT(*) OVER (PARTITION BY state) < 30 THEN '(few)' ELSE state END AS state
FROM planted CROSS JOIN planted_rate LEFT JOIN planted_prior USING (implementing_agency) WHERE sanction_date >= {START} AND sanction_date < {CUTOFF}""",
    "planted_prior",
)
numeric_sums = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, SUM(x) AS total, SUM(x * x) AS squares, SUM(x * y) AS positives FROM (SELECT y, ({c} - AVG({c}) OVER ()) / (CASE WHEN STDDEV_POP({c}) OVER () > 0 THEN STDDEV_POP({c}) OVER () ELSE 1 END) AS x FROM planted_train)"""
    for c in ("log_sanctioned", "agency_prior", "sanction_month")
)
category_sums = " UNION ALL ".join(
    f"SELECT concat('{c}_', {c}), COUNT(*), COUNT(*), SUM(y) FROM planted_train GROUP BY {c} UNION ALL SELECT '{c}_(unseen)', 0, 0, 0" for c in ("work_category", "state")
)
oracle(
    "delay_gradient",
    f"""SELECT feature, ROUND(CAST(total AS DOUBLE), 4) + 0.0 AS total, ROUND(CAST(squares AS DOUBLE), 4) AS squares, ROUND(CAST(positives AS DOUBLE), 4) AS positives, 0.0::DOUBLE AS gradient FROM (
{numeric_sums} UNION ALL {category_sums} UNION ALL SELECT '(intercept)', COUNT(*), COUNT(*), SUM(y) FROM planted_train)""",
    "planted_train",
)
cte(
    "totals",
    f"""SELECT COUNT(*) AS works, COUNT(*) FILTER ({UNDER}) AS under_implementation, CAST(SUM(CAST(sanctioned_amount_inr AS DECIMAL(28,4))) AS DOUBLE) AS s,
  CAST(SUM(CAST(expenditure_amount_inr AS DECIMAL(28,4))) AS DOUBLE) AS e FROM works""",
    "works",
)
oracle(
    "scheme_totals",
    """SELECT works, under_implementation, ROUND(s, 2) AS sanctioned, ROUND(e, 2) AS spent, ROUND(s - e, 2) AS unspent, ROUND(ROUND(s - e, 2) / ROUND(s, 2) * 100, 6) AS unspent_percent FROM totals""",
    "totals",
)
oracle(
    "detector_counts",
    "SELECT flag, COUNT(*) AS works FROM (SELECT unnest(flags) AS flag FROM scored) GROUP BY 1 UNION ALL SELECT 'any_flag', COUNT(*) FILTER (len(flags) > 0) FROM scored",
    "scored",
)
cte(
    "pool",
    f"""SELECT *, ROW_NUMBER() OVER (ORDER BY inspection_rank) AS place, CAST(round_even(COUNT(*) OVER () * 0.10, 0) AS BIGINT) AS quota FROM scored WHERE {UNDER}""",
    "scored",
)
TOP = "place <= quota"
cte(
    "pool_figures",
    f"""SELECT COUNT(*) AS pool, MAX(quota) AS quota, COUNT(*) FILTER (len(flags) > 0) AS flagged_in_pool, COUNT(*) FILTER (len(flags) > 0 AND {TOP}) AS flagged_in_quota,
  COUNT(*) FILTER (len(flags) >= 2) AS multi_flag_in_pool, COUNT(*) FILTER (len(flags) >= 2 AND {TOP}) AS multi_flag_in_quota,
  {rupees('sanctioned_amount_inr')} AS sanctioned_in_pool, {rupees('sanctioned_amount_inr', TOP)} AS sanctioned_in_quota,
  {rupees('(sanctioned_amount_inr - expenditure_amount_inr)')} AS unspent_in_pool, {rupees('(sanctioned_amount_inr - expenditure_amount_inr)', TOP)} AS unspent_in_quota FROM pool""",
    "pool",
)
oracle(
    "targeting_performance",
    """SELECT *, ROUND(flagged_in_pool / CAST(pool AS DOUBLE), 6) AS base_rate, ROUND(flagged_in_quota / CAST(quota AS DOUBLE), 6) AS precision,
  ROUND((flagged_in_quota / CAST(quota AS DOUBLE)) / nullif(flagged_in_pool / CAST(pool AS DOUBLE), 0), 6) AS lift FROM pool_figures""",
    "pool_figures",
)
oracle(
    "peer_coverage",
    "SELECT COUNT(*) AS groups, COUNT(*) FILTER (n >= 30) AS groups_passing, CAST(coalesce(SUM(n) FILTER (n >= 30), 0) AS BIGINT) AS works_covered FROM peers",
    "peers",
)
