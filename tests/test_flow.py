import pytest
from pyspark.sql import functions as F

from worksift.operators import aliases, flow


@pytest.fixture(scope="module")
def small(make_works):
    row = lambda mp, agency, vendor, amount=10.0: {
        "mp_name": mp, "implementing_agency": agency, "vendor_id": vendor, "vendor_name": vendor and f"Name {vendor}", "sanctioned_amount_inr": amount,
    }
    works = make_works(
        row("MP A", "P.W.D. 1", "x y", 1.005),
        row("mp a", "PWD 1", "x y", 2.0),
        row("MP B", "P W D 1", "z", None),
        row("MP C", "P.W.D. 1", None, 7.0),
        row("MP D", None, "lonely", 9.0),
    )
    scored = works.select("work_id", F.when(F.col("work_id") == "w0001", F.array(F.lit("stalled_work"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    facts = flow.flow_facts(works, scored)
    rows = flow.edge_works(facts)
    return facts, flow.graph_nodes(facts), rows, flow.graph_edges(rows)


def test_nodes_and_edges(small):
    _, nodes, _, edges = small
    by_id = {r.id: r for r in nodes.collect()}
    assert set(by_id) == {
        "mp_mp_a", "mp_mp_b", "mp_mp_c", "mp_mp_d", "agency_p_w_d_1", "agency_pwd_1", "vendor_x%20y", "vendor_z", "vendor_lonely",
    }
    assert by_id["mp_mp_a"].label == "MP A" and by_id["mp_mp_a"].risk_weight == 1.0
    flows = {(r.source, r.target): (r.work_count, r.total_amount_inr, r.flagged_work_count) for r in edges.collect()}
    assert flows[("mp_mp_b", "agency_p_w_d_1")] == (1, 0.0, 0)
    assert flows[("agency_pwd_1", "vendor_x%20y")] == (1, 2.0, 0)
    assert not any("lonely" in t for _, t in flows)
    assert flow.graph_integrity(nodes, edges).count() == 0
    assert flow.graph_integrity(nodes.where("type <> 'Vendor'"), edges).count() == 3


def test_adjacency_is_not_a_path(small):
    facts, nodes, rows, edges = small
    out = {r.vendor_id: r for r in flow.vendor_concentration(nodes, facts).collect()}
    # MP C uses the agency, but none of the agency's payments to z or x y were for MP C.
    assert (out["vendor_x%20y"].member_count, out["vendor_x%20y"].agency_count, out["vendor_x%20y"].work_count) == (1, 2, 2)
    assert out["vendor_z"].member_count == 1
    assert (out["vendor_lonely"].member_count, out["vendor_lonely"].work_count) == (0, 0)
    reach = flow.graph_reach_counts(edges).first()
    assert (reach.agencies_wide, reach.vendors_wide) == (1, 2)


def test_cluster_and_restriction(spark, small):
    _, nodes, rows, _ = small
    wanted = spark.createDataFrame([("vendor_x%20y",)], "vendor_id string")
    kept, edges = flow.vendor_cluster(nodes, rows, wanted)
    assert {r.id for r in kept.collect()} == {"vendor_x%20y", "agency_p_w_d_1", "agency_pwd_1", "mp_mp_a"}
    assert edges.count() == 4
    cut = flow.cluster_restrict(rows, wanted).collect()
    side = lambda kind: sum(r.work_count for r in cut if r.source_type == kind)
    assert side("MP") == side("Agency") == 2


def test_lists_are_bounded_and_whole(spark):
    rows = spark.createDataFrame([("a", "b", f"w{i:03d}") for i in range(25)] + [("a", "c", "w1")], "source string, target string, work_id string")
    out = flow.work_id_lists(rows, ["source", "target"], length=10).orderBy("target", "part").collect()
    assert [(r.target, r.part, len(r.work_ids)) for r in out] == [("b", 0, 10), ("b", 1, 10), ("b", 2, 5), ("c", 0, 1)]
    assert sum((r.work_ids for r in out if r.target == "b"), []) == [f"w{i:03d}" for i in range(25)]


def test_one_hop_and_totals(small):
    _, nodes, _, edges = small
    kept, touched = flow.graph_one_hop(nodes, edges, agency="pwd")
    assert {r.id for r in kept.collect()} == {"agency_pwd_1", "mp_mp_a", "vendor_x%20y"} and touched.count() == 2
    assert flow.graph_one_hop(nodes, edges, vendor="nobody")[0].count() == 0
    total = flow.graph_totals(nodes, edges).first()
    assert (total.mp_count, total.agency_count, total.vendor_count, total.flow_inr) == (4, 2, 3, 3.01)


def test_median_rounds_half_up(spark):
    counts = lambda *n: spark.createDataFrame([(x,) for x in n], "member_count bigint")
    assert flow.vendor_median(counts(1, 2)).first()[0] == 2
    assert flow.vendor_median(counts(1, 4, 3)).first()[0] == 3
    assert flow.vendor_median(counts()).first()[0] == 0


def test_clusters_need_spread_and_work(spark):
    def graph(members):
        nodes, edges = [], []
        for a, n in enumerate(members):
            nodes.append((f"agency_{a}", "Agency", f"A{a}", 0.0))
            edges += [(f"mp_{m}", f"agency_{a}", "MP", 5, 0.0, 0) for m in range(n)]
        nodes += [(f"mp_{m}", "MP", f"M{m}", 0.0) for m in range(max(members))]
        return (
            spark.createDataFrame(nodes, "id string, type string, label string, risk_weight double"),
            spark.createDataFrame(edges, "source string, target string, source_type string, work_count bigint, total_amount_inr double, flagged_work_count bigint"),
        )

    found = flow.concentration_clusters(*graph([1] * 9 + [30])).collect()
    assert [r.node_id for r in found] == ["agency_9"] and found[0].reason.startswith("A9 is connected to 30 distinct MPs, 2.8 standard")
    assert flow.concentration_clusters(*graph([2] * 9)).collect() == []
    assert flow.concentration_clusters(*graph([30])).collect() == []


def test_fold_keeps_six_and_the_rest(spark):
    nodes = spark.createDataFrame([(f"mp_{i}", "MP", f"M{i}", 0.0) for i in range(9)] + [("agency_1", "Agency", "A", 0.0)], "id string, type string, label string, risk_weight double")
    edges = spark.createDataFrame([(f"mp_{i}", "agency_1", "MP", 1, float(i), i % 2) for i in range(9)], "source string, target string, source_type string, work_count bigint, total_amount_inr double, flagged_work_count bigint")
    out = {r.source: r for r in flow.flow_fold_topk(nodes, edges).collect()}
    assert set(out) == {"more:MP"} | {f"mp_{i}" for i in range(3, 9)}
    assert (out["more:MP"].amount, out["more:MP"].work_count, out["more:MP"].tier) == (3.0, 3, "elevated")
    assert out["mp_3"].tier == "high" and out["mp_4"].tier == "plain"


def test_alias_reasons_and_evidence(make_works):
    v = lambda i, n: {"vendor_id": i, "vendor_name": n}
    works = make_works(v("1", "A"), v("1", "B"), v("2", "B"), v("3", "C"), v("4", "D"), v("5", "D"), v(None, "A"), v("9", None))
    candidates = aliases.alias_candidates(works)
    rows = {(r.proposed_canonical_id, r.alias_label): (r.reason, r.evidence_count) for r in candidates.collect()}
    assert rows == {
        ("1", "A"): ("identifier_has_multiple_labels", 2),
        ("1", "B"): ("identifier_and_label_ambiguous", 3),
        ("2", "B"): ("label_has_multiple_identifiers", 2),
        ("4", "D"): ("label_has_multiple_identifiers", 2),
        ("5", "D"): ("label_has_multiple_identifiers", 2),
    }
    evidence = {(r.kind, r.key, r.work_id) for r in aliases.alias_evidence(works).collect()}
    ids, names = ["w0001", "w0002"], {"B": ["w0002", "w0003"], "D": ["w0005", "w0006"]}
    assert evidence == {("identifier", "1", w) for w in ids} | {("label", n, w) for n, ws in names.items() for w in ws}


def test_reach_counts_members_beyond_one_mask(spark):
    """150 members behind two agencies of one vendor, 20 of them behind both."""
    rows = [(f"m{i}", "a", "MP") for i in range(90)] + [(f"m{i}", "b", "MP") for i in range(70, 150)]
    rows += [("a", "v", "Agency"), ("b", "v", "Agency"), ("b", "w", "Agency")]
    edges = spark.createDataFrame(rows, "source string, target string, source_type string")
    assert {r.id: r.members for r in flow._reach(edges).collect()} == {"a": 90, "b": 80, "v": 150, "w": 80}
