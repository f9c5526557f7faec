import random
import statistics

from pyspark.sql import functions as F

from worksift.plans.ranking import dense_position, exact_quantiles, global_rank, position_blocks, rank_in_group, running_totals


def test_global_rank_is_dense_and_does_not_depend_on_input_order(spark):
    rows = [(random.choice([0.0, 50.0, 75.0]), f"w{i}") for i in range(500)]
    expected = {w: n for n, (_, w) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}
    for shuffled in (rows, rows[::-1], random.sample(rows, len(rows))):
        df = spark.createDataFrame(shuffled, "score double, work_id string").repartition(7)
        ranked = global_rank(df, [F.col("score").desc(), F.col("work_id")], "rank")
        assert {r.work_id: r["rank"] for r in ranked.collect()} == expected


def test_global_rank_of_nothing(spark):
    empty = spark.createDataFrame([], "x int")
    assert global_rank(empty, [F.col("x")], "rank").collect() == []


def test_exact_quantiles_match_the_exclusive_method_with_and_without_brackets(spark):
    random.seed(3)
    groups = {"hot": [float(random.randint(0, 40)) for _ in range(3000)], "few": [5.0, 1.0], "one": [7.0], None: [1.5, 2.5, 9.0, 4.0, 4.0]}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("few", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for small in (100_000, 50):
        out = exact_quantiles(df, ["k"], "v", {"q1": 1, "med": 2, "q3": 3}, small=small, accuracy=100)
        got = {r.k: (r.q1, r.med, r.q3) for r in out.collect()}
        assert set(got) == set(groups)
        for k, values in groups.items():
            want = tuple(statistics.quantiles(values, n=4)) if len(values) > 1 else (7.0, 7.0, 7.0)
            assert got[k] == want, k


def test_brackets_are_narrowed_until_they_are_small(spark, monkeypatch):
    """Groups of many distinct values, and of few that repeat: what is sorted stays below the bound."""
    from worksift.plans import ranking

    brackets = []
    keep = ranking._narrowed
    monkeypatch.setattr(ranking, "_narrowed", lambda *a: brackets.append(keep(*a)) or brackets[-1])
    spread = spark.range(300_000).select(F.lit("spread").alias("k"), (F.col("id") * 37 % 300_000).cast("double").alias("v"))
    piled = spark.range(60_000).select(F.lit("piled").alias("k"), (F.col("id") % 3 * 10).cast("double").alias("v"))
    few = spark.range(7).select(F.lit(None).cast("string").alias("k"), F.col("id").cast("double").alias("v"))
    rows = spread.unionByName(piled).unionByName(few)
    small = 500
    out = exact_quantiles(rows, ["k"], "v", {"q1": 1, "med": 2, "q3": 3}, accuracy=1000, small=small)
    assert {r.k: (r.q1, r.med, r.q3) for r in out.collect()} == {"spread": (74999.25, 149999.5, 224999.75), "piled": (0.0, 10.0, 20.0), None: (1.0, 3.0, 5.0)}
    sorted_values = 0
    edges = {r.k: r._edge for r in brackets[0].collect()}
    for i in range(3):
        low, high = edges["spread"][2 * i], edges["spread"][2 * i + 1]
        inside = spread.where(F.col("v").between(low, high)).count()
        assert inside <= small
        sorted_values += inside
    assert sorted_values < 3 * small
    whole = exact_quantiles(spread.select("v"), [], "v", {"med": 2}, accuracy=1000, small=small)
    assert whole.first().med == 149999.5 and len(brackets) == 2


def test_running_totals_and_group_ranks(spark, monkeypatch):
    from worksift.plans import ranking

    monkeypatch.setattr(ranking, "_BLOCK_ROWS", 10)
    df = spark.createDataFrame([(i, i * 2) for i in range(1, 101)], "pos bigint, v bigint")
    totals = running_totals(df, "pos", {"upto": "v"}).collect()
    assert {r.pos: r.upto for r in totals} == {i: i * (i + 1) for i in range(1, 101)}

    ranked = rank_in_group(df.withColumn("g", F.when(F.col("pos") % 3 > 0, F.col("pos") % 3)), ["g"], [F.col("pos").desc()], "n")
    for g in (None, 1, 2):
        rows = sorted((r for r in ranked.collect() if r.g == g), key=lambda r: -r.pos)
        assert [r.n for r in rows] == list(range(1, len(rows) + 1))

    kept = df.where(F.col("pos") % 7 < 3)
    placed = dense_position(kept, "pos", position_blocks(kept, "pos"), "place").orderBy("pos").collect()
    assert [r.place for r in placed] == list(range(1, len(placed) + 1))
