import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from worksift import config
from worksift.operators import judged, textdup
from worksift.plans.storage import written

WORDS = "road village school ward bridge drain pond library hall light tank pump wall gate yard phase".split()


def texts_of(n, seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(1, 9))) for _ in range(n // 3)]
    out = list(base)
    for t in base * 2:
        words = t.split()
        words[rng.randrange(len(words))] = rng.choice(WORDS) + str(rng.randint(1, 20))
        out.append(" ".join(words * rng.randint(1, 2)))
    return out[:n]


@pytest.fixture(scope="module")
def described(make_works):
    rng = random.Random(1)
    rows = [
        {"work_description": t, "constituency": rng.choice(["C1", "C1", "C2"]), "implementing_district_authority": rng.choice(["D1", "D2", None])}
        for t in texts_of(90, 4) + ["!!", "Road, to SCHOOL", "road to school", "a", "ab"]
    ]
    return textdup.described(make_works(*rows))


def vectors(canonicals):
    counts = {}
    for c in canonicals:
        grams = Counter()
        for w in c.split():
            p = f" {w} "
            for n in (3, 4, 5):
                grams.update(p[i : i + n] for i in range(len(p) - n + 1))
        counts[c] = grams
    df = Counter(g for grams in counts.values() for g in grams)
    idf = {g: math.log((1 + len(counts)) / (1 + d)) + 1 for g, d in df.items()}
    out = {}
    for c, grams in counts.items():
        v = {g: n * idf[g] for g, n in grams.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out[c] = {g: x / norm for g, x in v.items()}
    return out


def brute(rows, scope, minimum, use_tokens):
    """Every pair of texts of every scope, compared directly."""
    space = vectors({r.canonical for r in rows})
    members = defaultdict(set)
    for r in rows:
        if r[scope]:
            members[r[scope]].add(r.canonical)
    found = {}
    for name, texts in members.items():
        ordered = sorted(texts)
        for i, a in enumerate(ordered):
            for b in ordered[i + 1 :]:
                cosine = round(sum(x * space[b].get(g, 0.0) for g, x in space[a].items()), 4)
                ta, tb = (set(t.split()) - set(config.COMMON_TOKENS) for t in (a, b))
                shared, union = len(ta & tb), len(ta | tb)
                token = use_tokens and shared >= 3 and round(shared / union, 4) >= 0.75
                if cosine >= minimum or token:
                    found[(name, a, b)] = (cosine, cosine >= minimum, token)
    return found


@pytest.mark.parametrize("masks,hot", [(8, 256), (1, 1)])
@pytest.mark.parametrize("scope,minimum,use_tokens", [("constituency", 0.6, True), ("implementing_district_authority", 0.7, False)])
def test_similar_pairs_equal_brute_force(described, monkeypatch, masks, hot, scope, minimum, use_tokens):
    monkeypatch.setattr(textdup, "_BITS", 4)
    monkeypatch.setattr(textdup, "_MASKS", masks)
    monkeypatch.setattr(textdup, "_HOT_RUNS", hot)
    monkeypatch.setattr(textdup, "_HEAD", 12)
    monkeypatch.setattr(textdup, "_BUCKETS", 20)
    numbered = textdup.distinct_texts(described)
    features = textdup.text_features(numbered)
    kind = "constituency" if scope == "constituency" else "authority"
    pairs = textdup.similar_pairs(textdup.scoped_texts(described, numbered, kind), features, minimum, use_tokens)
    name = {r.t: r.canonical for r in numbered.collect()}
    got = {(r.scope, name[r.a], name[r.b]): (r.cosine, r.by_character, r.by_token) for r in pairs.collect()}
    want = brute(described.collect(), scope, minimum, use_tokens)
    assert len(want) > 10 and set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 2e-4 and got[k][1:] == want[k][1:] for k in want)


def test_most_pairs_are_ruled_out_before_vectors_are_read(spark):
    """On whole documents under 30 % of the pairs in scope are scored, and none that counts is lost."""
    from worksift.queries import catalog

    sf = "/root/testdata/sf0.01"
    numbered, features = catalog.text_space(spark, sf)
    scoped = textdup.scoped_texts(catalog.texts(spark, sf, "lang", "source"), numbered, "constituency")
    runs = textdup._runs(scoped)
    candidates = written(textdup._candidate_runs(runs, textdup._prefixes(features, config.CHARACTER_MIN, True)), "candidates")
    bounded = textdup.bounded_pairs(runs, candidates, features, config.CHARACTER_MIN, True)
    sizes = scoped.select("scope", "t").distinct().groupBy("scope").count().collect()
    in_scope = sum(r["count"] * (r["count"] - 1) // 2 for r in sizes)
    proposed, kept = bounded.agg(F.sum("proposed"), F.sum("kept")).first()
    found = textdup.similar_pairs(scoped, features, config.CHARACTER_MIN, True).count()
    assert found <= kept < 0.3 * in_scope and proposed <= in_scope
    assert found > 1000


@pytest.mark.parametrize("seed", range(5))
def test_summaries_never_understate(spark, seed):
    """The product of two summaries is at least that of the vectors, and bitmaps bound shared words."""
    rng = np.random.default_rng(seed)
    vocabulary, rows = 9_000, []
    for t in range(12):
        ids = np.sort(rng.choice(np.arange(1, vocabulary + 1), rng.integers(1, 900), replace=False))
        w = rng.random(len(ids)) ** 3 + 1e-6
        rows.append((t, ids.tolist(), (w / np.linalg.norm(w)).tolist()))
    df = spark.createDataFrame(rows, "t int, g array<bigint>, w array<double>")
    made = df.withColumns({"s": textdup.piece_summary(vocabulary)("g", "w"), "b": textdup.word_bits("g")}).orderBy("t").collect()
    dense = textdup._dense([r.s for r in made], textdup._HEAD + textdup._BUCKETS)
    bits = [np.frombuffer(r.b, np.uint64) for r in made]
    for i, x in enumerate(made):
        assert len(x.s) <= 4 * len(x.g)
        for j, y in enumerate(made):
            other = dict(zip(y.g, y.w))
            true = sum(w * other.get(g, 0.0) for g, w in zip(x.g, x.w))
            assert float(dense[i] @ dense[j]) >= true - 1e-5
            assert len(set(x.g) & set(y.g)) <= (len(x.g) + len(y.g) - int(np.bitwise_count(bits[i] ^ bits[j]).sum())) // 2


def test_a_pair_by_words_alone(make_works):
    long = "alphabetical bibliographical cartographical demographical"
    rows = [{"work_description": t} for t in ("x y z " + long, "x y z w " + long, "q " * 3)]
    texts = textdup.described(make_works(*rows))
    numbered = textdup.distinct_texts(texts)
    pairs = textdup.near_copy_pairs(texts, numbered, textdup.text_features(numbered)).collect()
    assert [p.hits for p in pairs] == [["character", "token"]]
    assert pairs[0].token_overlap == round(7 / 8, 4)


def test_batches_and_groups(make_works):
    row = lambda text, c, d, amount: {"work_description": text, "constituency": c, "implementing_district_authority": d, "sanctioned_amount_inr": amount}
    texts = textdup.described(
        make_works(
            row("Bridge, one!", "C1", "D", 1_400_000.0),
            row("BRIDGE one", "C1", "D", 1_100_000.0),
            row("bridge one", "C2", "D", 1.0),
            row("hall", "C1", None, 1_500_000.0),
            row("Hall", "C1", None, 1_500_000.0),
            row(None, "C1", "D", 1.0),
        )
    )
    batches = {r.work_count: r.threshold_crossing_batch for r in textdup.identical_batches(texts).collect() if r.scope == "C1"}
    assert texts.count() == 5
    sizes = sorted((r.scope, r.work_count, r.threshold_crossing_batch) for r in textdup.identical_batches(texts).collect())
    assert sizes == [("C1", 2, False), ("C1", 2, True)] and batches
    assert [r.work_count for r in textdup.district_identical_batches(texts).collect()] == [3]
    summary = {(r.scope, r.text): r for r in textdup.text_group_summary(texts, "constituency").collect()}
    one = summary[("C1", "BRIDGE one")]  # two spellings once each: the smaller
    assert (one.work_count, one.amount_total_inr, one.statuses) == (2, 2_500_000.0, {"In Progress": 2})
    groups = textdup.group_members(texts)
    refs = textdup.referenced_groups(
        textdup.identical_batches(texts).unionByName(textdup.district_identical_batches(texts)),
        *[texts.sparkSession.createDataFrame([], "finder string, scope string, fingerprint_a string, fingerprint_b string")] * 2,
    )
    problems = textdup.duplicate_integrity(groups, refs).collect()
    assert {(p.problem, p.scope) for p in problems} == {("unreferenced_group", "C2")}
    clash = textdup.duplicate_integrity(groups.withColumn("scope", F.lit("same")), refs).where("problem = 'ambiguous_group_id'")
    assert clash.count() == 1


def test_referenced_groups_pass_over_pairs_once(spark):
    """pairs had to be stored, as both sides were read on their own."""
    seen = spark.sparkContext.accumulator(0)

    def mark(scope):
        seen.add(1)
        return scope

    columns = "finder string, scope string, fingerprint_a string, fingerprint_b string"
    pairs = spark.createDataFrame([("near_copy", "s", "a", "b"), ("near_copy", "s", "b", "c")], columns)
    pairs = pairs.withColumn("scope", F.udf(mark, "string").asNondeterministic()("scope"))
    batches = spark.createDataFrame([("identical_batch", "s", "d")], "finder string, scope string, fingerprint string")
    none = spark.createDataFrame([], columns)
    got = textdup.referenced_groups(batches, pairs, none).collect()
    assert {(r.scope_kind, r.fingerprint) for r in got} == {("constituency", f) for f in "abcd"} and len(got) == 4
    assert seen.value == 2


def test_difference_classes(make_works):
    rows = [{"work_description": t} for t in ("a b c community hall roof tiles repairing", "c b a roof tiles community hall repairing", "a b c community hall roof tiles repairing new", "a b c community hall roof tiles repairing old")]
    texts = textdup.described(make_works(*rows))
    numbered = textdup.distinct_texts(texts)
    pairs = textdup.near_copy_pairs(texts, numbered, textdup.text_features(numbered))
    out = {frozenset((r.only_a_tokens + r.only_b_tokens)): r.difference_group for r in textdup.pair_difference(pairs, numbered).collect()}
    assert out[frozenset()] == "reworded_match"
    assert out[frozenset({"new"})] == "one_sided_detail"
    assert out[frozenset({"new", "old"})] == "conflicting_detail"


def test_texts_of_judged_groups_are_marked_once(spark, monkeypatch):
    """words of continuation are looked for in each group's text, not in both texts of every pair."""
    seen, marked = [], judged._marked
    monkeypatch.setattr(judged, "_marked", lambda text: seen.append(str(text)) or marked(text))
    groups = spark.createDataFrame(
        [("s", "f1", "hall phase two", 1, "2024-01-01", 10.0), ("s", "f2", "hall", 1, "2024-01-02", 10.0), ("s", "f3", "hall one", 1, "2024-01-02", 9.0)],
        "scope string, fingerprint string, text string, work_count bigint, sanction_date_first string, amount_total_inr double",
    ).withColumn("sanction_date_first", F.col("sanction_date_first").cast("date"))
    answers = [("s", a, b, "judged", "same_asset_same_place", "Araria", "Araria") for a, b in (("f1", "f2"), ("f3", "f2"), ("f2", "f9"))]
    judgments = spark.createDataFrame(answers, "scope string, fingerprint_a string, fingerprint_b string, status string, relation string, place_a string, place_b string")
    out = {(r.fingerprint_a, r.fingerprint_b): (r.text, r.text_b, r.work_relation) for r in judged.judged_candidates(judgments, groups).collect()}
    assert len(seen) == 1 and "text_a" not in seen[0]
    relation = "split_or_phase_candidate" if spark.range(1).select(marked(F.lit("hall phase two"))).first()[0] else "duplicate_candidate"
    assert out == {("f1", "f2"): ("hall phase two", "hall", relation), ("f2", "f3"): ("hall", "hall one", "duplicate_candidate")}


def test_differences_of_pairs_dealt_to_squares(spark, monkeypatch):
    """A hub text, a repeated pair, a pair without its text: the same words in whatever squares, in bounded batches."""
    monkeypatch.setattr(textdup, "_PAIRS_TOGETHER", 3)
    monkeypatch.setattr(textdup, "_WORDS_TOGETHER", 5)
    texts = {1: "a b c", 2: "a b c d", 3: "c a x", 4: "b a c", 5: "z"}
    numbered = spark.createDataFrame(list(texts.items()), "t bigint, canonical string")
    made = [("s", 1, b) for b in (2, 3, 4, 5)] + [("s", 1, 2), (None, 2, 3), ("r", 2, 9), ("r", None, 2)]
    pairs = spark.createDataFrame(made, "scope string, a bigint, b bigint")
    wanted = []
    for scope, a, b in made:
        if a in texts and b in texts:
            x, y = (set(texts[t].split()) for t in (a, b))
            kind = ("reworded_match", "one_sided_detail", "conflicting_detail")[bool(x - y) + bool(y - x)]
            wanted.append((scope or "", a, b, sorted(x & y), sorted(x - y), sorted(y - x), kind))
    rows = textdup.pair_difference(pairs, numbered, common=())
    got = [(r.scope or "", r.a, r.b, r.shared_tokens, r.only_a_tokens, r.only_b_tokens, r.difference_group) for r in rows.collect()]
    assert sorted(got) == sorted(wanted)
    short = textdup.pair_difference(pairs, numbered, common=(), lists=False)
    assert short.columns == [*pairs.columns, "difference_group"]
    assert sorted((r.scope or "", r.a, r.b, r.difference_group) for r in short.collect()) == sorted((*w[:3], w[-1]) for w in wanted)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "_part_a" in plan  # words do not travel with each pair


def test_verify_names_the_first_broken_rule(spark):
    rows = [
        ("ok", "Hall at Ward 7", "hall, WARD 7.", "Hall", "Ward 7", None, "WARD 7", "same_asset_same_place", None),
        ("asset", "Hall", "Hall", "hall", None, None, None, "different_asset", "asset_a_not_in_text"),
        ("blank", "Hall a", "Hall", None, " ", None, None, "different_asset", "place_a_not_in_text"),
        ("b", "Hall", "Hall", None, None, "x", None, "different_asset", "asset_b_not_in_text"),
        ("none", "Hall", "Hall", None, "Hall", None, None, "same_place_different_asset", "same_place_without_quotes"),
        ("words", "a - b", "c - d", None, "-", None, "-", "same_asset_same_place", "place_quote_without_words"),
        ("differ", "a b", "b c", None, "a", None, "c", "same_asset_same_place", "place_quotes_differ"),
    ]
    df = spark.createDataFrame(rows, "id string, text_a string, text_b string, asset_a string, place_a string, asset_b string, place_b string, relation string, expected string")
    assert [(r.id, r.rejection) for r in judged.judge_verify(df).collect()] == [(r[0], r[-1]) for r in rows]


def test_work_relation_edges(spark):
    rows = [
        ("a hall", "a hall x", 1, 1, "2024-01-01", "2024-12-31", 10.0, 5.0, "duplicate_candidate"),
        ("a hall", "a hall x", 1, 1, "2024-01-01", "2025-01-02", 10.0, 10.0, "split_or_phase_candidate"),
        ("a hall", "a hall x", 1, 1, "2024-01-01", "2024-01-01", 10.0, 4.9, "split_or_phase_candidate"),
        ("a hall", "PHASE-2 hall", 1, 1, "2024-01-01", "2024-01-01", 10.0, 10.0, "split_or_phase_candidate"),
        ("a hall", "a hall x", 2, 1, "2024-01-01", "2024-01-01", 10.0, 10.0, "split_or_phase_candidate"),
        ("a hall", "a hall x", 1, 1, None, "2024-01-01", 10.0, 10.0, "split_or_phase_candidate"),
        ("a hall", "a hall x", 1, 1, "2024-01-01", "2024-01-01", 0.0, 10.0, "split_or_phase_candidate"),
    ]
    df = spark.createDataFrame(rows, "text_a string, text_b string, work_count_a int, work_count_b int, date_a string, date_b string, amount_a double, amount_b double, expected string")
    df = df.withColumns({c: F.col(c).cast("date") for c in ("date_a", "date_b")})
    assert all(r.work_relation == r.expected for r in judged.work_relation(df).collect())


def test_generic_places_do_not_count(spark):
    df = spark.createDataFrame([("Gram village",), ("ward 7",), ("",)], "p string")
    assert [r[0] for r in df.select(judged.is_discriminating(F.col("p"))).collect()] == [False, True, False]


def test_pending_sample_is_spread_evenly(spark):
    items = spark.createDataFrame([(f"s{i:02d}", "a", "b", "f") for i in range(23)], "scope string, fingerprint_a string, fingerprint_b string, input_fingerprint string")
    stamp = {"model_id": "m", "provider_id": "p", "prompt_version": "1", "schema_version": "1"}
    answered = items.where("scope < 's03'").select("*", *[F.lit(v).alias(k) for k, v in stamp.items()])
    other = items.select("*", *[F.lit("other").alias(k) for k in stamp])
    todo = judged.judge_pending(items, answered.unionByName(other), stamp, limit=6)
    assert sorted(r.scope for r in todo.collect()) == [f"s{i:02d}" for i in range(3, 23, 3)][:6]


def test_a_text_is_sent_once_to_a_tile(spark):
    """Every run meets every other; the texts of a run go to a few tiles, not to every partner."""
    masks = [f"array({', '.join(['1L'] * textdup._MASKS)}) as masks_{s}" for s in "ab"]
    pairs = spark.range(20).crossJoin(spark.range(20).withColumnRenamed("id", "b")).where("id <= b").selectExpr("'s' as scope", "id as run_a", "b as run_b", *masks)
    tiled, tiles = textdup._tiled(pairs, 5)
    sent = textdup._wanted(tiled, lambda s: F.col(f"masks_{s}"))
    assert tiled.count() == 210 and tiles == 10
    assert sent.count() == sent.select("scope", "tile_a", "tile_b", "side", "run").distinct().count() == 100


def test_district_pairs_need_two_constituencies(make_works):
    rows = [
        {"work_description": f"construction of the community hall roof number {n}", "constituency": c, "implementing_district_authority": "D"}
        for n, c in (("one", "C1"), ("two", "C1"), ("three", "C2"), ("four", None), ("five", "C1"), ("five", "C3"))
    ]
    texts = textdup.described(make_works(*rows))
    numbered = textdup.distinct_texts(texts)
    features = textdup.text_features(numbered)
    scoped = textdup.scoped_texts(texts, numbered, "authority")
    mark = {r.t: r.canonical.split()[-1] for r in numbered.collect()}
    found = textdup.similar_pairs(scoped, features, 0.3, False, span=("constituency_first", "constituency_last")).collect()
    apart = {"one three", "one five", "two three", "two five", "three five", "four five"}
    assert {frozenset((mark[r.a], mark[r.b])) for r in found} == {frozenset(x.split()) for x in apart}


def test_pieces_are_counted_once_for_vocabulary_and_features(spark, monkeypatch):
    from worksift.queries import catalog

    calls = []
    counted = textdup.char_tfidf
    monkeypatch.setattr(textdup, "char_tfidf", lambda numbered: calls.append(1) or counted(numbered))
    monkeypatch.setattr(catalog, "_STORED", {})
    sf = "/root/testdata/sf0.001"
    assert catalog.char_tfidf(spark, sf).count() > 0 and len(calls) == 1
    assert not any(k[0] == "text_space" for k in catalog._STORED)  # no vectors for a vocabulary
    catalog.text_space(spark, sf)
    assert len(calls) == 1


def test_summaries_name_places_and_agencies(make_works):
    row = lambda c, a: {"work_description": "hall", "constituency": c, "implementing_district_authority": "D", "implementing_agency": a}
    texts = textdup.described(make_works(row("C2", "A2"), row("C1", None), row("C2", "A1"), row("C1", "A2")))
    (whole,) = textdup.text_group_summary(texts, "authority").collect()
    assert (whole.constituencies, whole.agencies, whole.constituencies_count, whole.agencies_count) == (["C1", "C2"], ["A1", "A2"], 2, 2)
    parts = {r.scope: (r.constituencies, r.agencies) for r in textdup.text_group_summary(texts, "constituency").collect()}
    assert parts == {"C1": (["C1"], ["A2"]), "C2": (["C2"], ["A1", "A2"])}


def test_summaries_list_works_and_count_every_status(make_works):
    """the works of a group were not listed, statuses outside a fixed list not counted, and an empty activity could win."""
    row = lambda w, status, activity: {"work_id": w, "work_description": "hall", "constituency": "C", "completion_status": status, "activity_name": activity}
    works = make_works(row("w10", "Completed", ""), row("w9", "Shelved", ""), row("w1", "Completed", "road"), row("w9", None, None))
    (whole,) = textdup.text_group_summary(textdup.described(works), "constituency").collect()
    assert whole.work_ids == ["w1", "w10", "w9", "w9"]
    assert (whole.statuses, whole.activity, whole.work_count) == ({"Completed": 2, "Shelved": 1}, "road", 4)


@pytest.mark.parametrize("together", [1, 500_000])
def test_items_read_as_if_joined_pair_by_pair(spark, monkeypatch, together):
    """Squares of any size, repeated and unknown keys, nulls and texts that need escapes."""
    import hashlib
    import json

    monkeypatch.setattr(judged, "_PAIRS_TOGETHER", together)
    monkeypatch.setattr(judged, "_BYTES_TOGETHER", 40)
    texts = {"f1": 'say "hall"\n  now', "f2": "a\\b é", "f3": None, "f4": "x " * 30}
    groups = [(s, f, t, None if f == "f2" else "road") for s in ("S", "T") for f, t in texts.items()] + [("S", "f1", "twice", "lake")]
    pairs = [(s, a, b) for s in ("S", "T", "U", None) for a in texts for b in texts if a < b] + [("S", "f1", "f9"), ("S", None, "f2")]
    line = lambda t: None if t is None else " ".join(t.split())
    want = []
    for s, a, b in pairs:
        for ga in groups:
            for gb in groups:
                if s is not None and a is not None and ga[:2] == (s, a) and gb[:2] == (s, b):
                    read = [s, line(ga[2]), ga[3], line(gb[2]), gb[3]]
                    body = "[" + ", ".join(json.dumps(v, ensure_ascii=False) for v in read) + "]"
                    want.append((s, a, b, read[1], read[3], ga[3], gb[3], hashlib.sha256(body.encode()).hexdigest()[:16]))
    pairs = spark.createDataFrame(pairs, "scope string, fingerprint_a string, fingerprint_b string")
    groups = spark.createDataFrame(groups, "scope string, fingerprint string, text string, activity string")
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r) for r in judged.judge_items(pairs, groups).collect()) == key(want)
    short = judged.judge_items(pairs, groups, texts=False)
    assert short.columns == [*judged.ITEM_KEY, "input_fingerprint"]
    assert key(tuple(r) for r in short.collect()) == key((*w[:3], w[-1]) for w in want)


def test_pieces_are_counted_as_if_cut_one_by_one(spark, monkeypatch):
    """F16: texts in several parts, numbers given anew, repeated words, repeated pieces inside a word, characters of several bytes."""
    from collections import Counter

    monkeypatch.setattr(textdup, "_CHARS_TOGETHER", 12)
    monkeypatch.setattr(textdup, "_PIECES_KNOWN", 5)
    texts = ["a", "aaaaaa aaaaaa b", "straße über हिन्दी", "road 𝒳𝒴𝒵 road road", "x" * 40]
    want = Counter()
    for t, text in enumerate(texts):
        for word in text.split(" "):
            padded = f" {word} "
            want.update((t, padded[i : i + n]) for n in (3, 4, 5) for i in range(len(padded) - n + 1))
    numbered = spark.createDataFrame(list(enumerate(texts)), "t bigint, canonical string")
    got = textdup.text_pieces(numbered)
    assert got.dtypes == [("t", "bigint"), ("gram", "string"), ("tf", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == sorted((*k, n) for k, n in want.items())


def test_canonical_texts_are_made_once(make_works):
    """F16: the filter on them was pushed below what deals the rows out, and the texts made there too."""
    texts = textdup.described(make_works({"work_description": "Hall"}).repartition(3))
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_folded(") == 1


def test_candidates_are_stored_without_texts(spark, monkeypatch):
    """Both texts were stored with every judged pair, three times."""
    from worksift.queries import catalog

    seen = {}
    store = catalog.written
    monkeypatch.setattr(catalog, "written", lambda df, label: seen.setdefault(label, df.columns) and store(df, label))
    monkeypatch.setattr(catalog, "_STORED", {})
    rows = catalog.duplicate_context(spark, "/root/testdata/sf0.001").select("finder", "text", "text_b").collect()
    assert {"from_judge", "candidates"} <= set(seen)
    assert not any({"text", "text_b"} & set(seen[label]) for label in ("from_judge", "candidates"))
    assert rows and all(r.text and bool(r.text_b) == (r.finder == textdup.config.JUDGED_FINDER) for r in rows)
