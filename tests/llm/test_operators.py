"""Every operator of the subpackage against a brute-force version, and on odd rows."""

import base64
import collections
import hashlib
import importlib
import io
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from worksift.llm import components, forest, idfiles, pieces, quality, registry, repeats, ring, rules, urls, warc, winnow
from worksift.plans.storage import written

SF = "/root/testdata/sf0.001"
MODEL = registry.tokenizer_file("piece_bpe_32k.model")
BYTES = registry.tokenizer_file("byte_bpe_50k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
NUMBERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

LONG = " ".join(f"word{i % 997} of the {i}" for i in range(9000))
ODD = [
    (1, "the cat sat on the mat " * 12),
    (2, None),
    (3, ""),
    (4, "the cat sat on the mat " * 12),
    (4, "the cat sat on the mat " * 12),
    (5, "\u00a0é ß\u2028 \x00 <|endoftext|> \U0001f600 a  b\t\tc\n\n d"),
    (6, LONG),
    (7, LONG + " end"),
    (None, "no id but text of some words and the like"),
    (8, "     \n\t \n"),
    (9, "aaaa" * 400),
    (10, "one two"),
    (10, "three four five six seven"),
]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def odd(spark):
    kinds = "doc_id bigint, text string, rank int, score string, place long, h string, words string, marks int, symbols string"
    return spark.createDataFrame([(i, t, 1, "s", 2, "h", "w", 3, "y") for i, t in ODD], kinds).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("doc_id = -1")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1 -------------------------------------------------------------------------------------------


def brute_repeats(rows, length=100):
    """(kept bytes, spans) of each row, rows in order."""
    seen, out = set(), []
    for text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            part = raw[at : at + length]
            if part in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(part)
        out.append((bytes(b for b, g in zip(raw, gone, strict=True) if not g), [m.span() for m in re.finditer(b"\1+", gone)]))
    return out


@pytest.mark.parametrize("size", [1500, 20_000, 8 << 20])
def test_repeats_equal_brute_force_for_any_batches(docs, size):
    rows = texts_of(docs)
    want = dict(zip([i for i, _ in rows], brute_repeats([t for _, t in rows]), strict=True))
    got = by_id(repeats.remove(docs.repartition(4), texts=True, batch_bytes=size, share_bytes=60_000))
    assert len(got) == len(want)
    assert any(spans for _, spans in want.values())
    for i, (kept, spans) in want.items():
        row = got[i]
        assert row["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert list(zip(row["span_starts"], row["span_ends"], strict=True)) == spans
        assert row["n_removed"] == sum(b - a for a, b in spans)


def test_repeats_odd_rows(odd, empty):
    got = collections.defaultdict(list)
    for r in repeats.remove(odd, batch_bytes=3000).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(ODD)
    assert got[2][0]["n_bytes"] == got[3][0]["n_bytes"] == 0
    assert got[1][0]["n_removed"] > 0  # the phrase repeats inside the text
    fours = sorted(r["n_removed"] for r in got[4])
    assert fours[0] == fours[1] == got[4][0]["n_bytes"]  # both came after row 1
    assert got[6][0]["n_removed"] == 0 and got[7][0]["n_removed"] >= len(LONG)
    assert got[9][0]["n_removed"] == 1600 - 1 or got[9][0]["n_removed"] >= 1500
    assert repeats.remove(empty).count() == 0
    assert repeats.cleaned(odd).columns == odd.columns


def test_repeated_rows_keep_one_text(spark):
    text = " ".join(f"{i}-x" for i in range(80))
    rows = spark.createDataFrame([(3, text), (3, text), (None, text)], "doc_id bigint, text string")
    kept = sorted(r["n_removed"] for r in repeats.remove(rows).collect())
    assert kept == [0, len(text), len(text)]


def test_family_levels_are_geometric():
    family, rng = repeats.Family(), np.random.default_rng(1)
    all_seeds = rng.integers(0, 4000, (40, 50)).astype(np.uint64)
    met = set()
    for k, seeds in enumerate(all_seeds):
        met |= set(family.add(seeds, np.arange(50) + 50 * k).tolist())
    values, counts = np.unique(all_seeds, return_counts=True)
    assert met == set(values[counts > 1].tolist())
    sizes = [len(level) for level, _ in family.levels]
    assert sum(sizes) == 2000 and len(sizes) <= 7 and sizes == sorted(sizes, reverse=True)
    where = np.sort(family.entries(np.array(sorted(met), np.uint64)))
    assert where.tolist() == np.flatnonzero(np.isin(all_seeds.reshape(-1), list(met))).tolist()


# 2 -------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = by_id(pieces.digests(docs, MODEL))
    for i, text in texts_of(docs):
        ids = library.encode(text)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert got[i]["covered_bytes"] == len(text.encode())


def test_spans_point_at_the_original(odd, empty):
    for row in pieces.encode(odd, MODEL).collect():
        raw = (row["text"] or "").encode()
        ends = row["ends"]
        assert b"".join(raw[a:b] for a, b in zip(row["starts"], ends, strict=True)) == raw
        assert len(row["ids"]) == len(ends)
        assert row["decoded"] == (row["text"] or "")
    assert pieces.encode(empty, MODEL).count() == 0


@given(st.text(alphabet="aé ﬁＡ\u3000\u00a0\t①が\u304b\u3099x ", max_size=24))
@settings(max_examples=150, deadline=None)
def test_normalizer_walks_the_compiled_map(text):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = proto.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
    spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = True, True, True
    normal, places = pieces.Normalizer(spec)(text.encode())
    plain = sentencepiece.SentencePieceNormalizer(
        model_proto=proto.ModelProto(normalizer_spec=spec).SerializeToString()
    )
    assert normal.decode() == plain.normalize(text)
    assert len(places) == len(normal) + 1 and (np.diff(places) >= 0).all()
    assert places[-1] <= len(text.encode())


# 3 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 20, 31])
def test_packed_ids_round_trip(bits):
    rng = np.random.default_rng(bits)
    buffer = io.BytesIO()
    writer = idfiles.Writer(buffer, bits)
    docs = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in (0, 1, 63, 64, 65, 20_000, 150_000, 3)]
    for k, ids in enumerate(docs):
        writer.add(None if k == 2 else k, ids)
    total = writer.close()
    reader = idfiles.Reader(buffer, buffer.getbuffer().nbytes)
    flat = np.concatenate(docs)
    assert total == len(flat) and reader.docs == [0, 1, None, 3, 4, 5, 6, 7]
    assert reader.checksums() == [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]
    for a, b in ((0, 0), (0, 5), (100, 30_000), (8191, 8193), (total - 3, total)):
        assert (reader.ids(a, b) == flat[a:b]).all()
    assert buffer.getbuffer().nbytes < len(flat) * bits / 8 + 4000


def test_id_files_equal_the_library(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    make = lambda d: idfiles.read(idfiles.write(d, BYTES, registry.byte_pattern(), 50_257, 2))
    got, start = by_id(make(docs.repartition(3))), 0
    for i, text in texts_of(docs):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    rows = sorted(make(odd).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i))
    for before, after in zip(rows, rows[1:], strict=False):
        assert after["start"] == before["start"] + before["n_tokens"]
    special = [*library.encode(ODD[5][1], add_special_tokens=False).ids, 2]
    assert next(r for r in rows if r["doc_id"] == 5)["n_tokens"] == len(special)
    assert make(empty).count() == 0


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_encoder_equals_tokenizers(text):
    encoder = idfiles.load(BYTES, registry.byte_pattern())
    assert encoder.fast is not None
    assert encoder(text).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


# 4 -------------------------------------------------------------------------------------------


def brute_rule(url, table):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    host, best = lower(host), None
    for h, p, _ in table:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and len(h + p) > len(best or ""):
            best = h + p
    return host, path, best


def test_url_rules_and_redirect_classes(spark):
    link = lambda to: f'<html><LINK href="{to}" rel=canonical><p>'
    go = lambda to: f'<meta content="0; url={to}" http-equiv="refresh">'
    table = [*registry.URL_RULES, ("bad.net", "/", "block"), ("ok.net", "", "allow")]
    rows = [
        (1, "http://A.Example.ORG/es/x?q=1#f", None),
        (2, "https://x.example.org/en/12", ""),
        (3, "https://notexample.org/es/1", None),
        (4, None, None),
        (5, "no scheme", None),
        (6, "http://a.net/1", link("http://a.net/2")),
        (7, "https://a.net/2#top", go("http://bad.net/z")),  # chain to a blocked page
        (8, "http://b.net/1", link("http://bad.net/y")),
        (9, "http://b.net/0", link("/1")),
        (10, "http://ok.net/q", go("//b.net/1")),  # an explicit allow in the class of 8 and 9
        (11, "http://bad.net/y", None),  # its own rule stays
        (12, "http://c.net", None),
        (12, "http://c.net", None),
        (13, "x://d.com/fr/1", None),
    ]
    pages = spark.createDataFrame([(*r, "n", "c") for r in rows], "page_id long, url string, html string, node string, component string")
    got = urls.judge(pages, table).collect()
    assert len(got) == len(rows)
    verdicts = {r["page_id"]: r["verdict"] for r in got}
    for r in got:
        url = next(u for i, u, _ in rows if i == r["page_id"])
        assert (r["host"], r["path"], r["rule"]) == brute_rule(url, table)
    assert [verdicts[i] for i in range(1, 14)] == "block block allow allow allow block block allow allow allow block allow allow".split()
    assert urls.judge(pages.where("page_id < 0"), table).count() == 0


def test_every_link_of_a_page_counts(spark):
    link = lambda to: f'<link rel="canonical" {to}>'
    go = lambda to: f'<meta http-equiv="refresh" content="0; url={to}">'
    rows = [
        (1, "http://a.net/1", link('href="http://c.net/1"') + link('href="http://bad.net/1"')),
        (2, "http://a.net/2", go("http://c.net/2") + "<p>" + go("http://bad.net/2")),
        (3, "http://a.net/3", f"<!--\n{link('href="http://c.net/{{x}}"')} -->" + link('href="http://bad.net/3"')),
        (4, "http://a.net/4", link("") + link('data-href="http://c.net/4" href="http://bad.net/4"')),
        (5, "http://a.net/5", f"<!-- {link('href="http://bad.net/5"')} -->"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, [("bad.net", "/", "block")]).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}
    nodes = {r["b"] for r in urls.link_edges(pages).collect()}
    assert nodes == {"c.net/1", "bad.net/1", "c.net/2", "bad.net/2", "bad.net/3", "bad.net/4"}


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 200)]
    some = [(2000 + int(a), 2000 + int(b)) for a, b in rng.integers(0, 120, (70, 2))]
    edges = [*chain, *star, *some, (7, 7), (None, 9), (1, 0)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e if n is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in parent}


# 5 -------------------------------------------------------------------------------------------


def shingles(text):
    w = WORDS.findall(lower(text))
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_groups_equal_brute_force(spark, docs):
    """Real documents, and a hub: copies of one text that are near it but seldom near each other."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(150)]
    copies = []
    for k in range(400):
        text = list(base)
        for place in rng.choice(150, rng.integers(0, 5), replace=False):
            text[place] = f"x{rng.integers(1 << 30)}"
        copies.append((10_000 + k, " ".join(text)))
    rows = texts_of(docs) + copies
    want = brute_groups(rows)
    got = by_id(forest.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert len({c for _, c in want.values()}) < len(rows)


def test_crowded_region_is_scanned_in_runs(spark, monkeypatch):
    rows = [(k, " ".join([*(f"w{j}" for j in range(100)), f"end{k}"])) for k in range(90)]
    monkeypatch.setattr(forest, "REGION", 16)
    got = forest.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {0}


def test_crowded_region_loses_no_copy(spark, monkeypatch):
    """Copies that reach the level with their base only, in regions far beyond what is proposed."""
    rng = np.random.default_rng(8)
    rows = [(0, " ".join(f"w{j}" for j in range(150)))]
    for k in range(1, 300):
        text = [f"w{j}" for j in range(150)]
        for place in rng.choice(np.arange(6, 144, 6), 2, replace=False):
            text[place] = f"x{rng.integers(1 << 30)}"
        rows.append((k, " ".join(text)))
    for name, value in (("REGION", 16), ("NEAR", 1), ("HUBS", 1), ("BLOCK", 40), ("LINK_ROWS", 25)):
        monkeypatch.setattr(forest, name, value, raising=False)
    got = by_id(forest.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_groups(rows)
    assert {r["component_id"] for r in got.values()} == {0}


def brute_kept(rows, level):
    """Smallest ids of the groups whose members share ``level`` percent with some other member."""
    sets = {i: shingles(t) for i, t in rows}
    of = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            common = len(sets[a] & sets[b])
            if b < a and of[a] != of[b] and common and 100 * common >= level * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((of[a], of[b]))
                of = {i: low if c == high else c for i, c in of.items()}
    return {i for i, c in of.items() if i == c}


def test_stage_removes_near_copies_at_four_fifths(spark, docs):
    """Copies between 0.80 and 0.85 of one text are near for the stage."""
    rng = np.random.default_rng(4)
    copies = []
    for k in range(200):
        text = [f"w{j}" for j in range(150)]
        for place in rng.choice(np.arange(6, 144, 6), 3 if k else 0, replace=False):
            text[place] = f"x{rng.integers(1 << 30)}"
        copies.append((10_000 + k, " ".join(text)))
    rows = texts_of(docs) + copies
    want = brute_kept(rows, 80)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    out = stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), SF)
    assert {r["doc_id"] for r in out.collect()} == want
    assert not want & {i for i, _ in copies[1:]}


@pytest.mark.parametrize("level", [forest.AT_85, forest.AT_80])
def test_estimate_misses_less_than_the_trees(level):
    share = level.share[0] / level.share[1]
    same = share + (1 - share) / 256  # different sets agree in a byte by chance
    n = forest.SYMBOLS
    missed = sum(math.comb(n, k) * same**k * (1 - same) ** (n - k) for k in range(level.least))
    assert missed < (1 - share**forest.DEPTH) ** level.trees


def test_groups_odd_rows(odd, empty):
    got = collections.defaultdict(set)
    for r in forest.groups(odd).collect():
        got[r["doc_id"]].add((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[2] == {(0, 2, True)} and got[3] == {(0, 3, True)} and got[8] == {(0, 8, True)}
    assert got[4] == {(6, 1, False)} and got[1] == {(6, 1, True)}
    assert got[7] == {(len(shingles(LONG + " end")), 6, False)}
    assert got[None] == {(6, None, True)}
    assert got[10] == {(1, 10, True)}
    assert forest.groups(empty).count() == 0
    kept = forest.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 3  # 4, 4 and 7 go


# 6 -------------------------------------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    w = WORDS.findall(text)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    count = collections.Counter(grams)
    covered = {j + k for j, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(docs, odd, empty):
    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        want = collections.Counter((r["doc_id"], *brute_measures(r["text"])) for r in rows)
        got = rules.judge(table).collect()
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        assert collections.Counter(tuple(r[n] for n in names) for r in got) == want
        for r in got:
            bad = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
            assert r["base_failed"] == bad and (not bad or not r["kept"])
    assert rules.judge(empty).count() == 0


def test_rules_keep_clean_documents(docs, labels):
    rows = written(rules.judge(docs), "judged").join(labels, "doc_id")
    assert rows.where("n_words >= 50 and quality = 1 and not kept").count() == 0
    assert rows.where("quality = 0 and kept").count() <= 5


# 7 -------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [
        (3, "http://a/ b", "x" * 300_000),
        (1, None, "same"),
        (2, "u\r\nInjected: 1", "same"),
        (4, "u", None),
        (5, "u", ""),
        (6, "u", "é ß \r\n\r\n body"),
        (None, "u", "same"),
        (None, "u", "lonely"),
        (7, "u", "twice"),
        (7, "u", "twice"),
    ]
    pages = spark.createDataFrame([(*r, "s") for r in rows], "page_id long, url string, html string, sha string").repartition(3)
    got = collections.Counter(tuple(r) for r in warc.read(warc.write(pages)).collect())
    want = collections.Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        first = min((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        response = first is None or i == first
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want[(i, len(raw), digest, "response" if response else "revisit", None if response else first)] += 1
    assert got == want
    big = warc.read(warc.write(pages, least=5)).collect()
    assert all(r["record_type"] == "response" for r in big if r["payload_bytes"] < 5)
    assert warc.write(pages.where("page_id < 0")).count() == 0


def test_reader_refuses_damage():
    payload = b"some payload"
    raw = warc.record("response", "1", "u", payload, warc.digest(payload))
    pack = lambda b: io.BytesIO((c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(b) + c.flush())
    assert [r["stored"] for r in warc.records(pack(raw))] == [len(payload)]
    for bad in (raw.replace(b"some payload", b"same payload"), raw[:-6], raw + b"x", raw.replace(b"WARC/1.1", b"XARC/1.1")):
        with pytest.raises(ValueError):
            list(warc.records(pack(bad)))
    cut = io.BytesIO(pack(raw).getvalue()[:-20])
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(cut))


# 8 -------------------------------------------------------------------------------------------


def test_ring_is_balanced_and_moves_little(spark, odd, empty):
    docs = spark.range(4003).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("text"))
    rows = ring.shard(docs).collect()
    by_shard = collections.defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
        text = f"t{r['doc_id'] % 7}"
        assert (r["size"], r["text_crc32"], r["law"]) == (3, zlib.crc32(text.encode()), "rows")
    assert len(rows) == 4003 and len({r["doc_id"] for r in rows}) == 4003
    assert {len(s) for s in by_shard.values()} <= {500, 501}
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sum(r["shard"] == r["home_shard"] for r in rows) > 0.8 * len(rows)
    assert len(ring.shard(odd).collect()) == len(ODD) and ring.shard(empty).count() == 0
    one = spark.range(1000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    assert sorted(r["count"] for r in ring.shard(one).groupBy("shard").count().collect()) == [125] * 8


@given(st.lists(st.integers(0, 40), min_size=17, max_size=17), st.integers(1, 5))
@settings(max_examples=100, deadline=None)
def test_allocation_equals_one_key_after_the_other(counts, shards):
    nodes = ring.virtual_nodes(shards, 4)[:16]
    owners = ([s for _, s in nodes] * 17)[:17]
    missing = set(range(shards)) - set(owners)
    if missing:
        return
    limits = ring.capacities(sum(counts), shards)
    pieces_ = ring.allocate(counts, owners, limits)
    used, want = [0] * shards, []
    for arc, n in enumerate(counts):
        for _ in range(n):
            step = arc
            while used[owners[step % 17]] >= limits[owners[step % 17]]:
                step += 1
            want.append((owners[step % 17], used[owners[step % 17]]))
            used[owners[step % 17]] += 1
    assert [(p.shard, p.slot + k) for p in pieces_ for k in range(p.last - p.first)] == want


# 9 -------------------------------------------------------------------------------------------


def brute_hits(text, items):
    w, hit, found = NUMBERS.findall(lower(text)), set(), set()
    for i, item in items:
        x = NUMBERS.findall(lower(item))
        n = min(10, len(x))
        wins = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
        for j in range(len(w) - n + 1 if n else 0):
            if tuple(w[j : j + n]) in wins:
                hit |= set(range(j, j + n))
                found.add(i)
    names = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


def test_contamination_equals_brute_force(spark, docs, odd, empty):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    short = [(1, "the cat sat"), (2, None), (3, ""), (None, "the cat"), (4, "THE MAT the cat sat on the mat the cat sat on"), (1, "the cat sat"), (5, " ".join(f"word{i % 997} of the {i}" for i in range(300, 310)))]
    for table, tests in ((docs, items), (odd, short)):
        frame = spark.createDataFrame(tests, "item_id long, text string")
        want = collections.Counter((r["doc_id"], *brute_hits(r["text"], [x for x in tests if x[0] is not None])) for r in table.collect())
        got = collections.Counter((r["doc_id"], *(r[n] for n in names)) for r in winnow.contamination(table, frame).collect())
        assert got == want
        assert any(k[5] for k in want) and not all(k[5] for k in want)
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnow.contamination(odd, none).where("contaminated").count() == 0
    assert winnow.contamination(empty, none).count() == 0
    assert winnow.decontaminate(odd, spark.createDataFrame(short, "item_id long, text string")).columns == odd.columns


def test_items_without_an_id_hit(spark):
    docs = spark.createDataFrame([(1, "some words of a passage here"), (2, "other words")], "doc_id long, text string")
    items = [(None, "a passage here"), (7, "of a")]
    names = ["doc_id", "n_hit", "n_items", "items_sha256", "contaminated"]
    listed = hashlib.sha256(b"7").hexdigest()
    for tests, want in ((items, (1, 4, 1, listed, True)), (items[:1], (1, 3, 0, hashlib.sha256(b"").hexdigest(), True))):
        frame = spark.createDataFrame(tests, "item_id long, text string")
        got = {r["doc_id"]: tuple(r[n] for n in names) for r in winnow.contamination(docs, frame).collect()}
        assert got[1] == want and not got[2][4]
        assert [r["doc_id"] for r in winnow.decontaminate(docs, frame).collect()] == [2]


# 10 ------------------------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    where = "/root/testdata/sf0.01"
    scores = registry.op10_quality_classifier(spark, where)
    assert scores.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scores.join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").where("held_out").collect()
    clean = [r for r in rows if r["quality"] == 1]
    junk = [r for r in rows if r["quality"] == 0]
    assert np.mean([r["predicted"] for r in clean]) >= 0.98
    assert np.mean([1 - r["predicted"] for r in junk]) >= 0.8
    loss = -np.mean([np.log(max(r["score"] if r["quality"] else 1 - r["score"], 1e-9)) for r in rows])
    assert loss < 0.15
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_classifier_odd_rows(odd, empty, labels, docs):
    assert quality.classify(odd, labels.where("false")).where("score <> 0.5").count() == 0
    both = docs.select("doc_id", "text")
    extra = both.unionByName(odd.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))
    got = collections.defaultdict(set)
    for r in quality.classify(extra, labels).collect():
        got[r["doc_id"]].add((r["score"], r["predicted"]))
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    assert got[1_000_002] == got[1_000_003] and got[1_000_001] == got[1_000_004]
    assert quality.classify(empty, labels).count() == 0
    assert quality.accepted(odd, labels.where("false")).columns == odd.columns


def test_long_texts_do_not_shrink_the_sample(spark, docs, labels, monkeypatch):
    """One labelled text over the budget and three that would fill it, first in the order."""
    rows = spark.createDataFrame(quality.sample(docs, labels).collect())
    first = [r["doc_id"] for r in rows.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(4).collect()]
    sizes = [r["size"] for r in rows.where(~F.col("doc_id").isin(first)).collect()]
    monkeypatch.setattr(quality, "SAMPLE_BYTES", sum(sizes))
    monkeypatch.setattr(quality, "LONG_BYTES", max(sizes), raising=False)
    length = dict(zip(first, [sum(sizes) + 1, *[max(max(sizes) + 1, sum(sizes) // 3)] * 3], strict=True))
    texts = docs.select("doc_id", "text")
    long = spark.createDataFrame([(i, "word " * (n // 5 + 1)) for i, n in length.items()], "doc_id long, text string")
    others = texts.where(~F.col("doc_id").isin(first))
    got, want = quality.fit(others.unionByName(long), labels), quality.fit(others, labels)
    assert all((x == y).all() for x, y in zip(got.layers, want.layers, strict=True))


def test_a_label_that_no_sample_holds_is_an_error(docs, labels, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 10)
    with pytest.raises(ValueError, match="both labels"):
        quality.fit(docs, labels)
    with pytest.warns(UserWarning, match="one label"):
        assert quality.fit(docs, labels.where("quality = 1")) is None


def test_learning_never_sees_held_out_labels(docs, labels):
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert all((x == y).all() for x, y in zip(a.layers, b.layers, strict=True)) and a.temperature == b.temperature


def test_temperature_flattens_overconfidence():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 4000)
    logits = np.where(rng.random(4000) < 0.8, 1, -1) * np.where(y == 1, 9.0, -9.0)
    assert 5 < quality.temperature(logits, y) < 8.1


# all -----------------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs):
    made = corpus_pipeline.run(spark, SF).collect()
    assert {"doc_id", "lang", "source", "n_chars", "ids", "n_tokens"} <= set(made[0].asDict())
    frame = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = corpus_pipeline.written(stage(spark, frame, SF), f"t{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert frame.columns == docs.columns and frame.dtypes == docs.dtypes
    assert {r["doc_id"] for r in frame.collect()} == {r["doc_id"] for r in made}
    assert 100 < len(made) < docs.count()


def test_stages_equal_brute_force(spark, docs):
    """Each stage that needs no model, on its own input, against plain Python."""
    stages = dict(corpus_pipeline.STAGES)
    rows = texts_of(docs)
    ids = [i for i, _ in rows]
    of = lambda name, frame=docs: {r["doc_id"]: r["text"] for r in stages[name](spark, frame, SF).collect()}
    kept = brute_kept(rows, 80)
    assert of("near_dedup") == {i: t for i, t in rows if i in kept}
    cut = [k.decode("utf-8", "ignore") for k, _ in brute_repeats([t for _, t in rows])]
    assert of("repeat_removal") == dict(zip(ids, cut, strict=True))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert of("decontamination") == {i: t for i, t in rows if not brute_hits(t, items)[4]}
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = by_id(stages["sentencepiece"](spark, docs, SF))
    assert {i: list(r["ids"]) for i, r in got.items()} == {i: library.encode(t) for i, t in rows}


def test_last_stage_returns_original_spans(spark, docs):
    out = by_id(dict(corpus_pipeline.STAGES)["sentencepiece"](spark, docs, SF))
    for i, text in texts_of(docs):
        raw, row = text.encode(), out[i]
        assert len(row["starts"]) == len(row["ends"]) == len(row["ids"]) == row["n_tokens"]
        assert b"".join(raw[a:b] for a, b in zip(row["starts"], row["ends"], strict=True)) == raw


def test_stages_on_odd_tables(spark, docs, odd):
    small = odd.select("doc_id", "text").selectExpr("doc_id", "text", "cast(null as string) lang", "'s' source", "cast(null as long) n_chars")
    for rows in (small, small.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            assert out.count() <= rows.count(), name


def test_entry_registers_every_operator():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(registry.LLM_ORACLES) <= set(names)


@pytest.mark.parametrize("name", sorted(registry.LLM_ORACLES))
def test_sql_counterparts(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        db.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = db.sql(registry.LLM_ORACLES[name]).df()
    got = registry.LLM_QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    key = want.columns[0]
    want, got = (x.sort_values(key).astype(object).where(lambda v: v.notna(), None).values.tolist() for x in (want, got))
    assert got == want


def test_small_texts_have_no_runs():
    raw, starts = np.frombuffer(b"x" * 99, np.uint8), np.array([0, 99])
    assert len(repeats.runs(raw, starts)[0]) == 0
    assert forest.shingle_sets(pa.array(["", " a b "]))[1].tolist() == [0, 1]
