"""The Merkle manifest, spelling variants and the tiled Jaccard join against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from worksift.llm import merkle, tiles, variants

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 997} of the {i}" for i in range(60_000))  # about a megabyte
EXTRA = "leaf string, tree string, place string, total string, root string, path string, id string, n string, node string, keys string, word string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows, extra=True):
    """Documents with columns that clash with internal names."""
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame(rows, kinds)
    if extra:
        df = df.select("*", *[F.lit("x").alias(c.split()[0]) for c in EXTRA.split(", ")])
    return df.repartition(3)


def documents(spark, rows):
    return frame(spark, [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows])


ODD = [
    (1, "Straße Äpfel ABC"), (2, None), (3, ""), (4, "same text here"), (4, "same text here"), (5, LONG), (6, LONG + " end"),
    (None, "no id but text of some words and the like"), (None, "no id but text of some words and the like"),
    (7, " \n\t "), (8, "a" * 200_000), (8, "two words"), (9, " " * 300_000), (10, "1" * 100_000),
]


@pytest.fixture(scope="module")
def given_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# manifest ------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def brute_path(levels, i):
    for level in levels[:-1]:
        first = i // 8 * 8
        yield level[first:i], level[i + 1 : first + 8]
        i //= 8


def brute_manifest(rows):
    """Rows (doc_id, text, lang, source, n_chars) to sorted result rows."""
    leaf = lambda r, text: sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r, leaf(r, r[1])))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {lang: brute_tree([x[1] for x in groups[lang]]) for lang in langs}
    top = brute_tree([trees[lang][-1][0] for lang in langs])
    out = []
    for at, lang in enumerate(langs):
        for i, (r, own) in enumerate(groups[lang]):
            path = [*brute_path(trees[lang], i), *brute_path(top, at)]
            cur = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                cur = leaf(r, r[1] and lower(r[1]))
            for left, right in path:
                cur = sha("".join(left) + cur + "".join(right))
            proof = sha("".join("".join(a + b) for a, b in path))
            out.append((r[0], own, trees[lang][-1][0], top[-1][0], proof, cur, cur == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 3])
def test_manifest_equals_brute_force(spark, given_docs, height):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in given_docs.collect()]
    got = merkle.audit(frame(spark, rows), height).collect()
    want = brute_manifest(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert any(not r.verified for r in got) and any(r.verified for r in got)


def test_manifest_of_many_rows(spark):
    """Trees of three rounds; one language holds most rows, one a single row, one is null."""
    rows = [(i, f"Text {i}", "en", "s", i) for i in range(4200)]
    rows += [(5000 + i, f"B{i}", None, None, None) for i in range(513)] + [(1, "one", "zz", "s", 3)]
    rows += [(9000, "x", f"l{k}", "s", 1) for k in range(70)]
    got = merkle.audit(frame(spark, rows, extra=False)).collect()
    assert sorted(map(tuple, got), key=str) == brute_manifest(rows)


def test_manifest_odd_rows(spark):
    rows = [(i, t, lang, None, None) for (i, t), lang in zip(ODD, itertools.cycle(["en", None, ""]), strict=False)]
    got = merkle.audit(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_manifest(rows)
    assert merkle.audit(frame(spark, [])).count() == 0
    alone = merkle.audit(frame(spark, [(4, "Ab", "en", "s", 2)])).first()
    assert alone.leaf == alone.subroot == alone.root and alone.proof_sha256 == sha("")


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_are_a_layout(levels):
    places = merkle.addresses(levels)
    assert [len(p) for p in places] == [8**d for d in range(levels)]
    assert sorted(np.concatenate(places)) == list(range(merkle.nodes_in(levels)))
    if levels == 4:  # the two upper levels first, then a subtree after the other
        assert places[0][0] == 0 and places[1].tolist() == list(range(1, 9))
        assert places[2][:3].tolist() == [9, 18, 27] and places[3][:9].tolist() == [*range(10, 18), 19]


def test_a_changed_node_is_noticed():
    block = merkle.Block.build([hashlib.sha256(bytes([k])).digest() for k in range(70)], 3)
    root = block.nodes[0].tobytes().hex()
    paths = list(block.paths())
    assert all(merkle.folded(block.leaf(k).hex(), p) == root for k, p in enumerate(paths))
    place, others = paths[3][1]
    broken = [paths[3][0], (place, "0" + others[1:] if others[0] != "0" else "1" + others[1:]), *paths[3][2:]]
    assert merkle.folded(block.leaf(3).hex(), broken) != root


# spelling variants ---------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    p = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def near_pairs(words):
    by_size = collections.defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    out = set()
    for n, here in by_size.items():
        for a, b in itertools.chain(itertools.combinations(here, 2), itertools.product(here, by_size.get(n + 1, []))):
            if one_edit(a, b):
                out |= {(a, b), (b, a)}
    return out


def neighbours(spark, words):
    words = sorted(words)
    df = spark.createDataFrame(list(enumerate(words)), "id bigint, word string").repartition(3)
    return {(words[r.a], words[r.b]) for r in variants.neighbours(df).collect()}


def test_neighbours_equal_brute_force(spark):
    """Words of a small alphabet, so that edits repeat letters, on either side of a piece's end."""
    pick, words = random.Random(5), set()
    for size in (1, 2, 7, 8, 15, 16, 17, 31, 32, 33, 48, 49, 65):
        for _ in range(25):
            word = "".join(pick.choice("ab") for _ in range(size))
            words.add(word)
            for _ in range(3):
                k, c = pick.randrange(size), pick.choice("abcé")
                words.add(pick.choice((word[:k] + c + word[k + 1 :], word[:k] + c + word[k:], word[:k] + word[k + 1 :], word + c)))
    words.discard("")
    want = near_pairs(words)
    assert neighbours(spark, words) == want and len(want) > 1000


def test_neighbours_of_very_long_words(spark):
    base = "".join(random.Random(1).choice("abcdefg") for _ in range(20_000))
    words = [base, base + "a", "x" + base, base[:9_999] + "é" + base[10_000:], base[:15] + base[16:], base[::-1]]
    assert neighbours(spark, words) == near_pairs(words) and near_pairs(words)


def brute_variants(rows):
    counts = collections.Counter()
    for doc, text in rows:
        for run in map(lower, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    near = collections.defaultdict(list)
    for a, b in near_pairs(words):
        near[a].append(b)
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: f for w, f in best.items() if words[f] >= 10 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def test_variants_equal_brute_force(spark, given_docs):
    rows = [(r.doc_id, r.text) for r in given_docs.collect()]
    got = {tuple(r) for r in variants.variants(documents(spark, rows)).collect()}
    assert got == brute_variants(rows) and any(r[1] for r in got)


def test_roots_follow_forms(spark):
    """Three words whose counts rise tenfold: the root of the rarest is the commonest; ties go to the smaller."""
    text = "elephant " * 300 + "elephans " * 30 + "elephbns " * 3 + "Wonderfül " * 20 + "wonderfal wonderful " * 30 + "wonderfül wonderfxl " * 2
    rows = [(None, text), (None, None), (1, ""), (2, "ab cd")]
    got = {r.word: r for r in variants.variants(documents(spark, rows)).collect()}
    assert got["elephbns"].form == "elephans" and got["elephbns"].root == got["elephans"].root == "elephant"
    assert got["wonderfxl"].form == "wonderfal" and got["wonderfxl"].form_n == 30 and got["wonderfxl"].n_near == 3
    assert {tuple(r) for r in got.values()} == brute_variants(rows)


def test_variants_odd_rows(spark):
    rows = [*ODD, (11, "a" * 200_000 + "é"), (12, "a" * 199_999), (13, "a" * 199_999)]
    got = {tuple(r) for r in variants.variants(documents(spark, rows)).collect()}
    assert got == brute_variants(rows)
    assert variants.variants(documents(spark, [])).count() == 0


@given(st.text(alphabet="abé", min_size=1, max_size=70))
@settings(max_examples=60, deadline=None)
def test_pieces_cover_the_last_half(word):
    for mark, here in ((b"f", word), (b"b", word[::-1])):
        own = [p for p in variants.pieces_of(word) if p[0].startswith(mark)]
        starts = len(word) // 2
        whole = "".join(p[1] for p in own)
        assert here.endswith(whole) and len(here) - len(whole) <= starts
        assert all(len(p[1]) == variants.PIECE for p in own[:-1]) and len(own[-1][1]) < variants.PIECE


# tiled join ----------------------------------------------------------------------------------


def shingles(text, k=3):
    words = [lower(w) for w in WORDS.findall(text or "")]
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_join(rows):
    """Sorted (doc_id, size, component) and the number of links between different sets."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            held[g].append(i)
    shared, links = collections.Counter(), 0
    for ids in held.values():
        shared.update(itertools.combinations(ids, 2))
    for (a, b), n in shared.items():
        if 100 * n >= 90 * (len(sets[a]) + len(sets[b]) - n):
            links += sets[a] != sets[b]
            parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str), links


def joined(df):
    return sorted((tuple(r)[:3] for r in tiles.join(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def planted(seed):
    """Families of copies with a few edits, of all sizes around the bands' ends, with shared and null ids."""
    pick, rows = random.Random(seed), []
    vocabulary = [f"w{k}" for k in range(3000)]
    for family in range(50):
        base = [pick.choice(vocabulary) for _ in range(pick.choice((1, 2, 3, 5, 8, 10, 11, 12, 13, 20, 21, 30, 60, 100, 200, 400, 700)))]
        for _ in range(40 if family % 9 == 0 else pick.choice((1, 3, 8))):
            words = list(base)
            for _ in range(pick.randrange(max(1, len(base) // 60) + 2)):
                k = pick.randrange(len(words)) if words else 0
                how = pick.randrange(3)
                if how == 1 or not words:
                    words.insert(k, pick.choice(vocabulary))
                elif how == 0:
                    words[k] = pick.choice(vocabulary)
                else:
                    words.pop(k)
            rows.append((len(rows) // 2 if family % 5 == 0 else len(rows) + 1000, " ".join(words)))
    return rows + [(None, rows[5][1]), (None, None), (7, None), (8, ""), (9, " \n "), (None, "only unnamed words"), (None, "only unnamed words")]


@pytest.mark.parametrize("seed,tile", [(3, 512), (4, 8)])
def test_join_equals_brute_force(spark, seed, tile, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", tile)
    monkeypatch.setattr(tiles, "LINK_ROWS", 2 * tile)
    rows = planted(seed)
    want, links = brute_join(rows)
    assert links > 200 and joined(documents(spark, rows)) == want


def test_join_of_the_given_documents(given_docs):
    rows = [(r.doc_id, r.text) for r in given_docs.collect()]
    assert joined(given_docs) == brute_join(rows)[0]


def test_join_odd_rows(spark):
    assert joined(documents(spark, ODD)) == brute_join(ODD)[0]
    assert tiles.join(documents(spark, [])).count() == 0


def test_partners_share_a_band():
    for size in [*range(1, 400), 5000, 99_999]:
        for partner in {size, (size + tiles.largest_partner(size)) // 2, tiles.largest_partner(size)}:
            own = {band for band, is_own in tiles.schemes(size) if is_own}
            assert own & {band for band, _ in tiles.schemes(partner)}
            band = own.pop()
            assert 100 * (size + partner) >= 1900 * (tiles.bands()[band][1] - 1) or tiles.bands()[band][1] * 19 > size + partner


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=300), st.randoms())
@settings(max_examples=60, deadline=None)
def test_bitmaps_bound_the_overlap(values, pick):
    a = np.array(sorted(values), np.uint64)
    b = np.array(sorted(v for v in values | {pick.getrandbits(64) for _ in range(20)} if pick.random() < 0.9), np.uint64)
    wide = tiles.bitmap(b, 1024)
    for bits in (64, 256, 1024):
        differ = int(np.bitwise_count(tiles.bitmap(a, bits) ^ tiles.narrowed(wide, bits)).sum())
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - differ) // 2
