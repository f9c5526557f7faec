"""Columns with any name through the stages, very long runs through every operator, folders of stores."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from worksift.llm import common, forest, idfiles, merkle, pieces, quality, registry, repeats, ring, rules, tiles, variants, winnow

SF = "/root/testdata/sf0.001"
# Names that operators use inside or give their results.
CLASH = (
    "_id _key _text text_key ids starts ends n_tokens decoded_sha256 decoded kept_text n_bytes n_removed n_spans kept_sha256 "
    "score held_out predicted class batch row rows path first length words marks h component kept label"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def extended(docs):
    return docs.select("*", *[(F.col("doc_id") * 100 + k).alias(c) for k, c in enumerate(CLASH)])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    wide = extended(docs)
    out = stage(spark, wide, SF)
    made = corpus_pipeline.MADE if name == "sentencepiece" else ()
    kept = [c for c in wide.columns if c not in made and not (made and c == "text")]
    assert out.columns == [*kept, *made]
    rows = {r["doc_id"]: r for r in out.collect()}
    plain = {r["doc_id"]: r for r in stage(spark, docs, SF).collect()}
    assert set(rows) == set(plain) and len(rows) > 50
    given = {r["doc_id"]: r for r in docs.collect()}
    for i, r in rows.items():
        assert all(r[c] == i * 100 + k for k, c in enumerate(CLASH) if c not in made)
        assert all(r[c] == plain[i][c] for c in plain[i].asDict())
        assert all(r[c] == given[i][c] for c in ("lang", "source"))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_few_columns_and_no_rows(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    two = docs.select("text", "doc_id")
    out = stage(spark, two.where("false"), SF)
    assert out.count() == 0
    some = stage(spark, two.limit(30), SF)
    assert some.columns == ([*corpus_pipeline.MADE] and ["doc_id", *corpus_pipeline.MADE] if name == "sentencepiece" else ["text", "doc_id"])
    assert some.count() > 0


LONG = 1_200_000
RUNS = [(1, " " * LONG), (2, "a" * LONG), (3, "7" * LONG), (4, "\n" * LONG), (5, "é" * (LONG // 2)), (6, "a b " * (LONG // 4)), (7, "short")]


@pytest.fixture(scope="module")
def runs(spark):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in RUNS], kinds).repartition(4)


def test_id_files_of_long_runs_equal_the_library(runs):
    path = registry.tokenizer_file("byte_bpe_50k.json")
    encoder = idfiles.Encoder(path, registry.byte_pattern())
    assert encoder.fast is not None
    out = {r["doc_id"]: r for r in idfiles.read(idfiles.write(runs, path, registry.byte_pattern(), registry.BYTE_VOCABULARY, registry.END_ID)).collect()}
    for i, text in RUNS:
        assert out[i]["n_tokens"] == len(encoder.library.encode(text, add_special_tokens=False).ids) + 1


def test_other_tokenizer_files_are_left_to_the_library():
    spec = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "model": {"type": "BPE", "ignore_merges": False}}
    assert idfiles.plain_byte_level(spec)
    for change in (
        {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None},
        {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {"type": "BPE", "ignore_merges": True}}, {"model": {"type": "BPE", "dropout": 0.1}},
        {"truncation": {"max_length": 3}},
    ):
        assert not idfiles.plain_byte_level(spec | change)
    assert idfiles.Encoder(registry.tokenizer_file("byte_bpe_50k.json"), r"\S+|\s+").fast is None


OPERATORS = {
    "repeats": lambda d, s: repeats.remove(d.select("doc_id", "text")),
    "pieces": lambda d, s: pieces.digests(d, registry.tokenizer_file("piece_bpe_32k.model")),
    "forest": lambda d, s: forest.groups(d),
    "rules": lambda d, s: rules.judge(d),
    "ring": lambda d, s: ring.shard(d),
    "winnow": lambda d, s: winnow.contamination(d, s.read.parquet(f"{SF}/benchmark.parquet")),
    "quality": lambda d, s: quality.classify(d.select("doc_id", "text"), s.read.parquet(f"{SF}/labels.parquet").where("false")),
    "merkle": lambda d, s: merkle.audit(d),
    "tiles": lambda d, s: tiles.join(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_on_long_runs(spark, runs, name):
    out = {r["doc_id"]: r for r in OPERATORS[name](runs, spark).collect()}
    assert set(out) == {i for i, _ in RUNS}
    if name in ("forest", "tiles"):
        assert [out[i]["n_shingles"] for i in (1, 2, 3, 4, 6, 7)] == [0, 1, 1, 0, 2, 1]
    if name == "repeats":  # in a run of equal bytes every string but the first has an equal one to its left
        assert out[1]["n_removed"] == out[2]["n_removed"] == LONG - 1 and out[7]["n_removed"] == 0
        assert out[3]["kept_sha256"] == hashlib.sha256(b"7").hexdigest()
    if name == "pieces":
        assert all(out[i]["covered_bytes"] == len(t.encode()) for i, t in RUNS)


def test_words_of_long_runs(runs):
    assert variants.variants(runs).count() == 0  # every long word occurs once


def test_folders_of_stores(spark):
    assert common.store_uri("s3a://b/x") == common.store_uri("s3n://b/x") == "s3://b/x"
    assert common.store_uri("file:/tmp/x") == common.store_uri("file:///tmp/x") == "file:///tmp/x"
    assert common.store_uri("hdfs://host:9000/x") == "hdfs://host:9000/x"
    with pytest.raises(ValueError):
        common.store_uri("/tmp/x")
    assert common.files_folder(spark, "x").startswith("file:/")


def test_a_bare_folder_is_qualified_by_sparks_file_system(spark, monkeypatch):
    """A folder without a scheme belongs to the session's default file system, whatever that is."""
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.other.link./shared", "file:///tmp")
    conf.set("fs.defaultFS", "viewfs://other/")
    monkeypatch.setattr(common, "run_dir", lambda _: "/shared/run")
    try:
        assert common.files_folder(spark, "x") == "viewfs://other/shared/run/x"
    finally:
        conf.set("fs.defaultFS", before)


def test_windows_that_many_items_share_are_one_row_per_place(spark, monkeypatch):
    """200 documents hold a window of 100 items in five places each: 1,000 rows, not 100,000."""
    window = " ".join(f"shared{k}" for k in range(10))
    texts = [(i, " ".join(f"{window} own{i}x{k}" for k in range(5))) for i in range(200)]
    items = [(i, f"{window} item{i}") for i in range(100)]
    counts, keep = {}, winnow.written

    def counted(df, label):
        out = keep(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(winnow, "written", counted)
    out = winnow.contamination(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    rows = out.collect()
    assert counts["hits"] == 1000
    assert {(r["n_hit"], r["n_items"], r["contaminated"]) for r in rows} == {(50, 100, True)}
