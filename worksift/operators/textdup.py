"""Identical and near-identical descriptions inside one constituency or one district authority.

Input works have ``work_id, constituency, implementing_district_authority, work_description,
activity_name, implementing_agency, completion_status, sanctioned_amount_inr, sanction_date``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from worksift import config
from worksift.functions.money import exact_sum
from worksift.functions.text import canonical_text, content_tokens
from worksift.plans.ranking import global_rank, rank_in_group
from worksift.plans.storage import written

SCOPES = {"constituency": "constituency", "authority": "implementing_district_authority"}


def candidate_id(*parts: Column) -> Column:
    joined = F.concat_ws("|", F.lit(config.FINDER_VERSION), *parts)
    return F.substring(F.sha2(joined, 256), 1, 16)


def described(works: DataFrame) -> DataFrame:
    """Works with a canonical text, its digest and fingerprint; blank texts are left out."""
    canonical = canonical_text(F.coalesce("work_description", F.lit("")))
    return (
        # A generated column is made once: the filter on it would be pushed below what deals the rows out, and made there too.
        works.withColumn("canonical", F.explode(F.array(canonical)))
        .where(F.col("canonical") != "")
        .withColumn("digest", F.sha2("canonical", 256))
        .withColumn("fingerprint", F.substring("digest", 1, 16))
    )


def text_groups(texts: DataFrame) -> DataFrame:
    """``scope_kind, scope, fingerprint, work_count, constituencies`` of every group of works with
    one text in one scope. Only digests travel, not texts."""
    parts = []
    for kind, column in SCOPES.items():
        scoped = texts.where(F.length(column) > 0) if kind == "authority" else texts
        per_place = scoped.groupBy(F.col(column).alias("scope"), "digest", "constituency").agg(
            F.count("*").alias("n")
        )
        parts.append(
            per_place.groupBy(F.lit(kind).alias("scope_kind"), "scope", "digest").agg(
                F.sum("n").alias("work_count"),
                F.count("*").alias("constituency_count"),
                F.min("constituency").alias("constituency_first"),
                F.max("constituency").alias("constituency_last"),
            )
        )
    return parts[0].unionByName(parts[1]).withColumn("fingerprint", F.substring("digest", 1, 16))


def _usual(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per key, the smallest on a tie; empty ones do not count."""
    counted = rows.where(F.length(value) > 0).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


# Name of each list of a group and the column behind it.
_NAMES = {"agencies": "implementing_agency", "constituencies": "constituency"}
LIST_LENGTH = 10_000  # names in one row


def _scoped(texts: DataFrame, kind: str) -> DataFrame:
    column = SCOPES[kind]
    rows = texts.where(F.length(column) > 0) if kind == "authority" else texts
    return rows.withColumn("scope", F.col(column))


def text_group_summary(texts: DataFrame, kind: str) -> DataFrame:
    """What a reviewer sees of each group of one scope kind, with its works in order, its places and agencies by
    name and number, and the works of every status; ``text_group_names`` has the names in parts. A row is as
    long as its group: readers that need no works leave ``work_ids`` unread, and then it is not made."""
    keys = ["scope", "digest"]
    rows = _scoped(texts, kind)
    by_status = rows.groupBy(*keys, "completion_status").agg(
        F.count("*").alias("n"),
        F.min("sanctioned_amount_inr").alias("least"),
        F.max("sanctioned_amount_inr").alias("most"),
        F.sum(F.col("sanctioned_amount_inr").cast("decimal(28,4)")).alias("total"),
        F.min("sanction_date").alias("first"),
        F.max("sanction_date").alias("last"),
        F.collect_list("work_id").alias("ids"),
    )
    status = F.when(F.col("completion_status").isNotNull(), F.struct("completion_status", "n"))
    figures = by_status.groupBy(*keys).agg(
        F.sum("n").alias("work_count"),
        F.round(F.min("least"), 2).alias("amount_min_inr"),
        F.round(F.max("most"), 2).alias("amount_max_inr"),
        F.round(F.coalesce(F.sum("total").cast("double"), F.lit(0.0)), 2).alias("amount_total_inr"),
        F.min("first").alias("sanction_date_first"),
        F.max("last").alias("sanction_date_last"),
        F.map_from_entries(F.sort_array(F.collect_list(status))).alias("statuses"),
        F.sort_array(F.flatten(F.collect_list("ids"))).alias("work_ids"),
    )
    # Distinct places and agencies per group: collected after they are made distinct.
    names = _distinct_names(rows).groupBy(*keys).agg(
        *[F.count_if(F.col("list") == n).alias(f"{n}_count") for n in _NAMES],
        *[F.sort_array(F.collect_list(F.when(F.col("list") == n, F.col("name")))).alias(n) for n in _NAMES],
    )
    out = figures.join(_usual(rows, keys, "work_description"), keys, "left")
    out = out.join(_usual(rows, keys, "activity_name"), keys, "left").join(names, keys, "left")
    return out.select(
        F.lit(kind).alias("scope_kind"),
        "scope",
        F.substring("digest", 1, 16).alias("fingerprint"),
        F.col("work_description").alias("text"),
        F.col("activity_name").alias("activity"),
        *[F.coalesce(n, F.array().cast("array<string>")).alias(n) for n in _NAMES],
        *[F.coalesce(f"{n}_count", F.lit(0)).alias(f"{n}_count") for n in _NAMES],
        *[c for c in figures.columns if c not in keys],
    )


def _distinct_names(rows: DataFrame) -> DataFrame:
    """``scope, digest, list, name``: each place and agency of a group once."""
    both = F.array(*[F.struct(F.lit(n).alias("list"), F.col(c).alias("name")) for n, c in _NAMES.items()])
    return rows.select("scope", "digest", F.explode(both).alias("_n")).select("scope", "digest", "_n.*").where(F.length("name") > 0).distinct()


def text_group_names(texts: DataFrame, kind: str, length: int = LIST_LENGTH) -> DataFrame:
    """``scope_kind, scope, fingerprint, list, part, names``: the constituencies and agencies of each
    group in order, as lists of at most ``length`` numbered by ``part``, so no group is one row."""
    keys = ["scope", "digest", "list"]
    placed = rank_in_group(_distinct_names(_scoped(texts, kind)), keys, [F.col("name")], "_place")
    part = F.floor((F.col("_place") - 1) / length).cast("int").alias("part")
    lists = placed.groupBy(*keys, part).agg(F.sort_array(F.collect_list("name")).alias("names"))
    return lists.select(F.lit(kind).alias("scope_kind"), "scope", F.substring("digest", 1, 16).alias("fingerprint"), "list", "part", "names")


def _batches(texts: DataFrame, kind: str, finder: str, keep: Column) -> DataFrame:
    groups = text_groups(texts).where((F.col("scope_kind") == kind) & keep)
    column = SCOPES[kind]
    amounts = texts.groupBy(F.col(column).alias("scope"), "digest").agg(
        F.max("sanctioned_amount_inr").alias("largest"),
        exact_sum(F.col("sanctioned_amount_inr")).alias("total"),
    )
    crossing = (F.round("largest", 2) < config.PER_WORK_LIMIT_INR) & (
        F.round("total", 2) >= config.GROUP_TOTAL_FLOOR_INR
    )
    return groups.join(amounts, ["scope", "digest"]).select(
        candidate_id(F.lit(finder), F.col("scope"), F.col("fingerprint")).alias("candidate_id"),
        F.lit(finder).alias("finder"),
        "scope",
        "fingerprint",
        "work_count",
        F.coalesce(crossing, F.lit(False)).alias("threshold_crossing_batch"),
    )


def identical_batches(texts: DataFrame) -> DataFrame:
    """Two or more works of one constituency with one canonical text."""
    return _batches(texts, "constituency", "identical_batch", F.col("work_count") >= 2)


def district_identical_batches(texts: DataFrame) -> DataFrame:
    """One text under one authority, in two or more constituencies."""
    return _batches(texts, "authority", "district_identical_batch", F.col("constituency_count") >= 2)


# -- similarity -------------------------------------------------------------------------------


def distinct_texts(texts: DataFrame) -> DataFrame:
    """Each canonical text once, numbered in text order: ``t, digest, canonical``."""
    once = texts.groupBy("digest").agg(F.first("canonical").alias("canonical"))
    # Range bounds are sampled through the driver: whole texts stay out of them.
    begins = F.substring("canonical", 1, 256)
    return written(global_rank(once, [F.col("canonical")], "t", ranges=[begins]), "texts")


def text_words(numbered: DataFrame) -> DataFrame:
    """``t, word, n``. Texts are dealt out by number once; counting their words then needs no further
    shuffle: a text is one row to begin with."""
    rows = numbered.select("t", "canonical").repartition("t")
    words = rows.select("t", F.explode(F.split("canonical", " ")).alias("word"))
    return words.groupBy("t", "word").agg(F.count("*").alias("n"))


_CHARS_TOGETHER = 1 << 20  # characters whose pieces are counted together, about
_PIECES_KNOWN = 500_000  # pieces kept with their numbers in a task, about


def _word_pieces(word: str) -> list[str]:
    """Every 3 to 5 character piece of a word between two spaces."""
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - 2) for n in (3, 4, 5) if i + n <= len(padded)]


def text_pieces(numbered: DataFrame) -> DataFrame:
    """``t, gram, tf``: the pieces of each text's words and how often they occur. Texts are dealt out by
    number, and a text is counted where it lies: repeated words are cut once, and pieces are counted as
    numbers that a task gives them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        cut: dict[str, np.ndarray] = {}
        for batch in batches:
            ends = np.cumsum(pc.utf8_length(batch.column("canonical")).to_numpy(zero_copy_only=False)) // _CHARS_TOGETHER
            for some in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(ends)) + 1):
                if len(numbers) > _PIECES_KNOWN:
                    numbers, cut = {}, {}
                part = batch.slice(some[0] if len(some) else 0, len(some))
                ids, tf = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for text in part.column("canonical").to_pylist():
                    words = Counter(text.split(" "))
                    for word in [w for w in words if w not in cut]:
                        cut[word] = np.array([numbers.setdefault(p, len(numbers)) for p in _word_pieces(word)], np.int64)
                    pieces = [cut[w] for w in words]
                    every = np.concatenate(pieces)
                    times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(x) for x in pieces])
                    order = np.argsort(every)
                    every, times = every[order], times[order]
                    first = np.flatnonzero(np.diff(every, prepend=-1))
                    ids.append(every[first])
                    tf.append(np.add.reduceat(times, first) if len(first) else times)
                t = np.repeat(part.column("t").to_numpy(zero_copy_only=False), [len(x) for x in ids[1:]])
                grams = pa.array(list(numbers), pa.string()).take(pa.array(np.concatenate(ids)))
                rows = pa.table({"t": pa.array(t, pa.int64()), "gram": grams, "tf": np.concatenate(tf)})
                yield from rows.to_batches()

    return numbered.select("t", "canonical").repartition("t").mapInArrow(counted, "t bigint, gram string, tf bigint")


def char_tfidf(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(vocabulary, weights)`` of character pieces fitted on all distinct texts.

    The vocabulary has ``gram, df, idf`` and ``g``, a number growing with frequency; the weights
    are ``t, g, raw``. Pieces are counted per text where it lies, and one piece's frequency is
    combined map-side.
    """
    counts = written(text_pieces(numbered), "grams")
    total = numbered.agg(F.count("*").alias("_texts"))
    df = counts.groupBy("gram").agg(F.count("*").alias("df"))
    idf = F.log((1 + F.col("_texts")) / (1 + F.col("df"))) + 1
    vocabulary = written(
        global_rank(df, [F.col("df"), F.col("gram")], "g")
        .crossJoin(F.broadcast(total))  # one row
        .withColumn("idf", idf)
        .drop("_texts"),
        "vocabulary",
    )
    raw = counts.join(vocabulary.select("gram", "g", "idf"), "gram").select(
        "t", "g", (F.col("tf") * F.col("idf")).alias("raw")
    )
    return vocabulary, raw


def _vectors(raw: DataFrame) -> DataFrame:
    """One row per text: its pieces from the rarest up and their unit-length weights. The size of
    a row is that of its text."""
    gathered = raw.groupBy("t").agg(
        F.sort_array(F.collect_list(F.struct("g", "raw"))).alias("_v"),
        F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("_norm"),
    )
    return gathered.select(
        "t",
        F.col("_v.g").alias("g"),
        F.transform("_v.raw", lambda w: w / F.col("_norm")).alias("w"),
    )


def _token_sets(numbered: DataFrame, common: Sequence[str]) -> DataFrame:
    """Content words of each text as numbers growing with frequency: ``t, k`` (sorted)."""
    rows = text_words(numbered).select("t", F.col("word").alias("token"))
    if common:
        rows = rows.where(~F.col("token").isin(*common))
    rows = written(rows, "words")
    frequency = rows.groupBy("token").agg(F.count("*").alias("df"))
    numbers = written(global_rank(frequency, [F.col("df"), F.col("token")], "k").select("token", "k"), "tokens")
    return rows.join(numbers, "token").groupBy("t").agg(F.sort_array(F.collect_list("k")).alias("k"))


def _rounded_up(values: np.ndarray) -> np.ndarray:
    """Two-byte floats that are no smaller."""
    near = values.astype(np.float16)
    return np.where(near < values, np.nextafter(near, np.float16(np.inf)), near)


def piece_summary(pieces: int) -> Callable[[Column, Column], Column]:
    """A short summary of a vector, 4 bytes per slot it uses: the weights of the ``_HEAD`` most frequent
    of all ``pieces``, and the lengths of the rest of the vector in ``_BUCKETS`` parts that share its pieces
    out by number. Slot by slot, products of two summaries add up to no less than the vectors' product
    (Cauchy-Schwarz in every part)."""
    head, buckets = _HEAD, _BUCKETS
    rare = max(0, pieces - head)

    @F.pandas_udf("binary")
    def summary(g: pd.Series, w: pd.Series) -> pd.Series:
        def one(ids, weights):
            part = head + ids * 2_654_435_761 % (1 << 32) % buckets
            slot = np.where(ids > rare, ids - rare - 1, part)
            total = np.bincount(slot, np.square(weights), minlength=head + buckets)
            used = np.flatnonzero(total)
            return used.astype("<u2").tobytes() + _rounded_up(np.sqrt(total[used])).astype("<f2").tobytes()

        return pd.Series([one(np.asarray(i, np.int64), np.asarray(v)) for i, v in zip(g, w)], dtype=object)

    return summary


@F.pandas_udf(BinaryType())
def word_bits(k: pd.Series) -> pd.Series:
    """A parity bitmap of a word set: two sets differ in at least as many words as their bitmaps in bits."""

    def one(ids):
        odd = np.bincount(np.asarray(ids, np.int64) * 2_654_435_761 % (1 << 32) >> 22, minlength=1 << 10) & 1
        return np.packbits(odd.astype(np.uint8)).tobytes()

    return k.map(one)


def text_features(
    numbered: DataFrame, common: Sequence[str] = config.COMMON_TOKENS, fitted: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """``t, fingerprint, g, w, k``: weighted pieces and content words of every distinct text, and short
    summaries of both (``pieces``, ``words``), written once. ``fitted`` is what ``char_tfidf`` gave for these texts."""
    vocabulary, raw = fitted or char_tfidf(numbered)
    vectors, tokens = _vectors(raw), _token_sets(numbered, common)
    empty = F.array().cast("array<bigint>")
    names = numbered.select("t", F.substring("digest", 1, 16).alias("fingerprint"))
    both = names.join(vectors, "t").join(tokens, "t", "left").withColumn("k", F.coalesce("k", empty))
    summary = piece_summary(vocabulary.count())
    return written(both.withColumns({"pieces": summary("g", "w"), "words": word_bits("k")}), "features")


_HEAD = 2_048  # pieces whose weights a summary holds one by one
_BUCKETS = 2_048  # parts of the others
_HALF = 0.5 * 10**-config.SCORE_DECIMALS  # scores are rounded before they meet a threshold
_BITS = 64  # texts behind one bit mask
_MASKS = 8  # masks per run of texts; a task compares two runs
_HOT_RUNS = 256  # postings joined together before a feature is split
_SUMMARY_TILE, _VECTOR_TILE = 16, 6  # runs a side whose summaries, or vectors, a task holds at most
_TILES_PER_CORE = 2


def _runs(scoped: DataFrame) -> DataFrame:
    """``scope, t, run, mask, bit``: the texts of a scope dealt in order into runs of 512."""
    ranked = global_rank(scoped.select("scope", "t").distinct(), [F.col("scope"), F.col("t")], "_rank")
    first = ranked.groupBy("scope").agg(F.min("_rank").alias("_first"))
    place = F.col("_rank") - F.col("_first")
    return written(
        ranked.join(first, "scope").select(
            "scope",
            "t",
            F.floor(place / (_BITS * _MASKS)).cast("bigint").alias("run"),
            F.floor(place % (_BITS * _MASKS) / _BITS).cast("int").alias("mask"),
            (place % _BITS).cast("int").alias("bit"),
        ),
        "runs",
    )


def _prefixes(features: DataFrame, character_min: float, use_tokens: bool) -> DataFrame:
    """``t, prefix``: the pieces and words a text must share with any partner it can match.

    Pieces: from the rarest up until the rest is too short a vector to reach the threshold alone
    (prefix filtering for cosine). Words: all but enough for the required overlap. Words get
    negative numbers.
    """
    floor = character_min - _HALF - 1e-9

    @F.pandas_udf("int")
    def needed(weights: pd.Series) -> pd.Series:
        def length(w):
            rest = np.sqrt(np.maximum(0.0, 1.0 - np.cumsum(np.square(w)) + 1e-12))
            return int(np.argmax(rest < floor)) + 1 if len(w) else 0

        return weights.map(length)

    lists = [F.slice("g", 1, needed("w"))]
    if use_tokens:
        size = F.size("k")
        overlap = F.ceil(size * (config.TOKEN_JACCARD_MIN - _HALF - 1e-9))
        prefix = F.slice("k", 1, F.greatest(F.lit(0), size - overlap + 1).cast("int"))
        lists.append(F.transform(F.when(size >= config.TOKEN_SHARED_MIN, prefix), lambda k: -k))
    empty = F.array().cast("array<bigint>")
    return features.select("t", F.concat(*[F.coalesce(x, empty) for x in lists]).alias("prefix"))


def _mask_columns(side: str = "") -> list[str]:
    return [f"mask{side}{i}" for i in range(_MASKS)]


def _candidate_runs(runs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs of runs with a shared prefix feature, and bit masks of the texts concerned.

    An inverted index over runs instead of texts: one row per (scope, feature, run), so a feature
    of many texts costs few joined rows. A feature in very many runs is split: its rows are dealt
    over several keys on one side and repeated on the other.
    """
    keys, masks = ["scope", "feature"], _mask_columns()
    bit = F.expr("shiftleft(cast(1 as bigint), bit)")
    # A run's prefixes travel together once, as lists; its postings are made where they arrive.
    together = runs.join(prefixes, "t").repartition("scope", "run")
    postings = written(
        together.select("scope", "run", "mask", bit.alias("_bit"), F.explode("prefix").alias("feature"))
        .groupBy("scope", "run", "feature")
        .agg(*[F.coalesce(F.bit_or(F.when(F.col("mask") == i, F.col("_bit"))), F.lit(0).cast("bigint")).alias(m) for i, m in enumerate(masks)]),
        "postings",
    )
    texts = sum((F.bit_count(m) for m in masks[1:]), F.bit_count(masks[0]))
    spread = (
        postings.groupBy(*keys)
        .agg(F.count("*").alias("_runs"), F.sum(texts).alias("_texts"))
        .where(F.col("_texts") > 1)
        .select(*keys, F.ceil(F.col("_runs") / _HOT_RUNS).cast("int").alias("_parts"))
    )
    useful = postings.join(spread, keys).withColumn("_several", texts > 1)
    one, other = F.pmod(F.col("run"), F.col("_parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    left, right = (
        useful.select(
            *keys,
            part.alias("_part"),
            F.col("run").alias(f"run_{s}"),
            F.col("_several").alias(f"_several_{s}"),
            *[F.col(m).alias(m.replace("mask", f"mask_{s}_")) for m in masks],
        )
        for s, part in (("a", one), ("b", other))
    )
    met = left.join(right, [*keys, "_part"]).where(
        (F.col("run_a") < F.col("run_b")) | ((F.col("run_a") == F.col("run_b")) & F.col("_several_a"))
    )
    sides = [*_mask_columns("_a_"), *_mask_columns("_b_")]
    return met.groupBy("scope", "run_a", "run_b").agg(*[F.bit_or(m).alias(m) for m in sides])


def _tiled(pairs: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Pairs of runs dealt to tiles, squares of runs (``tile_a, tile_b``), and the number of tiles. A text
    is sent once to every tile it matters to and not once to every run it is compared with. A tile has
    at most ``most`` runs a side, which bounds what a task holds, and fewer while cores would be idle."""
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    side = max(1, min(most, math.isqrt(pairs.count() // (_TILES_PER_CORE * cores))))
    dealt = pairs.withColumns({f"tile_{s}": F.floor(F.col(f"run_{s}") / side).cast("bigint") for s in "ab"})
    return dealt, dealt.select("scope", "tile_a", "tile_b").distinct().count()


def _wanted(tiled: DataFrame, masks: Callable[[str], Column]) -> DataFrame:
    """The runs of each tile, one row per side and run, with the masks of the texts that matter."""
    keys = ["scope", "tile_a", "tile_b", "side", "run"]
    parts = [
        tiled.select("scope", "tile_a", "tile_b", F.lit(number).alias("side"), F.col(f"run_{s}").alias("run"), masks(s).alias("_masks"))
        for number, s in enumerate("ab")
    ]
    every = F.array(*[F.bit_or(F.col("_masks")[i]) for i in range(_MASKS)]).alias("_masks")
    return parts[0].unionByName(parts[1]).groupBy(*keys).agg(every)


def _sides(wanted: DataFrame, runs: DataFrame, columns: DataFrame) -> DataFrame:
    """The texts of ``wanted`` with their place in the run and ``columns`` (``t`` and others)."""
    chosen = F.expr("shiftright(_masks[mask], bit) & 1") == 1
    return (
        wanted.join(runs, ["scope", "run"])
        .where(chosen)
        .join(columns, "t")
        .select("scope", "tile_a", "tile_b", "side", "run", "t", (F.col("mask") * _BITS + F.col("bit")).alias("place"), *[c for c in columns.columns if c != "t"])
    )


def _per_tile(rows: DataFrame, tiles: int, fn, schema: str) -> DataFrame:
    """``fn`` over the rows of each tile: the texts of both sides (``side`` 0 and 1) and a row for each
    pair of runs (``side`` 2). It yields a frame per pair of runs."""
    keys = ["scope", "tile_a", "tile_b"]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    default = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Tasks are few and heavy on small inputs: a partition for each keeps every core busy.
    parts = max(default, min(tiles, 8 * cores))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile = pd.concat(list(batches), ignore_index=True)
        runs = [dict(list(tile[tile["side"] == n].groupby("run"))) for n in (0, 1)]
        pairs = tile[tile["side"] == 2].sort_values(["run_a", "run_b"])
        del tile
        for pair in pairs.itertuples(index=False):
            if pair.run_a in runs[0] and pair.run_b in runs[1]:
                yield fn(pair, runs[0][pair.run_a], runs[1][pair.run_b])

    return rows.repartition(parts, *keys).groupBy(*keys).applyInPandas(each, schema)


def _dense(summaries: Sequence[bytes], slots: int) -> np.ndarray:
    out = np.zeros((len(summaries), slots), np.float32)
    for row, raw in enumerate(summaries):
        used = len(raw) // 4
        out[row, np.frombuffer(raw, "<u2", used)] = np.frombuffer(raw, "<f2", used, 2 * used)
    return out


def bounded_pairs(runs: DataFrame, candidates: DataFrame, features: DataFrame, character_min: float, use_tokens: bool) -> DataFrame:
    """The pairs of texts that summaries leave, one row per pair of runs: how many were ``proposed`` and
    ``kept``, the kept ones as a bit matrix over places in the two runs, and masks of their texts.

    A summary is a fraction of its vector, so most pairs are ruled out before any vector is read. What
    is left out cannot reach a threshold: the cosine is at most the summaries' product, and two word
    sets share at most half of what remains of their sizes' sum after the bits they differ in.
    """
    slots, bits, masks = _HEAD + _BUCKETS, _BITS, _MASKS
    # The product is a sum of rounded-up values in single precision: 1e-4 covers its rounding.
    least = character_min - _HALF - 1e-4
    overlap = config.TOKEN_JACCARD_MIN - _HALF - 1e-9
    columns = ["pieces", *(["words", F.size("k").alias("words_n")] if use_tokens else [])]
    tiled, tiles = _tiled(candidates, _SUMMARY_TILE)
    own_masks = lambda s: F.array(*_mask_columns(f"_{s}_"))
    rows = _sides(_wanted(tiled, own_masks), runs, features.select("t", *columns))
    pairs = tiled.select(
        "scope", "tile_a", "tile_b", F.lit(2).alias("side"), "run_a", "run_b", *[own_masks(s).alias(f"masks_{s}") for s in "ab"]
    )

    def proposed(texts: pd.DataFrame, values: Sequence[int]) -> pd.DataFrame:
        """The texts of a run that this pair of runs is about."""
        chosen = np.array([int(v) >> b & 1 for v in values for b in range(bits)], bool)
        return texts[chosen[texts["place"].to_numpy(np.int64)]]

    def mask_list(used: np.ndarray) -> list[int]:
        values = [sum(1 << int(b) for b in np.flatnonzero(used[m * bits : (m + 1) * bits])) for m in range(masks)]
        return [v - (1 << 64) if v >> 63 else v for v in values]

    def bound(pair, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = proposed(a, pair.masks_a), proposed(b, pair.masks_b)
        both = a["t"].to_numpy()[:, None] < b["t"].to_numpy()[None, :]
        keep = _dense(list(a["pieces"]), slots) @ _dense(list(b["pieces"]), slots).T >= least
        if use_tokens:
            maps = [np.frombuffer(b"".join(x["words"]), np.uint64).reshape(len(x), -1) for x in (a, b)]
            total = a["words_n"].to_numpy()[:, None] + b["words_n"].to_numpy()[None, :]
            shared = np.empty(total.shape, np.int64)
            for k, own in enumerate(maps[0]):
                shared[k] = (total[k] - np.bitwise_count(own ^ maps[1]).sum(axis=1)) // 2
            keep |= (shared >= config.TOKEN_SHARED_MIN) & (shared >= overlap * (total - shared))
        keep &= both
        matrix = np.zeros((bits * masks, bits * masks), bool)
        matrix[np.ix_(a["place"].to_numpy(np.int64), b["place"].to_numpy(np.int64))] = keep
        return pd.DataFrame(
            {
                "scope": [pair.scope], "run_a": [int(pair.run_a)], "run_b": [int(pair.run_b)],
                "proposed": [int(both.sum())], "kept": [int(keep.sum())],
                "masks_a": [mask_list(matrix.any(axis=1))], "masks_b": [mask_list(matrix.any(axis=0))],
                "matrix": [np.packbits(matrix).tobytes()],
            }
        )

    schema = "scope string, run_a bigint, run_b bigint, proposed bigint, kept bigint, masks_a array<bigint>, masks_b array<bigint>, matrix binary"
    return written(_per_tile(rows.unionByName(pairs, allowMissingColumns=True), tiles, bound, schema), "bounded")


class _Rows:
    """Sparse rows over the columns of one side, multiplied with single rows of the other."""

    def __init__(self, ids: Sequence[np.ndarray], values: Sequence[np.ndarray], columns: np.ndarray):
        self.columns = columns
        every = np.concatenate([*ids, np.zeros(0, np.int64)])
        at = np.searchsorted(columns, every)
        # The last column is no one's: pieces that the other side lacks fall there.
        known = columns[np.minimum(at, len(columns) - 1)] == every if len(columns) else np.zeros(len(every), bool)
        ends = np.cumsum([len(i) for i in ids])[:-1]
        self.at = np.split(np.where(known, at, len(columns)), ends)
        self.values = values

    def products(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """``x`` (dense over the columns and a last 0) with some of the rows."""
        sizes = np.array([len(self.at[r]) for r in rows])
        some = rows[sizes > 0]
        out = np.zeros(len(rows))
        if len(some):
            terms = x[np.concatenate([self.at[r] for r in some])] * np.concatenate([self.values[r] for r in some])
            out[sizes > 0] = np.add.reduceat(terms, np.cumsum(sizes[sizes > 0]) - sizes[sizes > 0])
        return out


_PAIR_SCHEMA = (
    "scope string, a bigint, b bigint, fingerprint_a string, fingerprint_b string, "
    "cosine double, jaccard double, by_character boolean, by_token boolean"
)


def similar_pairs(
    scoped: DataFrame, features: DataFrame, character_min: float, use_tokens: bool, span: Sequence[str] = ()
) -> DataFrame:
    """Every pair of texts of a scope that clears the character threshold or, with
    ``use_tokens``, the word-overlap threshold. ``scoped`` has ``scope, t``; ``a`` sorts first. With
    ``span``, the names of a first and a last value of each text in ``scoped``, the two texts
    must have two different values between them.

    Prefix filtering proposes texts, summaries rule out most pairs of these, and each task then
    receives what is left of two tiles of a few runs of 512 texts, whatever the size of the scope, and
    scores exactly the pairs that are left. Fingerprints travel with the texts, so that found pairs
    are not joined with anything again.
    """
    runs = _runs(scoped)
    candidates = written(_candidate_runs(runs, _prefixes(features, character_min, use_tokens)), "candidates")
    bounded = bounded_pairs(runs, candidates, features, character_min, use_tokens).where("kept > 0")
    tiled, tiles = _tiled(bounded, _VECTOR_TILE)
    texts = _sides(_wanted(tiled, lambda s: F.col(f"masks_{s}")), runs, features.select("t", "fingerprint", "g", "w", "k"))
    if span:
        values = scoped.select("scope", "t", *[F.col(c).alias(f"span_{n}") for n, c in enumerate(span)])
        texts = texts.join(values, ["scope", "t"])
    matrices = tiled.select("scope", "tile_a", "tile_b", F.lit(2).alias("side"), "run_a", "run_b", "matrix")
    places = _BITS * _MASKS

    def compare(pair, *sides: pd.DataFrame) -> pd.DataFrame:
        matrix = np.unpackbits(np.frombuffer(pair.matrix, np.uint8), count=places * places).reshape(places, places)
        t, place = ([x[c].to_numpy(np.int64) for x in sides] for c in ("t", "place"))
        wanted = matrix[np.ix_(*place)].astype(bool)
        g, w, k = ([[np.asarray(v) for v in x[c]] for x in sides] for c in "gwk")
        ones = [[np.ones(len(v)) for v in side] for side in k]
        scores = []
        for ids, values in ((g, w), (k, ones)):
            columns = np.unique(np.concatenate([*ids[0], np.zeros(0, np.int64)]))
            own, other = (_Rows(ids[n], values[n], columns) for n in (0, 1))
            x, found = np.zeros(len(columns) + 1), []
            for row, partners in enumerate(wanted):
                x[own.at[row]] = values[0][row]
                found.append(other.products(x, np.flatnonzero(partners)))
                x[own.at[row]] = 0.0
            scores.append(np.concatenate([*found, np.zeros(0)]))
        i, j = np.nonzero(wanted)
        cosine, shared = np.round(scores[0], config.SCORE_DECIMALS), scores[1]
        size = [np.array([len(v) for v in side], np.int64) for side in k]
        union = size[0][i] + size[1][j] - shared
        jaccard = np.round(np.divide(shared, union, out=np.zeros_like(shared), where=union > 0), config.SCORE_DECIMALS)
        by_character = cosine >= character_min
        by_token = (shared >= config.TOKEN_SHARED_MIN) & (jaccard >= config.TOKEN_JACCARD_MIN) & use_tokens
        hit = by_character | by_token
        if span:
            # Numbered alike on both sides, nulls as none: least and greatest pass over them.
            names = [x[f"span_{n}"].to_numpy(object) for x in sides for n in (0, 1)]
            codes = pd.factorize(np.concatenate(names), sort=False)[0].astype(float)
            codes[codes < 0] = np.nan
            first_a, last_a, first_b, last_b = np.split(codes, np.cumsum([len(x) for x in names])[:-1])
            low = np.fmin(np.fmin(first_a, last_a)[i], np.fmin(first_b, last_b)[j])
            high = np.fmax(np.fmax(first_a, last_a)[i], np.fmax(first_b, last_b)[j])
            hit &= low < high
        mark = [x["fingerprint"].to_numpy(object) for x in sides]
        return pd.DataFrame(
            {
                "scope": pair.scope,
                "a": t[0][i[hit]],
                "b": t[1][j[hit]],
                "fingerprint_a": mark[0][i[hit]],
                "fingerprint_b": mark[1][j[hit]],
                "cosine": cosine[hit],
                # Reported as a plain rounded ratio; the threshold saw the array rounding.
                "jaccard": [round(s / u, config.SCORE_DECIMALS) if u else 0.0 for s, u in zip(shared[hit].tolist(), union[hit].tolist())],
                "by_character": by_character[hit],
                "by_token": by_token[hit],
            }
        )

    return _per_tile(texts.unionByName(matrices, allowMissingColumns=True), tiles, compare, _PAIR_SCHEMA)


def _hits() -> Column:
    return F.array_compact(
        F.array(F.when(F.col("by_character"), F.lit("character")), F.when(F.col("by_token"), F.lit("token")))
    )


def _candidates(pairs: DataFrame, finder: str) -> DataFrame:
    """A candidate id for every pair."""
    return pairs.select(
        candidate_id(F.lit(finder), F.col("scope"), F.col("fingerprint_a"), F.col("fingerprint_b")).alias(
            "candidate_id"
        ),
        F.lit(finder).alias("finder"),
        "scope",
        "a",
        "b",
        "fingerprint_a",
        "fingerprint_b",
        F.col("cosine").alias("character_similarity"),
        F.col("jaccard").alias("token_overlap"),
        _hits().alias("hits"),
    )


def scoped_texts(texts: DataFrame, numbered: DataFrame, kind: str) -> DataFrame:
    """``scope, t`` and the first and last constituency of each group of one scope kind."""
    groups = text_groups(texts).where(F.col("scope_kind") == kind)
    return groups.join(numbered.select("digest", "t"), "digest").select(
        "scope", "t", "constituency_first", "constituency_last"
    )


def near_copy_pairs(texts: DataFrame, numbered: DataFrame, features: DataFrame) -> DataFrame:
    """Pairs of different texts in one constituency, by characters or by words."""
    scoped = scoped_texts(texts, numbered, "constituency")
    pairs = similar_pairs(scoped, features, config.CHARACTER_MIN, use_tokens=True)
    return _candidates(pairs, "near_copy")


def district_near_copy_pairs(texts: DataFrame, numbered: DataFrame, features: DataFrame) -> DataFrame:
    """Pairs under one authority, by characters only, together in two or more constituencies."""
    scoped = written(scoped_texts(texts, numbered, "authority"), "scoped")
    pairs = similar_pairs(
        scoped, features, config.DISTRICT_CHARACTER_MIN, use_tokens=False, span=("constituency_first", "constituency_last")
    )
    return _candidates(pairs, "district_near_copy")


_PAIRS_TOGETHER = 20_000  # pairs of a scope in one task, about
_WORDS_TOGETHER = 2_000_000  # words read for one batch of differences


def pair_difference(
    pairs: DataFrame, numbered: DataFrame, common: Sequence[str] = config.COMMON_TOKENS, lists: bool = True
) -> DataFrame:
    """Words both sides share, words only one has, and the class that follows. ``token_overlap``
    comes with the pair. Without ``lists``, only the class, as to count it.

    The pairs of a scope are dealt to squares by the hashes of their sides. A text's words are cut once,
    and sent once to every square that has a pair of it, not once for every pair.
    """
    most = pairs.groupBy("scope").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, math.ceil(math.sqrt(most / _PAIRS_TOGETHER)))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int").alias(f"_part_{c}")
    square = ["scope", "_part_a", "_part_b"]
    dealt = pairs.where("a is not null and b is not null").select("*", part("a"), part("b"))
    needed = dealt.select(*square, F.col("a").alias("_t")).unionByName(dealt.select(*square, F.col("b").alias("_t"))).distinct()
    words = numbered.select(F.col("t").alias("_t"), content_tokens(F.col("canonical"), common).alias("_tokens"))
    rows = dealt.unionByName(needed.join(words, "_t"), allowMissingColumns=True)
    names, kept = ("shared_tokens", "only_a_tokens", "only_b_tokens"), pairs.columns

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        texts = table.filter(table["_t"].is_valid()).select(["_t", "_tokens"]).combine_chunks()
        met = table.filter(table["_t"].is_null()).select([*kept])
        if not len(texts) or not len(met):
            return
        tokens = pa.concat_arrays(texts["_tokens"].chunks)
        known = pa.concat_arrays([tokens.flatten()]).dictionary_encode()
        ends = np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
        own = np.split(known.indices.to_numpy(zero_copy_only=False), ends[:-1])
        order = np.argsort(texts["_t"].to_numpy())
        numbers = texts["_t"].to_numpy()[order]
        found, sides = np.ones(len(met), bool), []
        for side in "ab":
            wanted = met[side].to_numpy()
            at = np.minimum(np.searchsorted(numbers, wanted), len(numbers) - 1)
            found &= numbers[at] == wanted
            sides.append(order[at])
        met, (i, j) = met.filter(pa.array(found)), (side[found] for side in sides)
        size, mark = np.array([len(x) for x in own]), np.zeros(len(known.dictionary), bool)
        batch = np.cumsum(size[i] + size[j]) // _WORDS_TOGETHER
        for some in np.split(np.arange(len(i)), np.flatnonzero(np.diff(batch)) + 1):
            parts = [[], [], []]
            for a, b in zip(i[some], j[some]):
                mark[own[a]] = True
                of_b = mark[own[b]]
                mark[own[a]] = False
                mark[own[b]] = True
                of_a = mark[own[a]]
                mark[own[b]] = False
                for part, ids in zip(parts, (own[a][of_a], own[a][~of_a], own[b][~of_b])):
                    part.append(ids)
            counts = [np.array([len(x) for x in part], np.int64) for part in parts]
            more = (counts[1] > 0).astype(int) + (counts[2] > 0)
            kinds = pa.array(["reworded_match", "one_sided_detail", "conflicting_detail"]).take(pa.array(more))
            out = {c: met[c].take(pa.array(some)).combine_chunks() for c in kept}
            if lists:
                for name, part, count in zip(names, parts, counts):
                    ids = np.concatenate([*part, np.zeros(0, np.int32)]).astype(np.int32)
                    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                    out[name] = pa.ListArray.from_arrays(pa.array(offsets), known.dictionary.take(pa.array(ids)))
            out["difference_group"] = kinds
            yield from pa.table(out).to_batches()

    made = [StructField(n, ArrayType(StringType())) for n in names if lists] + [StructField("difference_group", StringType())]
    return rows.groupBy(*square).applyInArrow(differences, StructType([*pairs.schema.fields, *made]))


def duplicate_counts(
    texts: DataFrame, batches: DataFrame, near: DataFrame, district_near: DataFrame
) -> DataFrame:
    """One row of figures over all finders; ``near`` carries ``difference_group``."""
    finder = F.col("finder")
    considered = texts.agg(F.count("*").alias("works_considered"))
    batch_counts = batches.agg(
        F.count_if(finder == "identical_batch").alias("identical_batches"),
        F.count_if((finder == "identical_batch") & F.col("threshold_crossing_batch")).alias(
            "threshold_crossing_batches"
        ),
        F.count_if(finder == "district_identical_batch").alias("district_identical_batches"),
    )
    kind = F.col("difference_group")
    pair_counts = near.agg(
        F.count("*").alias("near_copy_pairs"),
        *[F.count_if(kind == k).alias(k) for k in ("reworded_match", "one_sided_detail", "conflicting_detail")],
    )
    district_counts = district_near.agg(F.count("*").alias("district_near_copy_pairs"))
    groups = referenced_groups(batches, near, district_near).agg(F.count("*").alias("groups"))
    out = considered
    for part in (groups, batch_counts, pair_counts, district_counts):
        out = out.crossJoin(F.broadcast(part))  # single rows
    return out


def referenced_groups(batches: DataFrame, near: DataFrame, district_near: DataFrame) -> DataFrame:
    """Distinct (scope kind, scope, fingerprint) that a batch or pair points at."""
    by_district = F.col("finder").startswith("district")
    kind = F.when(by_district, "authority").otherwise("constituency").alias("scope_kind")
    rows = batches.select(kind, "scope", "fingerprint")
    for pairs in (near, district_near):
        # Both sides from one pass: the pairs need not be stored.
        sides = F.explode(F.array("fingerprint_a", "fingerprint_b")).alias("fingerprint")
        rows = rows.unionByName(pairs.select(kind, "scope", sides))
    return rows.distinct()


def duplicate_integrity(groups: DataFrame, referenced: DataFrame) -> DataFrame:
    """Problems as rows: references to no group, groups nothing refers to, and one (scope,
    fingerprint) standing for two different sets of works."""
    keys = ["scope_kind", "scope", "fingerprint"]
    problem = lambda df, name: df.select(F.lit(name).alias("problem"), "scope", "fingerprint")
    unresolved = problem(referenced.join(groups, keys, "left_anti"), "unresolved_reference")
    unused = problem(groups.join(referenced, keys, "left_anti"), "unreferenced_group")
    clash = (
        groups.groupBy("scope", "fingerprint")
        .agg(F.countDistinct("members").alias("_sets"))
        .where(F.col("_sets") > 1)
    )
    return unresolved.unionByName(unused).unionByName(problem(clash, "ambiguous_group_id"))


def group_members(texts: DataFrame) -> DataFrame:
    """``scope_kind, scope, fingerprint, members``: an order-free digest of each group's works."""
    parts = []
    for kind, column in SCOPES.items():
        rows = texts.where(F.length(column) > 0) if kind == "authority" else texts
        parts.append(
            rows.groupBy(F.lit(kind).alias("scope_kind"), F.col(column).alias("scope"), "fingerprint").agg(
                F.concat_ws(
                    ":", F.count("*"), F.sum(F.xxhash64("work_id").cast("decimal(38,0)"))
                ).alias("members")
            )
        )
    return parts[0].unionByName(parts[1])
