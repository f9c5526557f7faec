"""Benchmark decontamination by winnowing: the minimum k-gram of every window is a fingerprint.

Two texts that share a window of ``k + w - 1`` words share its fingerprint, so joining training and
test fingerprints misses no shared window. Hits are then extended: the windows around a hit are
compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksift.llm.common import packed, unpacked
from worksift.plans.storage import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# All ASCII but letters and digits; words are what stands between: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
_BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
WINDOW = 10  # words an item and a document must share
GRAM = 5  # words of a fingerprint; WINDOW - GRAM + 1 grams compete in a window
_MARK = "struct<h:bigint,i:int>"


def words(text: Column) -> Column:
    """Words in lower case. Characters are mapped and split on, which costs far less than collecting
    the matches of a regular expression."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN))
    return F.array_remove(F.split(spaced, " "), "")


def _least(x: Column, step: int, length: Column) -> Column:
    """Element by element, the smaller of ``x[j]`` and ``x[j + step]``, for the first ``length``."""
    left, right = F.slice(x, 1, length), F.slice(x, step + 1, length)
    return F.zip_with(left, right, lambda a, b: F.least(a, b))


def fingerprints(rows: DataFrame, w: str = "words") -> DataFrame:
    """``rows`` with ``marks``: (hash, place) of the fingerprints of each row's words, places rising.

    Of every window's grams the one with the least hash is kept, the first on a tie. Steps are
    separate projections so that each array is made once; the minimum over six grams is that over
    two, four and two more. Rows shorter than a window have none.
    """
    n = F.size(w)
    gram = lambda i: F.struct(F.xxhash64(*[F.get(F.col(w), i + j) for j in range(GRAM)]).alias("h"), i.alias("i"))
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - GRAM), gram))
    with_grams = rows.withColumn("_g", F.coalesce(grams, F.array().cast(f"array<{_MARK}>")))
    size = F.size("_g")
    pairs = with_grams.withColumn("_m2", _least(F.col("_g"), 1, F.greatest(size - 1, F.lit(0)))).drop("_g")
    size = F.size("_m2")
    fours = pairs.withColumn("_m4", _least(F.col("_m2"), 2, F.greatest(size - 2, F.lit(0))))
    six = F.greatest(F.size("_m2") - 4, F.lit(0))
    least = F.zip_with(F.slice("_m4", 1, six), F.slice("_m2", 5, six), lambda a, b: F.least(a, b))
    chosen = fours.withColumn("_m", least).drop("_m2", "_m4")
    # Places never fall from one window to the next, so repeats are neighbours.
    earlier = F.concat(F.array(F.lit(None).cast(_MARK)), F.slice("_m", 1, F.greatest(F.size("_m") - 1, F.lit(0))))
    fresh = F.zip_with("_m", earlier, lambda a, b: F.when(b.isNull() | (a["i"] != b["i"]), a))
    return chosen.withColumn("marks", F.array_compact(fresh)).drop("_m")


def _text(w: Column, at: Column, length: int) -> Column:
    return F.array_join(F.slice(w, at + 1, length), " ")


def _windows(rows: DataFrame, length: int, *keep: str) -> DataFrame:
    """Every run of ``length`` words of ``words`` as (at, window)."""
    places = F.when(F.size("words") >= length, F.sequence(F.lit(0), F.size("words") - length))
    at = rows.select(*keep, "words", F.explode(places).alias("at"))
    return at.select(*keep, "at", _text(F.col("words"), F.col("at"), length).alias("window"))


def item_windows(items: DataFrame) -> DataFrame:
    """``length, window, item_id`` of every window of every item, each once; an item shorter than a
    window is one window, an item without words none. Items without an id have windows too."""
    w = items.select("item_id", words(F.col("text")).alias("words"))
    n = F.size("words")
    length = F.least(n, F.lit(WINDOW))
    places = F.when(n > 0, F.sequence(F.lit(0), n - length))
    return (
        w.select("item_id", "words", length.alias("length"), F.explode(places).alias("at"))
        .select("length", F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ").alias("window"), "item_id")
        .distinct()
    )


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs``, and
    ``text_key``, a hash of its text.

    A document word is hit if it lies inside any occurrence of an item's window. An item without an
    id hits like any other, but is not listed among the items nor counted in ``n_items``. Null and empty
    texts have no words and no hits; an empty item table hits nothing. Repeated rows are judged
    alike, and rows that share an id but not a text each on their own. Only ``doc_id, text`` and
    ``item_id, text`` are read.

    Documents are scanned twice, once for fingerprints and once to extend the hits, because hits
    are few: carrying whole word lists through the fingerprint join would shuffle all text. A
    passage that many documents share is one row per occurrence on the left of every join and one
    row on the right.
    """
    windows = written(item_windows(items), "item-windows")
    item_words = windows.where(F.col("length") == WINDOW).select("window").distinct()
    marks = fingerprints(item_words.select(F.split("window", " ").alias("words"))).select(F.explode("marks").alias("m"))
    tests = written(marks.select(F.col("m.h").alias("h")).distinct(), "item-fingerprints")

    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), words(F.col("text")).alias("words"))
    own = fingerprints(base).select("doc_id", "text_key", F.explode_outer("marks").alias("m"))
    shared = (
        own.select("doc_id", "text_key", F.col("m.h").alias("h"), F.col("m.i").alias("i"))
        .join(tests, "h", "left_semi")
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        .agg(F.sort_array(F.collect_set("i")).alias("places"))
    )
    # Windows that can hold a shared fingerprint, with their words; all other rows keep a count only.
    reach = WINDOW - GRAM
    near = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p - reach, p))))
    inside = F.filter(near, lambda at: (at >= 0) & (at + WINDOW <= F.size("words")))
    spans = F.transform(inside, lambda at: F.struct(at.alias("at"), _text(F.col("words"), at, WINDOW).alias("window")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    found = written(
        base.join(written(shared, "shared-fingerprints"), same, "left").select(
            "doc_id", "text_key", F.size("words").cast("bigint").alias("n_words"), spans.alias("spans")
        ),
        "candidate-windows",
    )
    candidates = [
        found.where("spans is not null")
        .select("doc_id", "text_key", F.explode("spans").alias("s"))
        .select("doc_id", "text_key", F.col("s.at").alias("at"), F.col("s.window").alias("window"), F.lit(WINDOW).alias("length"))
    ]
    # Items below a window have no fingerprint that documents must select; their whole text is
    # compared with every run of as many words. There are at most nine such lengths.
    for row in windows.where(F.col("length") < WINDOW).select("length").distinct().collect():
        runs = _windows(base, row["length"], "doc_id", "text_key")
        candidates.append(runs.select("doc_id", "text_key", "at", "window", F.lit(row["length"]).alias("length")))
    hits = None
    for part in candidates:
        hits = part if hits is None else hits.unionByName(part)
    # Places first, items after: a window that many items share is one row per place, and a document
    # that holds it many times meets its items once.
    known = written(windows.select("length", "window").distinct(), "windows")
    hits = written(hits.join(known, ["length", "window"], "left_semi"), "hits")
    key = ["doc_id", "text_key"]
    hit_words = (
        hits.select(*key, "at", "length").distinct()
        .select(*key, F.explode(F.sequence("at", F.col("at") + F.col("length") - 1)).alias("word"))
        .distinct()
        .groupBy(*key)
        .agg(F.count("*").alias("n_hit"))
    )
    hit_items = (
        hits.select(*key, "length", "window").distinct().join(windows, ["length", "window"])
        .select(*key, "item_id").distinct().groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    )
    marked = hit_words.join(
        hit_items.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "items"), same
    ).select("n_hit", "items", "_id", "_key")
    none = F.array().cast("array<string>")
    return found.join(marked, same, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        "text_key",
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, with their columns, whatever these are called."""
    hit = contamination(docs, items).where("contaminated")
    hit = written(hit.select(F.col("doc_id").alias("_id"), "text_key").distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("text_key"))
    return unpacked(packed(docs).join(hit, same, "left_anti"), docs)
