"""Quality rules: a table of thresholds compiled into one projection over measures of each text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WHITE = " \t\n\x0b\x0c\r"  # words are what stands between: [^\x20\x09-\x0D]+
SYMBOLS = "#*$%&|<>"
# Common words of the corpus languages (English, German, French, Spanish), lower case.
STOP_WORDS = (
    "the of and to in a is that it for was on are with as be at by this have from or an "
    "der die das und in zu den ist von mit auf für nicht ein eine im dem des sich als "
    "le la les de des et un une est en que qui dans pour sur pas au du par avec "
    "el los las y del se por con para su al lo como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails if ``measure / per`` is below ``least`` or above ``most``."""

    name: str
    measure: str
    per: str | None = None
    least: float | None = None
    most: float | None = None


BASE = (
    Rule("few_words", "n_words", least=50),
    Rule("repeated_words", "n_repeat_words", "n_words", most=0.5),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", least=2, most=15),
    Rule("symbols", "n_symbols", "n_words", most=0.5),
    Rule("stop_words", "n_stop_words", "n_words", least=0.01),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("word_variety", "n_words", "n_lines", least=2),
)


def failed(rules: tuple[Rule, ...]) -> Column:
    """Names of the rules a row of measures fails, as one expression. Without anything to divide
    by, a ratio is 0. Compared as products, so whole numbers are exact."""
    parts = []
    for rule in rules:
        value = F.col(rule.measure)
        per = F.col(rule.per) if rule.per else F.lit(1)
        bad = F.lit(False)
        if rule.least is not None:
            bad = bad | (value < per * rule.least) | ((per == 0) & F.lit(rule.least > 0))
        if rule.most is not None:
            bad = bad | (value > per * rule.most)
        parts.append(F.when(bad, F.lit(rule.name)))
    return F.array_compact(F.array(*parts))


def _repeat_words(n: Column, dup: Column) -> Column:
    """Words under the windows that start at the sorted places ``dup``, each counted once."""
    after = F.concat(F.slice(dup, 2, F.size(dup)), F.array(F.lit(None).cast("int")))
    width = F.zip_with(dup, after, lambda at, next_at: F.coalesce(F.least(F.lit(3), next_at - at), F.lit(3)))
    return F.when(F.size(dup) > 0, F.aggregate(width, F.lit(0), lambda x, y: x + y)).otherwise(0)


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id`` and, for every whole text (null: empty), the counts that rules compare.

    Each step is a plain projection; steps are separate so that an array used more than once is
    made once. Three-word windows are compared by 64-bit hashes, sorted with their places: equal
    windows are neighbours, so no window is compared with all others.
    """
    text = F.col("text")
    letters = F.translate(text, _WHITE, "")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        F.array_remove(F.split(F.translate("text", _WHITE, " " * len(_WHITE)), " "), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.translate(line, _WHITE, "") != "").alias("lines"),
        F.length(letters).cast("bigint").alias("word_chars"),
        (F.length(letters) - F.length(F.translate(letters, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )
    n, w = F.size("words"), F.col("words")
    window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
    sorted_windows = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window)))
    counted = base.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        n.cast("bigint").alias("n_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(sorted_windows, F.array().cast("array<struct<h:bigint,i:int>>")).alias("s"),
    )
    s = F.col("s")
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    before = F.concat(none, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))
    after = F.concat(F.slice(s, 2, F.size(s)), none)
    near = F.zip_with(before, after, lambda x, y: F.struct(x["h"].alias("x"), y["h"].alias("y")))
    hit = F.zip_with(s, near, lambda a, b: F.when((a["h"] == b["x"]) | (a["h"] == b["y"]), a["i"]))
    placed = counted.withColumn("dup", F.array_sort(F.array_compact(hit)))
    return placed.withColumn("n_repeat_words", _repeat_words(F.col("n_words"), F.col("dup")).cast("bigint")).drop("s", "dup")


def judge(docs: DataFrame, base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures of every row with ``base_failed``, ``kept`` and ``reasons`` (names of all rules
    it fails). A text without words fails ``few_words``. Rows are judged one by one: repeated rows
    alike, an empty table gives an empty one, and only ``doc_id`` and ``text`` are read. Store the
    result before filtering it: Spark moves a filter below projections and would compute the measures
    again for each place that it names."""
    out = measures(docs).select("*", failed(base).alias("_base"), failed(rules).alias("_more"))
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.size("_base") > 0).alias("base_failed"),
        ((F.size("_base") == 0) & (F.size("_more") == 0)).alias("kept"),
        "n_stop_words",
        "n_lines",
        F.concat("_base", "_more").alias("reasons"),
    )
