import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from worksift.functions import categories, dates, money, sentences, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "raw",
    ["Road  at\tWARD-7", "Straße Größe", "ﬁve ﬃx", "① road", "सड़क निर्माण कार्य", "café café", "ǅ İstanbul", "´x", "…a–b", "ＡＢＣ", "", "!!"],
)
def test_canonical_text_equals_unicode_rule(spark, raw):
    folded = unicodedata.normalize("NFKC", raw).casefold()
    expected = regex.sub(r"[^\p{L}\p{N}\p{M}]+", " ", folded).strip()
    assert one(spark, text.canonical_text(F.col("x")), x=raw) == expected


def test_clean_text_and_activity(spark):
    assert one(spark, text.clean_text(F.col("x")), x="\t a \t b  c ") == "a b c"
    assert one(spark, text.clean_text(F.col("x")), x=" \t ") is None
    prefixed = "WS/\t MP620/2024-2025/133166-Roads, link roads\nand more"
    assert one(spark, text.activity_strip(F.col("x")), x=prefixed) == "Roads, link roads\nand more"
    assert one(spark, text.activity_strip(F.col("x")), x="Bare - text") == "Bare - text"


def test_content_tokens_and_fingerprint(spark):
    tokens = one(spark, text.content_tokens(F.col("x")), x="road to school 7 school in ward")
    assert tokens == ["7", "school", "ward"]
    assert len(one(spark, text.text_fingerprint(F.col("x")), x="road")) == 16


def test_slug_and_percent_encoding(spark):
    assert one(spark, text.slug(F.col("x")), x="  P.W.D. (Division) 7 ") == "p_w_d_division_7"
    assert one(spark, text.slug(F.col("x")), x="विभाग").startswith("%E0")
    assert one(spark, text.percent_encode(F.col("x")), x="a b*~/é") == "a%20b%2A~%2F%C3%A9"
    with pytest.raises(Exception, match="no stable id"):
        one(spark, text.slug(F.col("x")), x=" -- ")


@pytest.mark.parametrize(
    "raw,expected", [("09-Jul-2024", "2024-07-09"), ("9-Jul-2024", "2024-07-09"), ("NA", None), ("-", None), ("2024-07-09", None), ("", None)]
)
def test_portal_date(spark, raw, expected):
    got = one(spark, dates.portal_date(F.col("x")), x=raw)
    assert (str(got) if got else None) == expected


def test_financial_year_starts_in_april(spark):
    fy = lambda s, u: one(spark, dates.financial_year(F.col("s").cast("date"), F.col("u").cast("date")), s=s, u=u)
    assert fy("2024-03-31", None) == "2023-24"
    assert fy("2024-04-01", None) == "2024-25"
    assert fy(None, "1999-12-01") == "1999-00"
    assert fy(None, None) is None


def test_months_are_calendar_months(spark):
    months = dates.months_elapsed(F.col("a").cast("date"), F.col("b").cast("date"))
    assert one(spark, months, a="2024-01-31", b="2024-02-01") == 1
    assert one(spark, months, a="2024-05-01", b="2024-02-01") == 0
    assert one(spark, dates.tenure_range(F.col("a"), F.col("b")), a="Jun 4, 2024 12:00:00 AM", b="Jun 3, 2029 11:59 PM") == "2024-2029"


@pytest.mark.parametrize("n,expected", [(0, 0), (1, 1), (10, 1), (11, 2), (100, 10), (44810, 4481)])
def test_quota(spark, n, expected):
    df = spark.createDataFrame([(n,)], "n bigint")
    assert df.select(money.quota_for(F.col("n"))).first()[0] == expected


def test_amount_floor(spark):
    for raw, expected in (("12.5", 12.5), ("-3", 0.0), ("x", 0.0), (None, 0.0)):
        assert one(spark, money.amount_floor(F.col("x")), x=raw) == expected


@pytest.mark.parametrize(
    "activity,expected",
    [
        ("Construction of roads with or without drainage", "Road"),
        ("Vans for educational institutions on the road", "School"),
        ("Veterinary hospitals", "Health"),
        ("flood control embankments along roadsides", "Community Infrastructure"),
        ("Public toilet and drain", "Sanitation"),
        ("Tube-well", "Drinking Water"),
        ("Solar light", "Electricity"),
        ("Fish market", "Community Infrastructure"),
        (None, "Community Infrastructure"),
    ],
)
def test_category_order(spark, activity, expected):
    assert one(spark, categories.category_of(F.col("x")), x=activity) == expected


def test_sentences(spark):
    def say(variant, **values):
        names = {k: F.col(k) for k in sentences.MAX_LENGTH}
        row = {"category": "Road", **{k: 0.0 for k in names if k != "category"}, **values}
        return one(spark, sentences.sentence(F.lit(variant), names), **row)

    assert say("default", multiple=3.24) == "Cost is 3.2x the median for road works in this state."
    assert say("default", multiple=3.25) == "Cost is 3.2x the median for road works in this state."
    assert say("default", multiple=140.4, category="Drinking Water") == "Cost is 140x the median for drinking water works in this state."
    assert say("no_multiple", category="Community Infrastructure") == "Cost is above the usual range for community works here."
    assert say("part_spend", months=1234.0, percent_spent=2.5) == "Sanctioned 999 months ago, 2 percent spent."
    assert say("full_spend_open") == "Full amount spent, work still under implementation."
    assert say("districts_and_mps", district_count=4.0, mp_count=9.0) == "Agency holds works in 4 districts, 9 MPs."


def test_amounts_that_are_no_numbers_are_zero(spark):
    rows = spark.createDataFrame([("NaN",), ("Infinity",), ("-3",), ("2.5",), ("x",), (None,)], "v string")
    assert [r[0] for r in rows.select(money.amount_floor(F.col("v"))).collect()] == [0.0, 0.0, 0.0, 2.5, 0.0, 0.0]


def test_slug_strips_white_space_for_other_alphabets_only(spark):
    """a label is cleaned once; stripping it first is for labels without ASCII letters and digits."""
    plan = spark.createDataFrame([("a",)], "x string").select(text.slug(F.col("x")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert "^_+|_+$" not in plan and plan.count("(?U)") == 2
    for label in ("  A b\t ", "__A__b__", "A\nB", "İA", "-a-"):
        assert one(spark, text.slug(F.col("x")), x=label) == {"__A__b__": "a_b", "İA": "i_a", "-a-": "a"}.get(label, "a_b")
    assert one(spark, text.slug(F.col("x")), x=" विभाग ") == one(spark, text.slug(F.col("x")), x="विभाग")
    assert one(spark, text.slug(F.col("x")), x=None) is None


def test_folding_sends_texts_to_python_in_small_messages(spark):
    """no Arrow batch of ten thousand whole texts."""
    rows = spark.createDataFrame([("Ｆｕｌｌ ﬁne STRAßE",), (None,), ("Plain Ä",), ("İ ǅ",)], "x string").repartition(1)
    out = rows.select("x", text.canonical_text(F.col("x")).alias("c"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert {r.x: r.c for r in out.collect()} == {"Ｆｕｌｌ ﬁne STRAßE": "full fine strasse", None: None, "Plain Ä": "plain ä", "İ ǅ": "i̇ dž"}
