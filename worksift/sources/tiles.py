"""Source tiles: unwrapping, typing, payment roll-up and the join into one works table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worksift.functions.categories import category_of
from worksift.functions.dates import clean_blank, portal_date, portal_date_supplied, tenure_range
from worksift.functions.money import amount_floor
from worksift.functions.text import activity_strip, clean_text

# Stages before any ground work, the status of settled money, the share of
# unreadable dates above which a load is refused, values that count as "no document".
NOT_STARTED_STAGES = ("Sanction", "Vendor Identification", "Time Estimation")
SETTLED_STATUS = "Payment Success"
UNREADABLE_DATE_LIMIT = 0.01
NO_DOCUMENT_VALUES = ("", "false", "0", "0.0", "[]", "{}")

WORK_KEY = "WORK_RECOMMENDATION_DTL_ID"


def read_tile_documents(spark: SparkSession, path: str) -> DataFrame:
    """Tile files as ``document, file``. The format is one JSON document per file, so a file is one
    row and must fit in a task."""
    read = spark.read.text(path, wholetext=True)
    return read.select(F.col("value").alias("document"), F.col("_metadata.file_path").alias("file"))


def tile_unwrap(documents: DataFrame) -> DataFrame:
    """Rows of a tile as ``row map<string,string>``, so an absent key differs from a null, with their
    ``file`` (empty where the documents do not tell) and ``place`` in it: the input order.

    A document is a one-key object whose value is an array or a JSON string holding one, or the
    array itself. Summary rows (``Total_Amt``) are dropped; more than one key is an error.
    """
    # Generated columns are not merged into what reads them: a document is read once as an object
    # and once as rows.
    once = lambda c: F.explode(F.array(c))
    file = F.col("file") if "file" in documents.columns else F.lit("")
    opened = documents.select(file.alias("file"), F.trim(F.col("document")).alias("_raw"))
    opened = opened.select("file", "_raw", once(F.from_json("_raw", "map<string,string>")).alias("_wrapper"))
    keys = F.map_keys("_wrapper")
    wrong = F.raise_error(F.concat(F.lit("expected a single-key tile, got "), F.to_json(keys)))
    inner = (
        F.when(F.col("_raw").startswith("["), F.col("_raw"))
        .when(F.size(keys) == 1, F.map_values("_wrapper")[0])
        .otherwise(wrong.cast("string"))
    )
    read = opened.select("file", once(F.from_json(inner, "array<map<string,string>>")).alias("_rows"))
    not_rows = F.raise_error(F.lit("a tile does not hold a list of rows")).cast(
        "array<map<string,string>>"
    )
    listed = read.select("file", F.when(F.col("_rows").isNull(), not_rows).otherwise(F.col("_rows")).alias("rows"))
    unwrapped = listed.select("file", F.posexplode("rows").alias("place", "row"))
    return unwrapped.where(~F.map_contains_key("row", F.lit("Total_Amt")))


def _get(name: str) -> Column:
    return F.col("row").getItem(name)


def _public_document(name: str = "FILE_STATUS") -> Column:
    value = _get(name)
    return F.when(
        F.map_contains_key("row", F.lit(name)),
        F.coalesce(~F.lower(value).isin(*NO_DOCUMENT_VALUES), F.lit(False)),
    )


def parse_sanctioned(rows: DataFrame) -> DataFrame:
    """The sanctioned tile with typed columns, one row per work."""
    # Generated columns are not merged into what reads them: each of these is cleaned once.
    cleaned = F.struct(
        activity_strip(_get("ACTIVITY_NAME")).alias("activity"),
        clean_text(_get("TENURE_START_DATE")).alias("start"),
        clean_text(_get("TENURE_END_DATE")).alias("end"),
    )
    rows = rows.select("*", F.explode(F.array(cleaned)).alias("_cleaned"))
    activity = F.col("_cleaned.activity")
    return rows.select(
        _get(WORK_KEY).alias("work_id"),
        clean_text(_get("STATE_NAME")).alias("state"),
        clean_text(_get("CONSTITUENCY")).alias("constituency"),
        clean_text(_get("MP_NAME")).alias("mp_name"),
        tenure_range(F.col("_cleaned.start"), F.col("_cleaned.end")).alias("tenure"),
        clean_text(_get("IDA_NAME")).alias("implementing_district_authority"),
        category_of(activity).alias("work_category"),
        clean_text(_get("WORK_DESCRIPTION")).alias("work_description"),
        activity.alias("activity_name"),
        portal_date(_get("RECOMMENDATION_DATE")).alias("recommendation_date"),
        clean_text(_get("WORK_STAGE")).alias("work_stage"),
        _public_document().alias("has_public_document"),
        amount_floor(_get("SANCTION_AMOUNT")).alias("sanctioned_amount_inr"),
        portal_date(_get("SANCTION_DATE")).alias("sanction_date"),
        # Supplied but unreadable, for the quality counts.
        portal_date_supplied(_get("RECOMMENDATION_DATE")).alias("_recommendation_supplied"),
        portal_date_supplied(_get("SANCTION_DATE")).alias("_sanction_supplied"),
    )


def parse_completed(rows: DataFrame) -> DataFrame:
    return rows.select(
        _get(WORK_KEY).alias("work_id"),
        portal_date(_get("ACTUAL_END_DATE")).alias("completion_date"),
        F.struct("file", "place").alias("position"),
    )


def parse_payments(rows: DataFrame) -> DataFrame:
    return rows.select(
        _get(WORK_KEY).alias("work_id"),
        clean_text(_get("VENDOR_NAME")).alias("vendor_name"),
        clean_text(_get("VENDOR_ID")).alias("vendor_id"),
        clean_text(_get("IA_NAME")).alias("implementing_agency"),
        portal_date(_get("EXPENDITURE_DATE")).alias("paid_on"),
        (_get("WORK_STATUS") == SETTLED_STATUS).alias("settled"),
        amount_floor(_get("FUND_DISBURSED_AMT")).alias("amount_inr"),
    )


def tile_parse(tiles: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``sanctioned``, ``completed`` and ``payments`` row maps to typed tables."""
    parsers = {
        "sanctioned": parse_sanctioned,
        "completed": parse_completed,
        "payments": parse_payments,
    }
    return {name: parsers[name](rows) for name, rows in tiles.items()}


def payment_rollup(payments: DataFrame) -> DataFrame:
    """Per work: settled total, usual vendor and agency, the vendor id seen most with that
    vendor's name, and the latest payment date of any status.

    Payments are first counted per vendor name, id and agency of a work, as one row each, so a work with
    any number of payments reaches the one task that picks its winners as a few counted rows. Only
    there does a row become three: one for its (vendor, id), one for its agency, one for the
    totals. Ties go to the smallest value.
    """
    null = F.lit(None).cast("string")
    views = F.array(
        F.struct(F.lit("vendor").alias("kind"), F.col("vendor_name").alias("value"), F.col("vendor_id").alias("detail")),
        F.struct(F.lit("agency").alias("kind"), F.col("implementing_agency").alias("value"), null.alias("detail")),
        F.struct(F.lit("total").alias("kind"), null.alias("value"), null.alias("detail")),
    )
    total = F.col("view.kind") == "total"
    paid = F.when(F.col("settled"), F.col("amount_inr").cast("decimal(28,4)"))
    met = (
        payments.where(F.col("work_id").isNotNull())
        .groupBy("work_id", "vendor_name", "vendor_id", "implementing_agency")
        .agg(F.count("*").alias("n"), F.sum(paid).alias("paid"), F.max("paid_on").alias("last"))
        .repartition("work_id")
    )
    # From here all grouping is by work: no further shuffle.
    counted = (
        met.withColumn("view", F.explode(views))
        .select("work_id", "view.*", "n", F.when(total, F.col("paid")).alias("paid"), F.when(total, F.col("last")).alias("last"))
        .groupBy("work_id", "kind", "value", "detail")
        .agg(F.sum("n").alias("n"), F.sum("paid").alias("paid"), F.max("last").alias("last"))
    )
    detail_first = F.when(F.col("detail").isNotNull(), F.struct(-F.col("n"), F.col("detail")))
    by_value = counted.groupBy("work_id", "kind", "value").agg(
        F.sum("n").alias("n"),
        F.min_by("detail", detail_first).alias("detail"),
        F.max("paid").alias("paid"),
        F.max("last").alias("last"),
    )

    def usual(kind: str, column: str) -> Column:
        order = F.struct(-F.col("n"), F.col("value"))
        of_kind = (F.col("kind") == kind) & F.col("value").isNotNull()
        return F.min_by(column, F.when(of_kind, order))

    return by_value.groupBy("work_id").agg(
        F.coalesce(F.max("paid").cast("double"), F.lit(0.0)).alias("expenditure_amount_inr"),
        F.max("last").alias("last_activity"),
        usual("vendor", "value").alias("vendor_name"),
        usual("vendor", "detail").alias("vendor_id"),
        usual("agency", "value").alias("implementing_agency"),
    )


def completed_lookup(completed: DataFrame) -> DataFrame:
    """Work id to end date; the last row in input order wins."""
    return (
        completed.where(F.col("work_id").isNotNull())
        .groupBy("work_id")
        .agg(F.max_by(F.struct("completion_date"), "position").alias("_last"))
        .select("work_id", F.col("_last.completion_date").alias("completion_date"))
    )


def completion_status(is_completed: Column, stage: Column) -> Column:
    return (
        F.when(is_completed, "Completed")
        .when(stage.isin(*NOT_STARTED_STAGES), "Sanctioned")
        .otherwise("In Progress")
    )


def works_join(
    sanctioned: DataFrame, completed: DataFrame, payments: DataFrame, as_of: Column
) -> DataFrame:
    """Sanctioned works with their payments and completion; rows without a work id are left out
    (``source_quality_counts`` counts them)."""
    spine = sanctioned.where(F.col("work_id").isNotNull())
    done = completed_lookup(completed).withColumn("_done", F.lit(True))
    joined = spine.join(payment_rollup(payments), "work_id", "left").join(done, "work_id", "left")
    return joined.select(
        "work_id",
        "state",
        "constituency",
        "mp_name",
        "tenure",
        "implementing_district_authority",
        "implementing_agency",
        "vendor_id",
        "vendor_name",
        "work_category",
        "work_description",
        "activity_name",
        "recommendation_date",
        "work_stage",
        "completion_date",
        "has_public_document",
        "sanctioned_amount_inr",
        F.coalesce("expenditure_amount_inr", F.lit(0.0)).alias("expenditure_amount_inr"),
        "sanction_date",
        completion_status(F.col("_done"), F.col("work_stage")).alias("completion_status"),
        F.coalesce("last_activity", "sanction_date", as_of).alias("last_updated"),
    )


def source_quality_counts(
    sanctioned: DataFrame, completed: DataFrame, payments: DataFrame, *, refuse: bool = True
) -> DataFrame:
    """One row of input counts. With ``refuse``, over 1% unreadable dates is an error."""
    has_id = F.col("work_id").isNotNull()
    described = clean_blank(F.col("work_description")).isNotNull()
    unreadable = {
        name: F.col(f"_{name}_supplied") & F.col(f"{name}_date").isNull()
        for name in ("recommendation", "sanction")
    }
    counts = sanctioned.agg(
        F.count("*").alias("sanctioned_rows"),
        F.count_if(has_id).alias("records"),
        F.count_if(~has_id).alias("dropped_no_work_id"),
        F.count_if(has_id & described).alias("description_present"),
        F.count_if(has_id & ~described).alias("description_missing"),
        F.count_if(has_id & F.col("activity_name").isNotNull()).alias("activity_present"),
        F.count_if(has_id & F.col("activity_name").isNull()).alias("activity_missing"),
        F.count_if(has_id & F.col("recommendation_date").isNotNull()).alias(
            "recommendation_date_present"
        ),
        F.count_if(has_id & F.col("recommendation_date").isNull()).alias(
            "recommendation_date_missing"
        ),
        F.count_if(unreadable["recommendation"]).alias("recommendation_date_unparseable"),
        F.count_if(F.col("_recommendation_supplied")).alias("recommendation_date_supplied"),
        F.count_if(unreadable["sanction"]).alias("sanction_date_unparseable"),
        F.count_if(F.col("_sanction_supplied")).alias("sanction_date_supplied"),
    )
    # One-row sides.
    counts = counts.crossJoin(F.broadcast(completed.agg(F.count("*").alias("completed_rows"))))
    counts = counts.crossJoin(F.broadcast(payments.agg(F.count("*").alias("expenditure_rows"))))
    if not refuse:
        return counts
    for name in ("recommendation_date", "sanction_date"):
        bad, supplied = F.col(f"{name}_unparseable"), F.col(f"{name}_supplied")
        message = F.raise_error(
            F.format_string(f"%d of %d {name} values are unreadable", bad, supplied)
        ).cast("bigint")
        too_many = bad > supplied * UNREADABLE_DATE_LIMIT
        counts = counts.withColumn(f"{name}_unparseable", F.when(too_many, message).otherwise(bad))
    return counts
