"""The works, payments, tiles and texts behind the registered queries, from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksift.plans.storage import spread, written

AS_OF = "2001-09-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("date")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as works, lines as payments. Lines are dealt out by order once, as narrow rows: they are
    summed per (order, supplier) and then per order where they lie, and the orders come to them.
    Names of places are put to the rows last, so that no shuffle carries them. Amounts are summed as whole
    numbers of their fourth decimal, in two parts that cannot overflow: decimals of that size are slow."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    paid = (price * (1 - F.col("l_discount").cast("decimal(4,2)")) * 10_000).cast("bigint")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_suppkey",
        paid.alias("paid"),
        (F.col("l_returnflag") != "R").alias("kept"),
        F.col("l_shipdate").cast("date").alias("shipped"),
    )
    settled = F.when(F.col("kept"), F.col("paid")).otherwise(F.lit(0).cast("bigint"))
    parts = {"gross": F.col("paid"), "settled": settled}
    high = {f"{n}_high": F.shiftright(c, 32) for n, c in parts.items()}
    low = {f"{n}_low": c.bitwiseAND(F.lit((1 << 32) - 1)) for n, c in parts.items()}
    sums = {**high, **low}
    by_vendor = (
        lines.where(F.col("l_orderkey").isNotNull())
        .repartition("l_orderkey")
        .groupBy("l_orderkey", "l_suppkey")
        .agg(
            F.count("*").alias("n"),
            *[F.sum(c).alias(n) for n, c in sums.items()],
            F.max("shipped").alias("last_activity"),
        )
    )
    whole = lambda n: F.sum(f"{n}_high").cast("decimal(20,0)") * (1 << 32) + F.sum(f"{n}_low")
    pay = by_vendor.groupBy("l_orderkey").agg(
        *[(whole(n) * F.lit("0.0001").cast("decimal(4,4)")).cast("decimal(38,4)").alias(n) for n in parts],
        F.max("last_activity").alias("last_activity"),
        F.min_by("l_suppkey", F.struct(-F.col("n"), F.col("l_suppkey"))).alias("l_suppkey"),
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    joined = (
        table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(pay, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    key = F.col("o_orderkey")
    agency = F.floor(F.pow((key % 997) / F.lit(997.0), F.lit(4.0)) * 400).cast("int")
    factor = F.when(key % 67 == 0, F.lit(2.5).cast("decimal(2,1)")).otherwise(F.lit(0.6).cast("decimal(2,1)"))
    ordered = F.col("o_orderdate").cast("date")
    status = (
        F.when(F.col("o_orderstatus") == "F", "Completed")
        .when(F.col("o_orderstatus") == "O", "In Progress")
        .otherwise("Sanctioned")
    )
    return joined.select(
        key.cast("string").alias("work_id"),
        F.col("r_name").alias("state"),
        F.col("n_name").alias("constituency"),
        F.concat(F.lit("MP-"), (F.col("o_custkey") % 100).cast("string")).alias("mp_name"),
        F.concat("n_name", F.lit("-DA-"), (F.col("o_custkey") % 4).cast("string")).alias(
            "implementing_district_authority"
        ),
        F.when(F.col("l_orderkey").isNotNull(), F.concat(F.lit("AG-"), agency.cast("string"))).alias(
            "implementing_agency"
        ),
        F.col("l_suppkey").cast("string").alias("vendor_id"),
        F.col("s_name").alias("vendor_name"),
        F.col("o_orderpriority").alias("work_category"),
        F.col("gross").cast("double").alias("sanctioned_amount_inr"),
        (F.col("settled") * factor).cast("double").alias("expenditure_amount_inr"),
        ordered.alias("sanction_date"),
        F.date_sub(ordered, (F.col("o_custkey") % 120).cast("int")).alias("recommendation_date"),
        status.alias("completion_status"),
        F.coalesce("last_activity", ordered).alias("last_updated"),
    )


def works_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with the columns the given tables lack filled by constants."""
    return works(spark, sf_dir).select(
        "*",
        F.lit("2024-2029").alias("tenure"),
        F.lit(None).cast("string").alias("work_description"),
        F.lit(None).cast("string").alias("activity_name"),
        F.lit(None).cast("string").alias("work_stage"),
        F.lit(None).cast("date").alias("completion_date"),
        F.lit(None).cast("boolean").alias("has_public_document"),
        F.lit(1).alias("source_rung"),
    )


def version(spark: SparkSession, sf_dir: str) -> int:
    """A number that changes with the tables of a folder: their names, sizes and times of change."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return hash(tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


_SNAPSHOTS: dict[tuple[str, str, int], DataFrame] = {}


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The works table, built once per application and state of the given tables, and then read like
    any stored snapshot."""
    key = (spark.sparkContext.applicationId, sf_dir, version(spark, sf_dir))
    if key not in _SNAPSHOTS:
        _SNAPSHOTS[key] = written(works_full(spark, sf_dir), "works")
    return _SNAPSHOTS[key]


def alias_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works whose vendor names are made ambiguous in both directions."""
    vid = F.col("vendor_id").cast("bigint")
    shared = F.when((vid % 5).isin(0, 2), F.concat(F.lit("V"), (vid % 7).cast("string"))).otherwise(F.col("vendor_name"))
    second = (vid % 5).isin(0, 1) & (F.col("work_id").cast("bigint") % 11 == 0)
    return snapshot(spark, sf_dir).withColumn(
        "vendor_name", F.when(second, F.concat(shared, F.lit(" & Co"))).otherwise(shared)
    )


def document_works(spark: SparkSession, sf_dir: str, constituency: str, authority: str) -> DataFrame:
    """Documents as described works: whole texts, with two of their columns as the scopes."""
    doc = F.col("doc_id")
    return spread(table(spark, sf_dir, "documents")).select(
        doc.cast("string").alias("work_id"),
        F.col(constituency).alias("constituency"),
        F.col(authority).alias("implementing_district_authority"),
        F.col("text").alias("work_description"),
        F.col("lang").alias("activity_name"),
        F.concat(F.lit("AG-"), (doc % 7).cast("string")).alias("implementing_agency"),
        F.when(doc % 3 == 0, "Completed").when(doc % 3 == 1, "In Progress").otherwise("Sanctioned").alias("completion_status"),
        (F.col("n_chars") * 1000.0).alias("sanctioned_amount_inr"),
        F.date_add(F.lit("2000-01-01").cast("date"), (doc % 700).cast("int")).alias("sanction_date"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as typed payment events."""
    brand = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_extendedprice"
    )
    return (
        spread(lines)
        .join(brand, F.col("l_partkey") == F.col("p_partkey"), "left")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .select(
            F.col("l_orderkey").cast("string").alias("work_id"),
            # Names are shared by suppliers, so name and id are picked in two steps.
            F.concat(F.lit("Vendor "), (F.col("l_suppkey") % 40).cast("string")).alias("vendor_name"),
            F.col("l_suppkey").cast("string").alias("vendor_id"),
            F.col("p_brand").alias("implementing_agency"),
            F.col("l_shipdate").cast("date").alias("paid_on"),
            (F.col("l_returnflag") != "R").alias("settled"),
            F.col("l_extendedprice").alias("amount_inr"),
        )
    )


def _documents(rows: DataFrame, label: str, entries) -> DataFrame:
    """Rows packed into double-encoded tile documents of at most 1,024 rows each. Only values are brought
    together: each row's keys are put to them where its document is made."""
    names = F.array(*[F.lit(name) for name, _ in entries])
    values = F.array(*[value for _, value in entries])
    keyed = lambda v: F.map_filter(F.map_from_arrays(names, v), lambda k, v: ~F.coalesce(v == "(absent)", F.lit(False)))
    summary = F.create_map(F.lit("Total_Amt"), F.lit("0"))
    return (
        rows.withColumn("_file", F.shiftright(F.monotonically_increasing_id(), 10))
        .groupBy("_file")
        .agg(F.collect_list(values).alias("values"))
        .select(F.array_append(F.transform("values", keyed), summary).alias("rows"))
        .select(F.to_json(F.create_map(F.lit(label), F.to_json("rows"))).alias("document"))
    )


def _entry(name: str, value) -> tuple[str, F.Column]:
    return name, (value if not isinstance(value, str) else F.col(value)).cast("string")


# Activities cycled over the orders, one per category rule plus two that only the fallback takes.
ACTIVITIES = (
    "Construction of roads with drainage",
    "Purchase of books for the school library",
    "Tube-well for drinking water",
    "Solar street light",
    "Community hall",
    "Ambulance for the hospital",
    "Public toilet block",
    "Flood control walls along roadsides",
    "Seed store",
)


def tile_documents(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three tiles as JSON documents built from orders and lines."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = (
        table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    ordered = F.col("o_orderdate").cast("date")
    portal = "d-MMM-yyyy"
    activity = F.element_at(F.array(*[F.lit(a) for a in ACTIVITIES]), (key % len(ACTIVITIES) + 1).cast("int"))
    recommended = F.date_format(F.date_sub(ordered, (cust % 120).cast("int")), portal)
    stage = (
        F.when(F.col("o_orderstatus") == "P", "Vendor Identification")
        .when(F.col("o_orderstatus") == "O", "Physical Inspection")
        .otherwise("Work Completed")
    )
    sanctioned = [
        _entry("WORK_RECOMMENDATION_DTL_ID", F.when(key % 997 != 5, key)),
        _entry("STATE_NAME", F.concat(F.lit("\t "), "r_name", F.lit("  "))),
        _entry("CONSTITUENCY", "n_name"),
        _entry("MP_NAME", F.concat(F.lit("MP   "), (cust % 100).cast("string"))),
        _entry("IDA_NAME", F.concat("n_name", F.lit("-DA-"), (cust % 4).cast("string"))),
        _entry(
            "ACTIVITY_NAME",
            F.when(key % 4 == 0, activity).otherwise(
                F.concat(F.lit("WS/\t MP620/2024-2025/"), key.cast("string"), F.lit("-"), activity)
            ),
        ),
        _entry("WORK_DESCRIPTION", F.when(key % 10 != 3, F.col("o_orderpriority")).otherwise(F.lit(" "))),
        _entry("RECOMMENDATION_DATE", F.when(cust % 50 == 7, F.lit("NA")).otherwise(recommended)),
        _entry("SANCTION_DATE", F.when(cust % 60 == 9, F.lit("-")).otherwise(F.date_format(ordered, "dd-MMM-yyyy"))),
        _entry("SANCTION_AMOUNT", F.when(key % 211 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))),
        _entry("WORK_STAGE", stage),
        _entry(
            "FILE_STATUS",
            F.when(key % 3 == 0, F.lit("(absent)")).when(key % 3 == 1, F.lit("Y")).otherwise(F.lit(None)),
        ),
        _entry("TENURE_START_DATE", F.lit("Jun 4, 2024 12:00:00 AM")),
        _entry("TENURE_END_DATE", F.when(key % 100 == 1, F.lit(None)).otherwise(F.lit("Jun 3, 2029 11:59:59 PM"))),
    ]
    completed = [
        _entry("WORK_RECOMMENDATION_DTL_ID", key),
        _entry("ACTUAL_END_DATE", F.date_format(F.date_add(ordered, 90), portal)),
    ]
    events = payments(spark, sf_dir)
    paid = [
        _entry("WORK_RECOMMENDATION_DTL_ID", "work_id"),
        _entry("VENDOR_NAME", "vendor_name"),
        _entry("VENDOR_ID", "vendor_id"),
        _entry("IA_NAME", "implementing_agency"),
        _entry("EXPENDITURE_DATE", F.date_format("paid_on", portal)),
        _entry("WORK_STATUS", F.when(F.col("settled"), "Payment Success").otherwise("Payment In-Progress")),
        _entry("FUND_DISBURSED_AMT", "amount_inr"),
    ]
    return {
        "sanctioned": _documents(orders, "Works Sanctioned", sanctioned),
        "completed": _documents(orders.where(F.col("o_orderstatus") == "F"), "Works Completed", completed),
        "payments": _documents(events, "Expenditure", paid),
    }
