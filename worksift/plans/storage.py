"""Tables written to the cluster's shared folder to cut lineage and to be read more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else one under the warehouse, which a cluster
    shares. Where neither is set, the warehouse is a folder of this machine: that will do for a
    local session only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/checkpoints".rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """One folder per application, so that what a run has written can be removed after it."""
    return f"{shared_dir(spark)}/worksift-{spark.sparkContext.applicationId}"


def drop_run(spark: SparkSession) -> None:
    """Ends a run: deletes every table this application has written. Frames read from them are
    no longer usable after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Parquet looks at sizes after a hundred rows only, holds a page whole when it is compressed, and Spark a group of rows
# when it is read. Rows here may be a megabyte long: sizes are looked at from the first row on, and groups are small.
_SIZES = {"parquet.block.size": 16 << 20, "parquet.page.size": 1 << 20, "parquet.page.size.row.check.min": 1}


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    Reading it back survives lost executors without recomputing ``df``, keeps column pruning and
    filter pushdown, and gives the optimizer a real size, so a join broadcasts the table only
    when it is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**_SIZES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores when its input has fewer splits than there are cores, as with one
    small file; an input of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
