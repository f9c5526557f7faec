"""Inspection outcomes arriving as a stream, appended to the ledger batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from worksift.operators.ledger import outcome_accept


def append_outcomes(arrivals: DataFrame, works: DataFrame, ledger_path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that applies ``outcome_accept`` to every micro-batch.

    Accepted and refused rows are written to a partition named after the batch, and a batch that
    is replayed after a failure replaces its own partition and does not see it as history, so
    nothing is recorded twice.
    """
    spark = arrivals.sparkSession
    columns = ["outcome_id", "work_id", "inspected_on", "inspector_id", "supersedes"]

    def accept(batch: DataFrame, batch_id: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            # ``basePath`` keeps the partition column.
            recorded = spark.read.option("basePath", ledger_path).parquet(ledger_path)
            ledger = recorded.where(F.col("reason").isNull() & (F.col("batch") != batch_id)).select(*columns)
        else:
            ledger = batch.where(F.lit(False)).select(*columns)
        verdicts = outcome_accept(ledger, batch, works, F.current_date())
        verdicts.write.mode("overwrite").parquet(f"{ledger_path}/batch={batch_id}")

    return (
        arrivals.writeStream.foreachBatch(accept)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
