"""Incremental counts: batches of reads as they arrive, each merged by its own count table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.operators.counts import MOST_COUNT, count_kmers


def append_counts(reads: DataFrame, k: int, table: str, checkpoint: str, by: tuple[str, ...] = ()) -> StreamingQuery:
    """Start a query that writes every micro-batch's counts under table, one folder a batch; a batch that runs again overwrites its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        count_kmers(batch, k, by, most=2**31 - 1).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def counts_so_far(spark, table: str, by: tuple[str, ...] = ()) -> DataFrame:
    return spark.read.parquet(table).groupBy(*by, "kmer").agg(F.least(F.sum("cnt"), F.lit(MOST_COUNT)).cast("bigint").alias("cnt"))
