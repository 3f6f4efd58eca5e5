"""Session settings that the engine is tuned for, scratch tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of slim rows that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Deletes the shuffle files of an execution when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(name: str = "strandloom", **conf) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str = "cut", by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder of spark.checkpoint.dir and read it back, which cuts the lineage of iterations. Where that is
    unset: a temporary folder in local mode, else an error. The table goes when the program ends, or by `drop`; shuffle files of the write go at once. by: columns by
    whose values the table is parted, so that `drop` can delete a part of it."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="cut-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(table: DataFrame, part: str = "") -> None:
    """Delete a table of cut, or the part of it in which a column of `by` has a value (column=value). Nothing that still reads it may be used later."""
    _remove(table.sparkSession, f"{table._cut_path}/{part}" if part else table._cut_path)


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a table of cut, if the session is still there."""
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended
        pass


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores by key, if its files give fewer partitions than that: exploding into k-mers is worth the move of the
    sequences. Large inputs have partitions enough and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < 2 * cores else df


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcasting if it has at most `most` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
