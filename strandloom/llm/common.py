"""Helpers that the operators share: loading, scratch tables, words, size checks."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Largest number of slim rows (ids, hashes) that an operator may broadcast: about 100 MB.
BROADCAST_ROWS = 2_000_000
#: Rows of whole texts that go to a Python worker at once.
BATCH_ROWS = 500


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset: a temporary one in local mode, else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back: cuts the lineage, survives lost executors.

    batch_rows: rows of an Arrow batch in this job, for wide rows.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    spark.conf.set(key, str(batch_rows or usual))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, usual)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table, if the session is still there."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended
        pass


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have at most BATCH_ROWS rows: texts are wide, and a Python worker holds a batch whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcasting if it has no more than `most` rows, else df as it is (Spark then shuffles)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with as many underscores before it as no column of df has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    return [free_name(df, x) for x in wanted]


def id_type(docs: DataFrame) -> str:
    """Type that an operator carries the ids of docs in: long for whole numbers, else string."""
    return "long" if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long") else "string"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; a column used twice in a lambda would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], start: Column) -> Column:
    """Of each element the combination of start with all elements before it. Arrays grow in blocks of the square root of the
    length only, so an array of 100,000 elements takes seconds at most."""
    scan = lambda x, first: F.aggregate(x, F.array(first), lambda acc, y: F.concat(acc, F.array(combine(F.element_at(acc, -1), y))))

    def blocks(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1), lambda i: F.slice(v, i * width + 1, width))
        return let(cut, lambda c: F.flatten(F.zip_with(c, F.slice(scan(F.transform(c, lambda x: F.aggregate(x, start, combine)), start), F.lit(1), F.size(c)), lambda x, first: F.slice(scan(x, first), F.lit(1), F.size(x)))))

    return let(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(v))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of one byte a character take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bench_words(text: Column) -> Column:
    """Words of lower-cased letters, digits and everything beyond ASCII; null has none."""
    parts = F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))
