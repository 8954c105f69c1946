"""Statement logs made from tables by templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A log with fewer bytes than this for each core is dealt over all cores before its statements are read.
SMALL = 16 << 20


#: Bytes of a log of long texts, as Catalyst estimates them, in each of the parts that it is dealt into.
PART = 4 << 20


#: Spark's setting for bytes that go to Python at a time, and how many of long texts do.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def _few_at_a_time(spark: SparkSession) -> None:
    """Rows go to Python by few MB from here on, in the whole session, as they go after a query has returned: 10,000 long texts at
    a time are 100 MB and more in each worker, and again in each copy of them there. Results don't change."""
    most = spark.conf.get(BATCH)
    if not most.isdigit() or not 0 < int(most) <= BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def _estimated(log: DataFrame) -> int:
    """Bytes by Catalyst's estimate; nothing is read."""
    return int(str(log._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(log: DataFrame) -> DataFrame:
    """A log of long texts in even parts, whatever its size: reading texts costs far more than to move them, and files of few
    or of unlike row groups leave cores idle. A stream stays as it is. Texts go to Python by few MB."""
    _few_at_a_time(log.sparkSession)
    if log.isStreaming:
        return log
    return log.repartition(max(log.sparkSession.sparkContext.defaultParallelism, -(-_estimated(log) // PART)))


def spread(log: DataFrame) -> DataFrame:
    """A small log over all cores: one file of one row group is one task, however many cores there are.

    What a log has of bytes is Catalyst's estimate; nothing is read. A larger one, or a stream, stays as it is.
    """
    cores = log.sparkSession.sparkContext.defaultParallelism
    if log.isStreaming or _estimated(log) > SMALL * cores:
        return log
    return log.repartition(cores)


def logged(df: DataFrame, *parts: Column | str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(kept columns, sql): the parts joined, strings as they are and columns as text."""
    return spread(df.select(*keep, F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).alias("sql")))


def point_selects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One look-up by key for each line item."""
    return logged(table(spark, sf_dir, "lineitem"), "SELECT * FROM lineitem WHERE l_orderkey = ", F.col("l_orderkey"))
