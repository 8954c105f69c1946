"""Digests as columns of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.functions import Options, statement_digest, without_literals


def with_digest(log: DataFrame, sql_col: str = "sql", options: Options = Options(), prefix: str = "digest") -> DataFrame:  # noqa: B008
    """``log`` with ``<prefix>``, ``<prefix>_text`` and ``<prefix>_error``; batch or streaming.

    The struct is a projection of its own, so that it is computed once and not for each of its fields.
    """
    staged = log.withColumn("_digest", statement_digest(sql_col, options))
    return staged.select(
        *log.columns, F.col("_digest.hash").alias(prefix), F.col("_digest.text").alias(f"{prefix}_text"), F.col("_digest.error").alias(f"{prefix}_error")
    )


def digest_statements(log: DataFrame, sql_col: str = "sql", options: Options = Options(), prefix: str = "digest") -> DataFrame:  # noqa: B008
    """As with_digest, for a log with few distinct statements: each is read once, and digests are joined back.

    Statements that differ in literals only are one here, and meet in a map-side aggregation; what a third of the log repeats
    costs one row a task there. The log is neither sorted nor moved by key where few statements are left, as adaptive
    execution then broadcasts them; else it splits the join where that is skewed. Null statements keep null digests.
    """
    keyed = log.withColumn("_statement", without_literals(sql_col, options))
    distinct = keyed.where(F.col("_statement").isNotNull()).select("_statement").distinct()
    return keyed.join(with_digest(distinct, "_statement", options, prefix), "_statement", "left").drop("_statement")


def summarize_statements(log: DataFrame, sql_col: str = "sql", options: Options = Options()) -> DataFrame:  # noqa: B008
    """(digest, digest_text, n) of a log, as summarize(with_digest(log)): statements are counted before they are read.

    What differs in literals only is counted as one, map-side, so neither texts nor rows of the log are moved or sorted.
    """
    counted = log.select(without_literals(sql_col, options).alias("_statement")).groupBy("_statement").agg(F.count(F.lit(1)).alias("n"))
    return with_digest(counted, "_statement", options).groupBy("digest").agg(F.min("digest_text").alias("digest_text"), F.sum("n").alias("n"))
