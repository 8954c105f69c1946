"""Analytics on digested logs, by built-in operators only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summarize(log: DataFrame, digest_col: str = "digest", text_col: str = "digest_text", ts_col: str | None = None) -> DataFrame:
    """(digest, digest_text, n[, first_seen, last_seen]) by digest. Aggregated before it is shuffled."""
    seen = [F.min(ts_col).alias("first_seen"), F.max(ts_col).alias("last_seen")] if ts_col else []
    return log.groupBy(F.col(digest_col).alias("digest")).agg(F.min(text_col).alias("digest_text"), F.count(F.lit(1)).alias("n"), *seen)


def top_digests(log: DataFrame, k: int, digest_col: str = "digest", text_col: str = "digest_text") -> DataFrame:
    """The k most frequent digests, ties by digest."""
    return summarize(log, digest_col, text_col).orderBy(F.desc("n"), "digest").limit(k)


def first_seen(log: DataFrame, ts_col: str, digest_col: str = "digest") -> DataFrame:
    """The first row of each digest, by time and then by all of the row: a minimum by map-side aggregation, no sort."""
    rest = [c for c in log.columns if c not in (ts_col, digest_col)]
    low = log.groupBy(digest_col).agg(F.min(F.struct(ts_col, *rest)).alias("_first"))
    return low.select(digest_col, "_first.*")


def numbered(log: DataFrame, ts_col: str, digest_col: str = "digest", order: tuple[str, ...] = ()) -> DataFrame:
    """``log`` with each row's number within its digest and the seconds since the one before; ``order`` if time leaves ties.

    All rows of a digest are sorted by one task, which spills; for a digest that most of a log has, use windows.
    """
    w = Window.partitionBy(digest_col).orderBy(*(order or (ts_col,)))
    return log.withColumn("nth", F.row_number().over(w)).withColumn("gap_s", F.unix_timestamp(ts_col) - F.unix_timestamp(F.lag(ts_col).over(w)))


def known_digests(log: DataFrame, known: DataFrame, digest_col: str = "digest") -> DataFrame:
    """Rows whose digest is in ``known``; Spark broadcasts it only below its own threshold."""
    return log.join(known.select(digest_col).distinct(), digest_col, "left_semi")


def unknown_digests(log: DataFrame, known: DataFrame, digest_col: str = "digest") -> DataFrame:
    """Rows whose digest is not in ``known``; a null digest is unknown."""
    return log.join(known.select(digest_col).distinct(), digest_col, "left_anti")


def compare_logs(before: DataFrame, after: DataFrame, digest_col: str = "digest") -> DataFrame:
    """(digest, change): digests that only one of two logs has, as ``gone`` or ``new``."""
    a, b = before.select(F.col(digest_col).alias("digest")).distinct(), after.select(F.col(digest_col).alias("digest")).distinct()
    return a.exceptAll(b).withColumn("change", F.lit("gone")).union(b.exceptAll(a).withColumn("change", F.lit("new")))
