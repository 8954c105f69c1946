"""Windowed counts of digests; the digest itself is stateless, so only the windows keep state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.functions import Options
from foldline.operators import with_digest


def digest_windows(log: DataFrame, ts_col: str = "ts", sql_col: str = "sql", size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", options: Options = Options()) -> DataFrame:  # noqa: B008
    """(start, end, digest, digest_text, n) by tumbling or sliding window; rows later than ``late`` may be left out of a stream."""
    w = F.window(ts_col, size, slide) if slide else F.window(ts_col, size)
    counts = with_digest(log, sql_col, options).withWatermark(ts_col, late).groupBy(w.alias("w"), "digest", "digest_text").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "digest", "digest_text", "n")


def digest_sessions(log: DataFrame, ts_col: str = "ts", sql_col: str = "sql", gap: str = "5 minutes", late: str = "10 minutes", options: Options = Options()) -> DataFrame:  # noqa: B008
    """(start, end, digest, n) by sessions of each digest."""
    counts = with_digest(log, sql_col, options).withWatermark(ts_col, late).groupBy(F.session_window(ts_col, gap).alias("w"), "digest").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "digest", "n")
