"""The vocabulary as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldline.functions import vocabulary as v


def keywords(spark: SparkSession) -> DataFrame:
    """(version, word, token, shown): keywords by server version; a few thousand rows whatever the data."""
    rows = [(version, w.decode(), t, v.TEXTS[version].get(t, b"").decode()) for version in v.VERSIONS for w, t in v.KEYWORDS[version].items()]
    return spark.createDataFrame(rows, "version string, word string, token int, shown string")
