"""Documents that are awkward in every way the operators promise to stand."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use themselves
        T.StructField("uid", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("host", T.StringType()),
    ]
)


def documents(spark, texts, ids=None, sources=None):
    """A frame of ``texts`` with clashing extra columns and nulls in the others."""
    ids = ids if ids is not None else range(len(texts))
    rows = [(i, t, None if k % 3 else "en", (sources or ["s0", "s1", None])[k % len(sources or "abc")], None, "u", 0, None) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def words(rng: random.Random, n: int, pool: int = 400) -> str:
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))
