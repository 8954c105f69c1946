"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as Parquet and
read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm import jaccard, lines, packing, pii, quality, simhash
from foldline.llm.common import scratch, table

#: Words in a shingle of the near-duplicate stage.
SHINGLE = 5
#: Spark's setting for rows that go to Python at a time.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars after a stage has changed texts."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def _few_at_a_time(spark: SparkSession) -> None:
    """Rows go to Python in small batches from here on, in the whole session: a stage's rows are read after it has returned,
    and 10,000 texts at a time are tens of MB in each task, outside of the heap, that executors keep. Results don't change."""
    rows = int(spark.conf.get(BATCH))
    spark.conf.set(BATCH, str(min(rows, jaccard.ROWS) if rows > 0 else jaccard.ROWS))


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    _few_at_a_time(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many pages of a source share go. Copies of a page count once, as the next stage is to find them whole."""
    return _recounted(lines.drop_boilerplate(docs, copies_once=True))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    _few_at_a_time(spark)
    return simhash.keep_one(docs, words=SHINGLE)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _recounted(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences."""
    _few_at_a_time(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_only),
    ("lines", without_boilerplate),
    ("simhash", one_of_each),
    ("pii", redacted),
    ("packing", packed),
]

#: Hashes, a fitted model and a tokenizer are beyond SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; what each keeps is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
