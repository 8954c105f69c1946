"""What several corpus operators share: tables, scratch storage, sizes, document keys."""

from __future__ import annotations

import atexit
import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, local mode makes one; a cluster can't."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^-]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir names no folder, and with master {master} executors would not see one made here")
        named = tempfile.mkdtemp(prefix="foldline-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before this process does
        pass


def scratch(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and a lost executor loses nothing.

    The files go when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: A plan whose size Catalyst doesn't know says so by a number beyond this; its rows are then counted, at so many bytes each.
UNKNOWN, ROW_BYTES = 1 << 50, 1_000


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate for the plan: for a scan the bytes of its files, so nothing is read."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < UNKNOWN else df.count() * ROW_BYTES


def buckets(df: DataFrame, mb: float) -> int:
    """How many groups of about ``mb`` MB of input there are; it follows the input without a bound."""
    return max(8, math.ceil(size_in_bytes(df) / (mb * 1e6)))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame | None, DataFrame]:
    """(rows, units): the units (uid, text) to work on, and for rows that are no units themselves (uid, id).

    Where ids are unique and not null, ``uid`` is the id and rows is None. Otherwise the distinct (id, text) pairs are
    sorted, null first, and numbered in that order: repeated rows share a unit, rows that share only the id are told
    apart by the digest of their text. A null text is empty.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").limit(1).isEmpty():
        return None, docs.select(F.col("id").cast("long").alias("uid"), "text")
    docs = docs.withColumn("h", F.sha2("text", 256))
    keys = docs.select("id", "h").distinct().orderBy(F.col("id").asc_nulls_first(), "h")
    keys = scratch(keys.withColumn("uid", F.monotonically_increasing_id()))
    rows = docs.alias("d").join(keys.alias("k"), F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.h") == F.col("k.h")))
    rows = scratch(rows.select("uid", F.col("d.id").alias("id"), "text"))
    return rows.select("uid", "id"), rows.groupBy("uid").agg(F.first("text").alias("text"))


def unkeyed(rows: DataFrame | None, results: DataFrame, id_col: str) -> DataFrame:
    """The results of units, (uid, ...), for every row, with its id."""
    if rows is None:
        return results.withColumnRenamed("uid", id_col)
    return rows.join(results, "uid").drop("uid").withColumnRenamed("id", id_col)


#: A key that more than one row in so many has is heavy; so there are fewer heavy keys than this, whatever the rows.
HEAVY = 2_000


def join_back(rows: DataFrame, groups: DataFrame, keys: list[str], spread: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined with what is known of their keys: ``groups`` has a row for each of ``keys``, with its number of rows as n.

    Rows of heavy keys are joined by broadcast, of fewer than HEAVY keys, and go through the shuffle of the others by the
    hash of ``spread``, as do rows without a key; so no task gets all rows of one. The column n goes. ``total`` is the sum
    of n; without it ``groups`` are written and summed.
    """
    if total is None:
        groups = scratch(groups)
        total = groups.agg(F.sum("n")).first()[0] or 0
    facts = [c for c in groups.columns if c not in (*keys, "n")]
    heavy = groups.where(F.col("n") * HEAVY > total).select(*keys, F.struct(*facts).alias("_h"))
    light = groups.where(F.col("n") * HEAVY <= total).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.struct(*facts).alias("_l"))
    told = rows.join(F.broadcast(heavy), keys, "left").withColumn("_away", F.col("_h").isNotNull() | F.col(keys[0]).isNull())
    told = told.withColumns({f"_r{i}": F.when(F.col("_away"), F.xxhash64(spread)).otherwise(F.col(k).cast("long")) for i, k in enumerate(keys)})
    on = [F.col(f"_r{i}") == F.col(f"_k{i}").cast("long") for i in range(len(keys))] + [~F.col("_away")]
    out = told.join(light, on, "left").select(*rows.columns, F.coalesce("_h", "_l").alias("_f"))
    return (out.where(F.col("_f").isNotNull()) if how == "inner" else out).select(*rows.columns, *(F.col(f"_f.{c}").alias(c) for c in facts))


#: Bits of a sieve, whatever the number of ids: 4 MB for each worker. More ids let more rows through, and none is lost.
SIEVE = 1 << 25


def sieve(ids: DataFrame, col: str) -> Column:
    """Whether a row's ``col`` may be among ``ids``: true for all that are, and for few others. The driver gets ``SIEVE`` bits at most."""
    place = F.pmod(F.xxhash64(col), F.lit(SIEVE))
    words = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("x")).toArrow()
    bits = np.zeros(SIEVE // 64, np.int64)
    bits[words["w"].to_numpy()] = words["x"].to_numpy()
    known = ids.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def may(p: pa.Array) -> pa.Array:
        x = p.to_numpy(zero_copy_only=False)
        return pa.array((known.value[x >> 6] >> (x & 63)) & 1 == 1)

    return may(place)


def without(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """``rows`` whose ``col`` is not among ``ids``; only rows that a sieve lets through are shuffled."""
    may = sieve(ids, col)
    return rows.where(~may).union(rows.where(may).join(ids.select(col), col, "left_anti").select(rows.columns))


def lean(run: Callable) -> Callable:
    """``run``, a map over Arrow batches, after which a worker gives back memory that it no longer uses; workers live on."""

    def mapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return mapped


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` lacks, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def copies(units: DataFrame) -> DataFrame:
    """(uid, first, many): whether a unit is the first with its text, and whether another has it too.

    Texts are told apart by 128 bits and stay where they are; equal ones are counted with map-side aggregation.
    """
    h = units.select("uid", F.xxhash64(F.lit(1), "text").alias("a"), F.xxhash64(F.lit(2), "text").alias("b"))
    low = h.groupBy("a", "b").agg(F.min("uid").alias("low"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 1).alias("many"))
    return join_back(h, low, ["a", "b"], "uid").select("uid", (F.col("uid") == F.col("low")).alias("first"), "many")


def dealt(bucket: np.ndarray, columns: list[np.ndarray], own_bucket: np.ndarray, own: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket with the bytes of its items: ``columns`` as c0, c1, ..., and ``own`` as o0, o1, ...

    What a task knows for sure goes as ``own``: it only passes through a bucket, and any will do.
    """
    names = np.unique(np.r_[bucket, own_bucket])
    out = [pa.array(names.astype(np.int32))]
    for b, cols in ((bucket, columns), (own_bucket, own)):
        order = np.argsort(b, kind="stable")
        cuts = np.r_[np.searchsorted(b[order], names), len(order)]
        out += [pa.array([x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in (c[order] for c in cols)]
    return pa.RecordBatch.from_arrays(out, names=["bucket", *(f"c{i}" for i in range(len(columns))), *(f"o{i}" for i in range(len(own)))])


def read_dealt(t: pa.Table, name: str, dtype: type) -> np.ndarray:
    """A column of ``dealt`` rows as one array."""
    return np.frombuffer(b"".join(x or b"" for x in t[name].to_pylist()), dtype)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anywhere(parts: int, *of: np.ndarray) -> np.ndarray:
    """A bucket for each item by a hash of all that it is: items that share a part of it spread."""
    h = np.zeros(len(of[0]), np.uint64)
    for x in of:
        h = mixed(h + x.astype(np.int64, copy=False).view(np.uint64) if x.dtype != np.uint64 else h + x)
    return (h % np.uint64(parts)).astype(np.int64)
