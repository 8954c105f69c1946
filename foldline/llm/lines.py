"""Site-relative line frequency: lines that stand on too large a share of a host's pages are boilerplate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import fresh, scratch

#: A line is boilerplate on a host if more than this share of the host's pages have it, and if it is repeated at all.
RATIO, MIN_PAGES = 0.02, 2

#: With more flagged lines than this the table of hosts is shuffled and not broadcast; so many ways a host is then dealt.
BROADCAST_LINES, SALTS = 200_000, 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, even where ``body`` looks at it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _key(line: Column) -> Column:
    """128 bits, as text, that stand for a line without the white space around it; sets of texts are hashed."""
    bare = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return _let(bare, lambda x: F.concat(F.lpad(F.hex(F.xxhash64(F.lit(1), x)), 16, "0"), F.hex(F.xxhash64(F.lit(2), x))))


def _blank(line: Column) -> Column:
    return line.rlike(r"^[\x20\x09-\x0D]*$")


def _marked(text: Column, flagged: Column) -> Column:
    """The lines of a text, null if it is, with whether each is among ``flagged`` keys, null if there are none."""

    def decided(keys: Column) -> Column:
        return _let(F.array_intersect(flagged, keys), lambda few: F.transform(keys, lambda k: F.array_contains(few, k)))

    def marks(said: Column) -> Column:
        keys = F.transform(said, lambda x: F.when(~_blank(x), _key(x)))
        none = F.transform(said, lambda x: F.struct(x.alias("text"), F.lit(False).alias("dropped")))
        return F.when(flagged.isNull(), none).otherwise(F.zip_with(said, _let(keys, decided), lambda x, d: F.struct(x.alias("text"), F.coalesce(d, F.lit(False)).alias("dropped"))))

    return F.when(text.isNotNull(), _let(F.split(text, "\n", -1), marks))


def boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """(host, line, pages, total): the lines of each host that exceed the ratio, by their keys.

    Pages are the host's rows with a text; a page has a line once, however often it stands there. With ``copies_once``
    pages are the host's distinct texts, so that a page that was fetched often does not turn its own lines into
    boilerplate. ``min_pages`` of 2 spares lines that a single page has, whatever share of a small host that is. Counts
    are aggregated before they are shuffled, so neither a large host nor a common line meets in one task.
    """
    page = F.struct(F.xxhash64(F.lit(3), F.col(text_col)).alias("a"), F.xxhash64(F.lit(4), F.col(text_col)).alias("b"))
    pages = df.where(F.col(text_col).isNotNull()).select(F.col(host_col).alias("host"), *[page.alias("page")] * copies_once, F.col(text_col).alias("text"))
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda x: ~_blank(x)), _key))
    all_pages, lines = pages.drop("text"), pages.select(*pages.drop("text").columns, F.explode(keys).alias("line"))
    if copies_once:
        all_pages, lines = all_pages.distinct(), lines.distinct()
    total = all_pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    return counts.alias("c").join(total.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).where(F.col("pages") > ratio * F.col("total")).select("c.host", "line", "pages", "total")


def mark_lines(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False, out: str = "_lines") -> DataFrame:
    """``df`` with a column ``out``: array of (text, dropped) for the lines of the text, in order.

    Rows with a null host form a host of their own. A null text has null lines, an empty one a single blank line. Blank
    lines are never dropped. Repeated rows are pages each, and each is marked. Columns of ``df`` may have any names; one
    that is called ``out`` is replaced. The flagged lines of a host number less than its mean lines a page divided by
    ``ratio``, whatever the host's size; they are written once, counted, and broadcast only if they are few in all, else
    the hosts are salted and joined by shuffle. A text of L lines is matched with its host's F flagged ones by hash, in
    L + F steps, and L more for each of them that it has.
    """
    flagged = scratch(boilerplate(df, host_col, text_col, ratio, min_pages, copies_once))
    n = flagged.count()
    at, found, salt, to = fresh(df, "_host", "_flagged", "_salt", "_to")
    hosts = flagged.groupBy("host").agg(F.collect_set("line").alias(found)).withColumnRenamed("host", at)
    if n <= BROADCAST_LINES:
        joined = df.join(F.broadcast(hosts), df[host_col].eqNullSafe(hosts[at]), "left")
    else:
        hosts = hosts.select(at, found, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(to))
        salted = df.withColumn(salt, F.pmod(F.xxhash64(text_col), F.lit(SALTS)).cast("int"))
        joined = salted.join(hosts, salted[host_col].eqNullSafe(hosts[at]) & (F.col(salt) == F.col(to)), "left").drop(salt, to)
    return joined.withColumn(out, _marked(F.col(text_col), F.col(found))).drop(at, found)


def _kept(lines: str) -> Column:
    return F.array_join(F.transform(F.filter(lines, lambda x: ~x["dropped"]), lambda x: x["text"]), "\n")


def drop_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """``df`` with the boilerplate lines taken out of its texts; every row stays, a null text stays null."""
    (lines,) = fresh(df, "_lines")
    return mark_lines(df, host_col, text_col, ratio, min_pages, copies_once, lines).withColumn(text_col, _kept(lines)).drop(lines)


def line_digest(df: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row for each row: lines, lines dropped, and the SHA-256 of what stays. A null text has no lines.

    Texts of any length are whole: one row's lines are marked in one place.
    """
    marked = mark_lines(df.select(id_col, host_col, text_col), host_col, text_col, ratio, min_pages)
    return marked.select(
        id_col,
        F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.filter("_lines", lambda x: x["dropped"])), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce(_kept("_lines"), F.lit("")), 256).alias("kept_sha256"),
    )


#: The same in DuckDB.
LINE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT * FROM d WHERE text IS NOT NULL),
tot AS (SELECT source, count(*) AS total FROM p GROUP BY source),
l AS (SELECT DISTINCT source, r, regexp_replace(unnest(ls), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM p),
f AS (SELECT l.source, l.line FROM l JOIN tot ON l.source IS NOT DISTINCT FROM tot.source WHERE l.line <> ''
      GROUP BY l.source, l.line, tot.total HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * tot.total),
e AS (SELECT r, doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
m AS (SELECT e.r, e.i, e.line, f.line IS NOT NULL AS gone FROM e LEFT JOIN f
      ON e.source IS NOT DISTINCT FROM f.source AND regexp_replace(e.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') = f.line),
g AS (SELECT r, count(*) AS n, count(*) FILTER (gone) AS k, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY r)
SELECT d.doc_id, coalesce(g.n, 0) AS n_lines, coalesce(g.k, 0) AS n_dropped, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""
