"""Queries over digests, each with the SQL that says what must come out.

Expected hashes are built from token lists written by hand, not by the engine: an id is two bytes, a name is its token,
its length and its bytes.
"""

from __future__ import annotations

import io
import os
import sys
import tempfile
from collections.abc import Callable
from contextlib import redirect_stderr, redirect_stdout
from functools import reduce
from struct import pack
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline import functions as fn
from foldline import operators as op
from foldline.cli import main
from foldline.functions import Options
from foldline.functions import vocabulary as v
from foldline.goldens import GOLDENS
from foldline.plans import dealt, keywords, logged, point_selects
from foldline.plans.logs import table
from foldline.sources import as_json, as_lines, from_files, from_text, trimmed, write_digests
from foldline.streaming import digest_sessions, digest_windows

W = {w.decode(): i for w, i in v.KEYWORDS["9.0"].items()}
VALUE, VALUES, ROW, ROWS, WIDE, WIDES, IN_LIST = 1100, 1101, 1102, 1103, 1104, 1105, 1110


def _bytes(tokens: list, version: str = "8.0") -> str:
    """Hex of what is hashed: ints and words are tokens, strings that start with a backtick are names."""
    out = b""
    for t in tokens:
        name = t[1:].encode() if isinstance(t, str) and t.startswith("`") else None
        i = v.NAME if name is not None else t if isinstance(t, int) else W[t] if t in W else ord(t)
        out += pack("<H", v.TO_57.get(i, v.UNUSED_57) if version == "5.7" and i > 255 else i)
        if name is not None:
            out += pack("<H", len(name) & 0xFFFF) + name
    return out.hex()


def _hash_sql(tokens: list, version: str = "8.0") -> str:
    return f"{'md5' if version == '5.7' else 'sha256'}(unhex('{_bytes(tokens, version)}'))"


def _named_hash(before: list, name: str, after: list) -> str:
    """As _hash_sql, with one name that is an SQL expression."""
    size = f"octet_length(encode({name}))"
    head, tail = _bytes(before) + pack("<H", v.NAME).hex(), _bytes(after)
    return f"sha256(unhex('{head}') || unhex(printf('%02x%02x', {size} % 256, ({size} // 256) % 256)) || encode({name}) || unhex('{tail}'))"


def _text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''").replace("\0", "' || chr(0) || '") + "'"


def _counted(log: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    return op.summarize(op.with_digest(log, options=options))


# --- logs made from tables -------------------------------------------------------------------------------------------

_POINT = ["SELECT", "*", "FROM", "`lineitem", "WHERE", "`l_orderkey", "=", VALUE]


def digest_point_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(point_selects(spark, sf_dir))


def digest_distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.summarize_statements(point_selects(spark, sf_dir))


_POINT_SQL = f"SELECT {_hash_sql(_POINT)} AS digest, 'SELECT * FROM `lineitem` WHERE `l_orderkey` = ?' AS digest_text, count(*) AS n FROM lineitem"


def digest_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = F.array_join(F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), lambda x: x * F.col("l_orderkey")), ", ")
    log = logged(table(spark, sf_dir, "lineitem"), "SELECT o_custkey FROM orders WHERE o_orderkey IN (", numbers, ")")
    both = op.with_digest(op.with_digest(log, options=Options("5.7"), prefix="old"), prefix="new")  # one pass over the log
    row = lambda version, x: F.struct(F.lit(version).alias("version"), F.col(x).alias("digest"), F.col(f"{x}_text").alias("digest_text"))
    rows = both.select(F.inline(F.array(row("8.0", "new"), row("5.7", "old"))))
    return rows.groupBy("version", "digest", "digest_text").agg(F.count(F.lit(1)).alias("n"))


_IN_HEAD = ["SELECT", "`o_custkey", "FROM", "`orders", "WHERE", "`o_orderkey"]
_IN_SQL = f"""
SELECT {_hash_sql([*_IN_HEAD, IN_LIST])} AS digest, 'SELECT `o_custkey` FROM `orders` WHERE `o_orderkey` IN (...)' AS digest_text, count(*) AS n, '8.0' AS version FROM lineitem
UNION ALL
SELECT CASE WHEN l_linenumber = 1 THEN {_hash_sql([*_IN_HEAD, "IN", ROW], "5.7")} ELSE {_hash_sql([*_IN_HEAD, "IN", WIDE], "5.7")} END AS digest,
       'SELECT `o_custkey` FROM `orders` WHERE `o_orderkey` IN ' || CASE WHEN l_linenumber = 1 THEN '(?)' ELSE '(...)' END AS digest_text, count(*) AS n, '5.7' AS version
FROM lineitem GROUP BY ALL
"""


def digest_multi_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("("), F.col("o_orderkey"), F.lit(", "), F.col("o_totalprice"), F.lit(")"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(row), ", ").alias("rows"))
    return _counted(logged(rows, "INSERT INTO bought (bill, cost) VALUES ", F.col("rows"), ";"))


_INSERT_HEAD = ["INSERT", "INTO", "`bought", "(", "`bill", ",", "`cost", ")", "VALUES"]
_INSERT_SQL = f"""
WITH c AS (SELECT o_custkey, count(*) AS rows FROM orders GROUP BY o_custkey)
SELECT CASE WHEN rows = 1 THEN {_hash_sql([*_INSERT_HEAD, WIDE])} ELSE {_hash_sql([*_INSERT_HEAD, WIDES])} END AS digest,
       'INSERT INTO `bought` ( `bill` , `cost` ) VALUES ' || CASE WHEN rows = 1 THEN '(...)' ELSE '(...) /* , ... */' END AS digest_text, count(*) AS n FROM c GROUP BY ALL
"""


def digest_neg_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = logged(table(spark, sf_dir, "customer"), "SELECT * FROM t WHERE x > ", F.col("c_acctbal"))
    b = logged(table(spark, sf_dir, "supplier"), "SELECT * FROM t WHERE x > - + ", F.col("s_acctbal"), " -- signs")
    return _counted(a.union(b))


_NEG_SQL = f"""
SELECT {_hash_sql(["SELECT", "*", "FROM", "`t", "WHERE", "`x", ">", VALUE])} AS digest, 'SELECT * FROM `t` WHERE `x` > ?' AS digest_text,
       (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n
"""


def digest_string_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit("'"), F.col("o_orderpriority"), F.lit("''s \\' '"))
    return _counted(logged(table(spark, sf_dir, "orders"), "UPDATE bought SET urgency = ", quoted, ", cost = 0x1F WHERE bill = '", F.col("o_orderkey"), "'"))


_STRING_TOKENS = ["UPDATE", "`bought", "SET", "`urgency", "=", VALUE, ",", "`cost", "=", VALUE, "WHERE", "`bill", "=", VALUE]
_STRING_SQL = f"SELECT {_hash_sql(_STRING_TOKENS)} AS digest, 'UPDATE `bought` SET `urgency` = ? , `cost` = ? WHERE `bill` = ?' AS digest_text, count(*) AS n FROM orders"


def digest_null_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = F.element_at(F.array(*map(F.lit, ("IS NULL", "is not /* c */ null", "= NULL", "NOT NULL"))), (F.col("event_id") % 4 + 1).cast("int"))
    return _counted(logged(table(spark, sf_dir, "events"), "SELECT x FROM t WHERE x ", which))


_NULL_TAIL = (["IS", "NULL"], "IS NULL"), (["IS", "NOT", "NULL"], "IS NOT NULL"), (["=", VALUE], "= ?"), (["NOT", VALUE], "NOT ?")
_NULL_SQL = " UNION ALL ".join(
    f"SELECT {_hash_sql(['SELECT', '`x', 'FROM', '`t', 'WHERE', '`x', *tokens])} AS digest, 'SELECT `x` FROM `t` WHERE `x` {text}' AS digest_text, count(*) AS n FROM events WHERE event_id % 4 = {i} HAVING count(*) > 0"
    for i, (tokens, text) in enumerate(_NULL_TAIL)
)


# --- statements written by hand: name, version, statement, text, tokens ----------------------------------------------

_S = "SELECT"
CASES: tuple[tuple[str, str, str, str, list], ...] = (
    ("empty", "8.0", "", "", []),
    ("one_semicolon", "8.0", "SELECT 1;;", "SELECT ? ;", [_S, VALUE, ";"]),
    ("numbers", "8.0", "SELECT 1, 1.5, .5, 1., 1e10, 0x1F, x'1f', b'01', 0b1", "SELECT ?, ...", [_S, VALUES]),
    ("not_numbers", "8.0", "SELECT 1abc, 0xg, 1e", "SELECT `1abc` , `0xg` , `1e`", [_S, "`1abc", ",", "`0xg", ",", "`1e"]),
    ("signs", "8.0", "SELECT a - 1, -1, (+-2)", "SELECT `a` - ?, ... , (?)", []),
    ("sign_after_distinct", "8.0", "SELECT DISTINCT -1", "SELECT DISTINCTROW - ?", [_S, "DISTINCT", "-", VALUE]),
    ("rows", "8.0", "VALUES (1),(2),(3)", "VALUES (?) /* , ... */", ["VALUES", ROWS]),
    ("mixed_rows", "8.0", "VALUES (1),(2,3),(4,5)", "VALUES (?) , (...) /* , ... */", ["VALUES", ROW, ",", WIDES]),
    ("nested", "8.0", "SELECT ((1))", "SELECT ( (?) )", [_S, "(", ROW, ")"]),
    ("in_then_row", "8.0", "SELECT a IN (1),(2)", "SELECT `a` IN (...) , (?)", [_S, "`a", IN_LIST, ",", ROW]),
    ("in_57", "5.7", "SELECT a IN (1, 2)", "SELECT `a` IN (...)", [_S, "`a", "IN", WIDE]),
    ("names", "8.0", "SELECT `a``b`.c, d.select, name", "SELECT `a``b` . `c` , `d` . `select` , NAME", [_S, "`a`b", ".", "`c", ",", "`d", ".", "`select", ",", "NAME"]),
    ("user_variables", "8.0", "SET @x := 5, @`y` = @@session.sql_mode", "SET @? := ? , @`y` = @@SESSION . `sql_mode`", ["SET", "@", VALUE, 757, VALUE, ",", "@", "`y", "=", "@", "@", "SESSION", ".", "`sql_mode"]),
    ("arrows", "8.0", "SELECT a->'$.b', a->>'$.c'", "SELECT `a` -> ? , `a` ->> ?", [_S, "`a", 514, VALUE, ",", "`a", 907, VALUE]),
    ("comments", "8.0", "SELECT a /* x */, b -- y\n# z\n/*+ no hint */", "SELECT `a` , `b`", [_S, "`a", ",", "`b"]),
    ("dashes", "8.0", "SELECT a--b", "SELECT `a` - - `b`", [_S, "`a", "-", "-", "`b"]),
    ("question_mark", "8.0", "SELECT a IN (?, ?)", "SELECT `a` IN ( ? , ? )", [_S, "`a", "IN", "(", "?", ",", "?", ")"]),
    ("null_in_ddl", "8.0", "SELECT x NOT NULL", "SELECT `x` NOT ?", [_S, "`x", "NOT", VALUE]),
    ("strings_side_by_side", "8.0", "SELECT 'a' 'b', N'it\\', _utf8'x'", "SELECT ? ?, ... , `_utf8` ?", [_S, VALUE, VALUES, ",", "`_utf8", VALUE]),
    ("hint", "8.0", "SELECT /*+ MAX_EXECUTION_TIME(10) x=1 `q` */ 1", "SELECT /*+ MAX_EXECUTION_TIME (?) `x` = ? ```q``` */ ?", [_S, 1108, v.HINTS[b"MAX_EXECUTION_TIME"], ROW, "`x", 61, VALUE, "``q`", 1109, VALUE]),
    ("hint_after_number", "8.0", "SELECT 1 /*+ NO_ICP(t) */", "SELECT ? /*+ NO_ICP ( `t` ) */", [_S, VALUE, 1108, v.HINTS[b"NO_ICP"], "(", "`t", ")", 1109]),
    ("new_hint_57", "5.7", "SELECT /*+ SET_VAR(a = 1) */ b", "SELECT /*+ SET_VAR ( `a` = ? ) */ `b`", [_S, 1108, v.HINTS[b"SET_VAR"], "(", "`a", 61, VALUE, ")", 1109, "`b"]),
    ("version_comment_80", "8.0", "SELECT /*!50000 a */ , b", "SELECT `a` , `b`", [_S, "`a", ",", "`b"]),
    ("version_comment_90", "9.0", "SELECT /*!50000 a */ b", "SELECT `b`", [_S, "`b"]),
    ("bare_version_comment_90", "9.0", "SELECT /*! a */ b", "SELECT `a` `b`", [_S, "`a", "`b"]),
    ("version_comment_new", "5.7", "SELECT /*!80000 a, */ b", "SELECT `b`", [_S, "`b"]),
    ("version_comment_eats_a_byte", "8.0", "SELECT /*!50000 a*/,b", "SELECT `a` `b`", [_S, "`a", "`b"]),
    ("six_digit_version", "8.0", "SELECT /*!500001+1*/ ", "SELECT", [_S]),
    ("short_version", "8.0", "SELECT /*!123 a */ b", "SELECT `b`", [_S, "`b"]),
    ("dollar_string", "8.0", "SELECT $$ a $$, $t$ b $ $t$, $x", "SELECT , , `$x`", [_S, 1204, ",", 1204, ",", "`$x"]),
    ("open_dollar_string", "8.0", "SELECT a, $$ b;", "SELECT `a` ,", [_S, "`a", ","]),
    ("odd_operators", "8.0", "SELECT a == b, c <=> d, e =< f, !g", "SELECT `a` = `b` , `c` <=> `d` , `e` = `f` , ! `g`", [_S, "`a", 61, "`b", ",", "`c", "<=>", "`d", ",", "`e", 61, "`f", ",", 33, "`g"]),
    ("new_word_80", "8.0", "SELECT qualify FROM t", "SELECT `qualify` FROM `t`", [_S, "`qualify", "FROM", "`t"]),
    ("new_word_84", "8.4", "SELECT qualify FROM t", "SELECT QUALIFY FROM `t`", [_S, "QUALIFY", "FROM", "`t"]),
    ("new_word_90", "9.0", "SELECT vector FROM t", "SELECT VECTOR FROM `t`", [_S, "VECTOR", "FROM", "`t"]),
    ("old_word_80", "8.0", "SELECT get_master_public_key", "SELECT GET_MASTER_PUBLIC_KEY", [_S, 967]),
    ("old_word_84", "8.4", "SELECT get_master_public_key", "SELECT `get_master_public_key`", [_S, "`get_master_public_key"]),
    ("window_word_57", "5.7", "SELECT rank FROM t", "SELECT `rank` FROM `t`", [_S, "`rank", "FROM", "`t"]),
    ("old_word_57", "5.7", "SELECT master_host", "SELECT MASTER_HOST", [_S, 554]),
    ("nul_ends", "8.0", "SELECT a\0, b", "SELECT `a`", [_S, "`a"]),
    ("nul_ends_line_comment", "8.0", "SELECT a -- x\0, b", "SELECT `a` , `b`", [_S, "`a", ",", "`b"]),
    ("hint_name_as_column", "8.0", "SELECT subquery, index_merge FROM t", "SELECT SUBQUERY , INDEX_MERGE FROM `t`", [_S, "SUBQUERY", ",", "INDEX_MERGE", "FROM", "`t"]),
    ("nested_version_comments", "8.0", "SELECT /*!50000 a /*!50000 b */ c */ d", "SELECT `a` `b` `c` * / `d`", [_S, "`a", "`b", "`c", "*", "/", "`d"]),
    ("open_version_comment", "8.0", "SELECT /*!50000 a", "SELECT `a`", [_S, "`a"]),
    ("logical_operators", "8.0", "SELECT a && b & c || d | e", "SELECT `a` && `b` & `c` || `d` | `e`", [_S, "`a", "&&", "`b", "&", "`c", "||", "`d", "|", "`e"]),
    ("unicode", "8.0", "SELECT 名字 FROM 表 WHERE é = 'ü🙂'", "SELECT `名字` FROM `表` WHERE `é` = ?", [_S, "`名字", "FROM", "`表", "WHERE", "`é", "=", VALUE]),
)
# What needs its tokens spelled out.
_TOKENS = {"signs": [_S, "`a", "-", VALUES, ",", ROW]}
CASES = tuple((n, ver, sql, text, _TOKENS.get(n, tokens)) for n, ver, sql, text, tokens in CASES)


def _by_version(spark: SparkSession, rows: list[tuple[str, str, str]]) -> list[tuple[DataFrame, str]]:
    return [(spark.createDataFrame([(n, s) for n, ver, s in rows if ver == version], "name string, sql string"), version) for version in v.VERSIONS if any(ver == version for _, ver, _ in rows)]


def digest_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [op.with_digest(df, options=Options(version)).select("name", F.lit(version).alias("version"), "digest", "digest_text") for df, version in _by_version(spark, [c[:3] for c in CASES])]
    return reduce(DataFrame.union, parts)


_CASES_SQL = "SELECT * FROM (VALUES " + ",\n".join(f"({_text(n)}, {_text(ver)}, {_hash_sql(tokens, ver)}, {_text(text)})" for n, ver, _, text, tokens in CASES) + ") t(name, version, digest, digest_text)"

#: Words that share a token: written, shown.
SYNONYMS = "DISTINCT DISTINCTROW|ANY SOME|INT INTEGER|INT4 INTEGER|BIGINT INT8|CHAR CHARACTER|VARCHAR VARCHARACTER|DOUBLE FLOAT8|FLOAT FLOAT4|DEC DECIMAL|MEDIUMINT MIDDLEINT|INT3 MIDDLEINT|INT1 TINYINT|INT2 SMALLINT|DATABASE SCHEMA|DATABASES SCHEMAS|COLUMNS FIELDS|DESCRIBE EXPLAIN|REGEXP RLIKE|CURRENT_DATE CURDATE|CURRENT_TIME CURTIME|CURRENT_TIMESTAMP NOW|LOCALTIME NOW|LOCALTIMESTAMP NOW|MID SUBSTRING|SUBSTR SUBSTRING|STD STDDEV_POP|STDDEV STDDEV_POP|VARIANCE VAR_POP|SESSION_USER USER|SYSTEM_USER USER|IO_THREAD RELAY_THREAD|NDB NDBCLUSTER|GEOMCOLLECTION GEOMETRYCOLLECTION|SECOND SQL_TSI_SECOND|DAY SQL_TSI_DAY|SQL_TSI_WEEK WEEK|SQL_TSI_YEAR YEAR"


def digest_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [tuple(x.split()) for x in SYNONYMS.split("|")]
    df = spark.createDataFrame(pairs, "word string, shown string").withColumn("sql", F.concat(F.lit("x "), F.lower("word")))
    out = op.with_digest(df).withColumn("a", F.col("digest"))
    same = op.with_digest(df.withColumn("sql", F.concat(F.lit("x "), "shown"))).select("word", F.col("digest").alias("b"))
    return out.join(same, "word").select("word", "digest_text", (F.col("a") == F.col("b")).alias("same"))


_SYNONYMS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '`x` {b}', true)" for a, b in (x.split() for x in SYNONYMS.split("|"))) + ") t(word, digest_text, same)"

#: Statements with something wrong: statement, message, position, text before it, whether the message quotes the input.
FAULTS = (
    ("SELECT 'abc", "unterminated string literal", 7, "SELECT", True),
    ("SELECT é, `abc", "unterminated string literal", 11, "SELECT `é` ,", True),
    ("SELECT a; /* b", "unterminated block comment", 10, "SELECT `a` ;", True),
    ("SELECT x'abc'", "invalid hex literal", 7, "SELECT", False),
    ("SELECT x'zz'", "invalid hex literal", 7, "SELECT", False),
    ("SELECT b'012'", "invalid binary literal", 7, "SELECT", False),
    ("SELECT /*+ NO_ICP", "unterminated optimizer hint", 17, "SELECT /*+ NO_ICP", False),
    ("SELECT /*+ 'a", "unterminated string literal", 11, "SELECT /*+", False),
    ("SELECT /*+ `a", "unterminated quoted identifier", 11, "SELECT /*+", False),
    ("SELECT $$a", None, None, "SELECT", False),
    ("SELECT 1", None, None, "SELECT ?", False),
    ("SELECT a, 'b\0'", "unterminated string literal", 10, "SELECT `a` ,", True),
    ("SELECT `b\0`", "unterminated string literal", 7, "SELECT", True),
)


def lex_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = op.with_digest(spark.createDataFrame([(f[0],) for f in FAULTS], "sql string"))
    return df.select("sql", "digest_text", F.col("digest_error.message").alias("message"), F.col("digest_error.position").alias("position"), F.nullif(F.col("digest_error.input"), F.lit("")).alias("input"))


_FAULTS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({_text(s)}, {_text(t)}, {_text(m)}, CAST({'NULL' if p is None else p} AS INTEGER), {_text(s if near else None)})" for s, m, p, t, near in FAULTS) + ") t(sql, digest_text, message, position, input)"


def sql_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([('SELECT "a""b", \'c\\\', d',), ("SELECT \"a\", 'b\\'c'",)], "sql string")
    modes = [(a, b) for a in (False, True) for b in (False, True)]
    return reduce(DataFrame.union, [op.with_digest(df, options=Options(ansi_quotes=a, no_backslash_escapes=b)).select("sql", F.lit(a).alias("ansi"), F.lit(b).alias("plain"), "digest_text", F.col("digest_error.position").alias("position")) for a, b in modes])


_MODES_SQL = r"""
SELECT sql, ansi, plain, digest_text, CAST(position AS INTEGER) AS position FROM (VALUES
('SELECT "a""b", ''c\'', d', false, false, 'SELECT ? ,', 15), ('SELECT "a""b", ''c\'', d', false, true, 'SELECT ?, ... , `d`', NULL),
('SELECT "a""b", ''c\'', d', true, false, 'SELECT `a"b` ,', 15), ('SELECT "a""b", ''c\'', d', true, true, 'SELECT `a"b` , ? , `d`', NULL),
('SELECT "a", ''b\''c''', false, false, 'SELECT ?, ...', NULL), ('SELECT "a", ''b\''c''', false, true, 'SELECT ?, ... `c`', 17),
('SELECT "a", ''b\''c''', true, false, 'SELECT `a` , ?', NULL), ('SELECT "a", ''b\''c''', true, true, 'SELECT `a` , ? `c`', 17)) t(sql, ansi, plain, digest_text, position)
"""


def max_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select(F.concat(F.lit("SELECT "), F.lower("c_mktsegment"), F.lit(" FROM t")).alias("sql")).distinct()
    whole = op.with_digest(df).select("sql", F.col("digest").alias("whole"))
    return op.with_digest(df, options=Options(max_length=12)).join(whole, "sql").select("sql", "digest_text", (F.col("digest") == F.col("whole")).alias("same_hash"))


_LENGTH_SQL = """
SELECT DISTINCT 'SELECT ' || lower(c_mktsegment) || ' FROM t' AS sql, left('SELECT `' || lower(c_mktsegment) || '` FROM `t`', 12) || '...' AS digest_text, true AS same_hash FROM customer
"""


# --- functions ---------------------------------------------------------------------------------------------------------


def integer_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = F.explode(F.array(*(F.lit(x).cast("decimal(25,0)") for x in ("1", "100000", "1431655765", "1000000000000000", "-150000", "-1431655765000", "12345678901234567")))).alias("f")
    df = table(spark, sf_dir, "orders").select("o_orderkey", factor).select((F.col("o_orderkey") * F.col("f")).cast("string").alias("digits"))
    return df.groupBy(fn.classify_integer("digits").alias("class")).agg(F.count(F.lit(1)).alias("n"))


_INTEGER_SQL = """
WITH x AS (SELECT o_orderkey::HUGEINT * f AS d FROM orders, (VALUES (1::HUGEINT), (100000), (1431655765), (1000000000000000), (-150000), (-1431655765000), (12345678901234567)) t(f))
SELECT CASE WHEN d BETWEEN -2147483648 AND 2147483647 THEN 'NUM' WHEN d BETWEEN -9223372036854775808::HUGEINT AND 9223372036854775807 THEN 'LONG_NUM'
       WHEN d BETWEEN 0 AND 18446744073709551615::HUGEINT THEN 'ULONGLONG_NUM' ELSE 'DECIMAL_NUM' END AS class, count(*) AS n FROM x GROUP BY 1
"""


def ident_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("`"))
    df = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), fn.quote_identifier(name).alias("quoted"))
    return df.select("*", fn.unquote_identifier("quoted").alias("unquoted"), fn.truncate_bytes("quoted", 9).alias("cut"))


_QUOTE_SQL = """
WITH x AS (SELECT p_partkey, replace(p_name, ' ', '`') AS name FROM part), y AS (SELECT *, '`' || replace(name, '`', '``') || '`' AS quoted FROM x)
SELECT p_partkey, name, quoted, name AS unquoted, CASE WHEN strlen(quoted) > 9 THEN left(quoted, 9) || '...' ELSE quoted END AS cut FROM y
"""


def keyword_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(w,) for w in ("select", "Rank", "QUALIFY", "vector", "users", "master_host", "get_master_public_key", "lineitem")], "word string")
    found = words.join(keywords(spark).withColumnRenamed("word", "upper"), F.upper("word") == F.col("upper"), "left")
    return found.groupBy("word").agg(F.array_join(F.sort_array(F.collect_list("version")), " ").alias("versions"))


_LOOKUP_SQL = """
SELECT * FROM (VALUES ('select', '5.7 8.0 8.4 9.0'), ('Rank', '8.0 8.4 9.0'), ('QUALIFY', '8.4 9.0'), ('vector', '9.0'), ('users', ''), ('master_host', '5.7'),
('get_master_public_key', '8.0'), ('lineitem', '')) t(word, versions)
"""


def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords(spark).groupBy("version").agg(F.count(F.lit(1)).alias("n"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([("SELECT é>>>=1 FROM t",)], "sql string")
    return df.select(F.explode(fn.statement_tokens("sql", Options("8.4"))).alias("t")).select("t.*")


_SHIFT, _GE = W[">>"], W[">="]
_TOKENS_SQL = f"""
SELECT CAST(type AS INTEGER) AS type, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", text FROM (VALUES ({W["SELECT"]}, 0, 6, 'SELECT'), (482, 7, 9, 'é'), ({_SHIFT}, 9, 11, '>>'), ({_GE}, 11, 13, '>='),
(628, 13, 14, '1'), ({W["FROM"]}, 15, 19, 'FROM'), (482, 20, 21, 't')) t(type, s, e, text)
"""


def prepared_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens where a question mark is a parameter."""
    df = spark.createDataFrame([("a && ? || ?b & |",)], "sql string")
    return df.select(F.explode(fn.statement_tokens("sql", prepared=True)).alias("t")).select("t.*")


_PREPARED_SQL = f"""
SELECT CAST(type AS INTEGER) AS type, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", text FROM (VALUES (482, 0, 1, 'a'), ({W["&&"]}, 2, 4, '&&'), (652, 5, 6, '?'), ({W["||"]}, 7, 9, '||'),
(63, 10, 11, '?'), (482, 11, 12, 'b'), (38, 13, 14, '&'), (124, 15, 16, '|')) t(type, s, e, text)
"""


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fn.register(spark)
    table(spark, sf_dir, "nation").createOrReplaceTempView("_nations")
    return spark.sql("""
        SELECT n_nationkey, statement_digest(s) AS digest, statement_digest_text(s) AS digest_text, get_json_object(statement_digest_json(s), '$.text') AS json_text,
               statement_digest_json(s, version) AS json, d.hash AS all_digest, d.text AS all_text, d.error AS error
        FROM (SELECT *, statement_digest_all(s, version) AS d FROM
              (SELECT n_nationkey, concat('SELECT * FROM a WHERE b = ', n_nationkey) AS s, element_at(array('5.7', '8.0', 'unknown'), n_nationkey % 3 + 1) AS version FROM _nations))
        """)


_FUNCTION_TOKENS = ["SELECT", "*", "FROM", "`a", "WHERE", "`b", "=", VALUE]
_FUNCTIONS_SQL = f"""
WITH n AS (SELECT n_nationkey, {_hash_sql(_FUNCTION_TOKENS)} AS digest, CASE WHEN n_nationkey % 3 = 0 THEN {_hash_sql(_FUNCTION_TOKENS, "5.7")} ELSE {_hash_sql(_FUNCTION_TOKENS)} END AS all_digest,
           'SELECT * FROM `a` WHERE `b` = ?' AS t FROM nation)
SELECT n_nationkey, digest, t AS digest_text, t AS json_text, '{{"text":"' || t || '","hash":"' || all_digest || '"}}' AS json, all_digest, t AS all_text, NULL::VARCHAR AS error FROM n
"""


def sql_function_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the function for JSON says of a statement that cannot be read, and of bytes that are no text."""
    fn.register(spark)
    q = F.lit("'")
    df = table(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit("x "), q, F.lit("<"), "r_regionkey").alias("a"), F.concat(F.lit("SELECT "), q, F.unhex(F.lit("ff")).cast("string"), q).alias("b"))
    return df.selectExpr("r_regionkey", "statement_digest_json(a) AS json", "statement_digest_text(b) AS broken")


_ERRORS_SQL = r"""
SELECT r_regionkey, '{"error":"lex error at position 2: unterminated string literal (near \"x ''\u003c' || r_regionkey || '\")"}' AS json, 'SELECT ?' AS broken FROM region
"""


def sink_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = op.with_digest(logged(table(spark, sf_dir, "region"), "  SELECT a <> b & ", F.col("r_regionkey"), " \n", keep=("r_regionkey",)).withColumn("sql", trimmed("sql")))
    return df.select("r_regionkey", as_lines().alias("lines"), as_json().alias("json"), "sql")


_SINK_HASH = _hash_sql(["SELECT", "`a", "<>", "`b", "&", VALUE])
_SINK_SQL = rf"""
SELECT r_regionkey, 'DIGEST: ' || {_SINK_HASH} || chr(10) || 'DIGEST_TEXT: SELECT `a` != `b` & ?' AS lines,
       '{{"digest":"' || {_SINK_HASH} || '","digest_text":"SELECT `a` != `b` \u0026 ?"}}' AS json, 'SELECT a <> b & ' || r_regionkey AS sql FROM region
"""


def _shared(spark: SparkSession) -> str:
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.gettempdir()}/digests-{uuid4().hex}"


def sink_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each form of the text sink, written and read again; a statement with an error has no line."""
    path = _shared(spark)
    log = logged(table(spark, sf_dir, "region"), "SELECT a FROM t", F.col("r_regionkey")).union(from_text(spark, "SELECT 'a"))
    out = []
    for form in ("lines", "json", "text", "hash"):
        write_digests(op.with_digest(log), f"{path}/{form}", form)
        out.append(spark.read.text(f"{path}/{form}").select(F.lit(form).alias("form"), F.col("value").alias("line")))
    return reduce(DataFrame.union, out)


_FILES_HASH = _named_hash(["SELECT", "`a", "FROM"], "'t' || r_regionkey", [])
_FILES_SQL = f"""
WITH d AS (SELECT {_FILES_HASH} AS h, 'SELECT `a` FROM `t' || r_regionkey || '`' AS t FROM region)
SELECT 'lines' AS form, 'DIGEST: ' || h AS line FROM d UNION ALL SELECT 'lines', 'DIGEST_TEXT: ' || t FROM d
UNION ALL SELECT 'json', '{{"digest":"' || h || '","digest_text":"' || t || '"}}' FROM d UNION ALL SELECT 'text', t FROM d UNION ALL SELECT 'hash', h FROM d
"""


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files as statements, white space around them trimmed; a file of white space only has no row."""
    path = _shared(spark)
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("\u00a0\nSELECT *\nFROM n"), F.col("n_nationkey"), F.lit(" \t")).alias("value"), "n_nationkey")
    rows.union(spark.createDataFrame([(" \n\t", 99)], "value string, n_nationkey int")).write.partitionBy("n_nationkey").text(path)
    return op.with_digest(from_files(spark, f"{path}/*/*.txt")).select("sql", "digest", "digest_text")


_NATION_HASH = _named_hash(["SELECT", "*", "FROM"], "'n' || n_nationkey", [])
_SOURCE_SQL = f"SELECT 'SELECT *' || chr(10) || 'FROM n' || n_nationkey AS sql, {_NATION_HASH} AS digest, 'SELECT * FROM `n' || n_nationkey || '`' AS digest_text FROM nation"

#: Runs of the command: name, arguments, what is piped in, exit code, what it prints. FILE is a file, HASH a digest of SELECT and a value.
RUNS: tuple[tuple[str, list[str], str | None, int, str], ...] = (
    ("option", ["--sql", " SELECT 5\n", "-f", "FILE", "SELECT 'arg'"], "SELECT pipe", 0, "DIGEST: HASH\nDIGEST_TEXT: SELECT ?\n"),
    ("file", ["--file", "FILE", "SELECT arg"], "SELECT pipe", 0, "DIGEST: HASH\nDIGEST_TEXT: SELECT ?\n"),
    ("argument", ["SELECT 1", "--text-only"], "SELECT pipe", 0, "SELECT ?\n"),
    ("pipe", ["--hash-only"], "\n SELECT 2 ", 0, "HASH\n"),
    ("json_first", ["SELECT 1", "--hash-only", "--text-only", "--json"], None, 0, '{\n  "digest": "HASH",\n  "digest_text": "SELECT ?"\n}\n'),
    ("text_before_hash", ["SELECT 1", "--hash-only", "--text-only"], None, 0, "SELECT ?\n"),
    ("nothing", [], None, 1, "Error: no SQL input provided\n"),
    ("white_space", ["--sql", " "], None, 1, "Error: no SQL input provided\n"),
    ("fault", ["SELECT 'a"], None, 1, "Error: computing digest: lex error at position 7: unterminated string literal (near \"SELECT 'a\")\n"),
)


def cli_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line: where its statement comes from, what it prints, how it ends."""
    rows, stdin = [], sys.stdin
    with tempfile.TemporaryDirectory() as d:
        path = os.path.join(d, "statement.sql")
        with open(path, "w") as f:
            f.write("\n SELECT 7 \n")
        try:
            for name, args, piped, _, _ in RUNS:
                said = io.StringIO()
                sys.stdin = None if piped is None else io.StringIO(piped)
                with redirect_stdout(said), redirect_stderr(said):
                    code = main([path if a == "FILE" else a for a in args])
                rows.append((name, code, said.getvalue()))
        finally:
            sys.stdin = stdin
    return spark.createDataFrame(rows, "name string, code int, printed string")


_RUNS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({_text(n)}, {code}::INTEGER, replace({_text(out)}, 'HASH', {_hash_sql(['SELECT', VALUE])}))" for n, _, _, code, out in RUNS) + ") t(name, code, printed)"


def goldens_80(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.with_digest(from_text(spark, *(s for s, new, _ in GOLDENS if new))).select("sql", "digest")


def goldens_57(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.with_digest(from_text(spark, *(s for s, _, old in GOLDENS if old)), options=Options("5.7")).select("sql", "digest")


_GOLDENS_SQL = tuple("SELECT * FROM (VALUES " + ", ".join(f"({_text(g[0])}, '{g[i]}')" for g in GOLDENS if g[i]) + ") t(sql, digest)" for i in (1, 2))


# --- analytics -----------------------------------------------------------------------------------------------------------


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with a digest for each kind of event: the kind is a table's name."""
    return op.with_digest(logged(table(spark, sf_dir, "events"), "SELECT * FROM kind_", F.col("event_type"), " WHERE id = ", F.col("user_id"), keep=("event_id", "ts", "user_id")))


_EVENT_HASH = _named_hash(["SELECT", "*", "FROM"], "('kind_' || event_type)", ["WHERE", "`id", "=", VALUE])
_EVENT_TEXT = "'SELECT * FROM `kind_' || event_type || '` WHERE `id` = ?'"


def log_top_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent digests, ties by digest."""
    return op.top_digests(_event_log(spark, sf_dir), 3)


_TOP_SQL = f"SELECT {_EVENT_HASH} AS digest, {_EVENT_TEXT} AS digest_text, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, digest LIMIT 3"


def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.summarize(_event_log(spark, sf_dir), ts_col="ts")


_SUMMARY_SQL = f"SELECT {_EVENT_HASH} AS digest, {_EVENT_TEXT} AS digest_text, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY event_type"


def log_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.first_seen(_event_log(spark, sf_dir).select("digest", "digest_text", "ts", "event_id"), "ts").select("digest", "digest_text", "ts")


_FIRST_SQL = f"SELECT {_EVENT_HASH} AS digest, {_EVENT_TEXT} AS digest_text, min(ts) AS ts FROM events GROUP BY event_type"


def log_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come first, second and third of their digest, and the seconds since the row before."""
    log = _event_log(spark, sf_dir).select("digest", F.struct("ts", "event_id").alias("at"), "ts")
    return op.numbered(log, "ts", order=("at",)).where("nth <= 3").select("digest", "nth", "gap_s", F.col("at.event_id").alias("event_id"))


_NUMBERED_SQL = f"""
WITH e AS (SELECT {_EVENT_HASH} AS digest, row_number() OVER w AS nth, epoch(date_trunc('second', ts))::BIGINT - epoch(date_trunc('second', lag(ts) OVER w))::BIGINT AS gap_s, event_id
           FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT digest, nth::INTEGER AS nth, gap_s, event_id FROM e WHERE nth <= 3
"""


def log_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = logged(table(spark, sf_dir, "events"), "SELECT * FROM kind_", F.col("event_type"), " WHERE id = ", F.col("user_id"), keep=("ts",))
    return digest_windows(log, size="1 hour").withColumns({c: F.unix_timestamp(c) for c in ("start", "end")})


_WINDOWS_SQL = f"SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT + 3600 AS \"end\", {_EVENT_HASH} AS digest, {_EVENT_TEXT} AS digest_text, count(*) AS n FROM events GROUP BY ALL"


def log_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = logged(table(spark, sf_dir, "events"), "SELECT * FROM kind_", F.col("event_type"), keep=("ts",))
    return digest_sessions(log, gap="10 minutes").groupBy("n").agg(F.count(F.lit(1)).alias("sessions"))


_SESSIONS_SQL = """
WITH a AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
b AS (SELECT event_type, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a),
c AS (SELECT count(*) AS n FROM b GROUP BY event_type, s)
SELECT n, count(*) AS sessions FROM c GROUP BY n
"""


def log_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements by the sizes of parts and by the hundreds of suppliers' balances, as two logs."""
    a = logged(table(spark, sf_dir, "part"), "SELECT 1 FROM t", F.col("p_size"))
    b = logged(table(spark, sf_dir, "supplier"), "SELECT 2 FROM t", F.floor(F.abs("s_acctbal") / 100))
    return op.compare_logs(op.with_digest(a), op.with_digest(b))


_CHANGES_SQL = f"""
WITH a AS (SELECT DISTINCT 't' || p_size AS k FROM part), b AS (SELECT DISTINCT 't' || floor(abs(s_acctbal) / 100)::BIGINT AS k FROM supplier),
c AS (SELECT 'gone' AS change, k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'new', k FROM (SELECT k FROM b EXCEPT SELECT k FROM a))
SELECT {_named_hash(["SELECT", VALUE, "FROM"], "k", [])} AS digest, change FROM c
"""


def log_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = op.with_digest(logged(table(spark, sf_dir, "lineitem"), "SELECT 1 FROM t", F.col("l_linenumber")))
    known = op.with_digest(logged(spark.range(3), "SELECT 2 FROM t", F.col("id")))
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    return count(op.known_digests(log, known), "known").union(count(op.unknown_digests(log, known), "unknown"))


_KNOWN_SQL = "SELECT CASE WHEN l_linenumber < 3 THEN 'known' ELSE 'unknown' END AS what, count(*) AS n FROM lineitem GROUP BY 1"


def hostile_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose and raw web pages as statements: every row has a digest in every version."""
    rows = table(spark, sf_dir, "documents").select(F.col("text").alias("sql")).union(table(spark, sf_dir, "pages").select("html"))
    rows = dealt(rows).select(fn.statement_digest_hashes("sql", v.VERSIONS).alias("hashes"))
    ok = [(F.length(F.col("hashes")[i]) == (32 if version == "5.7" else 64)).alias(f"ok_{version.replace('.', '_')}") for i, version in enumerate(v.VERSIONS)]
    return rows.groupBy(*ok).agg(F.count(F.lit(1)).alias("n"))


_HOSTILE_SQL = "SELECT true AS ok_8_0, true AS ok_8_4, true AS ok_9_0, true AS ok_5_7, (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) AS n"


def _hostile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id, x): prose, raw web pages, and names about as long as a name's length can tell."""
    rows = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("x"))
    pages = table(spark, sf_dir, "pages").select(F.lit("page"), F.col("page_id"), F.col("html"))
    return rows.union(pages).union(table(spark, sf_dir, "region").select(F.lit("long"), F.col("r_regionkey"), F.expr("repeat('n', cast(65533 + r_regionkey as int))")))


_HOSTILE_ROWS = "SELECT 'document' AS kind, doc_id AS id, text AS x FROM documents UNION ALL SELECT 'page', page_id, html FROM pages UNION ALL SELECT 'long', r_regionkey, repeat('n', 65533 + r_regionkey) FROM region"


def hostile_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as names, strings and comments of statements; whatever a text holds, only a name shows in the digest."""
    df = dealt(_hostile(spark, sf_dir).where("x is not null"))
    name, string = F.replace("x", F.lit("`"), F.lit("``")), F.replace(F.replace("x", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    sql = F.concat(F.lit("SELECT `"), name, F.lit("` /* "), F.replace("x", F.lit("*/"), F.lit("")), F.lit("*/, '"), string, F.lit("'"))
    out = op.with_digest(df.select("kind", "id", F.sha2("x", 256).alias("of"), sql.alias("sql")))
    return out.select("kind", "id", "digest", F.sha2("digest_text", 256).alias("text_sha256"), F.col("digest_error").isNotNull().alias("failed"))


_QUOTED_SQL = f"""
SELECT kind, id, {_named_hash(["SELECT"], "x", [",", VALUE])} AS digest, sha256('SELECT `' || replace(x, '`', '``') || '` , ?') AS text_sha256, false AS failed FROM ({_HOSTILE_ROWS}) WHERE x IS NOT NULL
"""

_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "digest_point_select": (digest_point_select, _POINT_SQL),
    "digest_distinct_first": (digest_distinct_first, _POINT_SQL),
    "digest_in_list": (digest_in_list, _IN_SQL),
    "digest_multi_insert": (digest_multi_insert, _INSERT_SQL),
    "digest_neg_literal": (digest_neg_literal, _NEG_SQL),
    "digest_string_literal": (digest_string_literal, _STRING_SQL),
    "digest_null_rule": (digest_null_rule, _NULL_SQL),
    "digest_cases": (digest_cases, _CASES_SQL),
    "digest_synonyms": (digest_synonyms, _SYNONYMS_SQL),
    "lex_errors": (lex_errors, _FAULTS_SQL),
    "sql_modes": (sql_modes, _MODES_SQL),
    "max_length": (max_length, _LENGTH_SQL),
    "integer_class": (integer_class, _INTEGER_SQL),
    "ident_quote": (ident_quote, _QUOTE_SQL),
    "keyword_lookup": (keyword_lookup, _LOOKUP_SQL),
    "keyword_counts": (keyword_counts, "SELECT * FROM (VALUES ('8.0', 812::BIGINT), ('8.4', 821), ('9.0', 846), ('5.7', 681)) t(version, n)"),
    "tokens": (tokens, _TOKENS_SQL),
    "prepared_tokens": (prepared_tokens, _PREPARED_SQL),
    "sql_functions": (sql_functions, _FUNCTIONS_SQL),
    "sql_function_errors": (sql_function_errors, _ERRORS_SQL),
    "sink_forms": (sink_forms, _SINK_SQL),
    "sink_files": (sink_files, _FILES_SQL),
    "source_files": (source_files, _SOURCE_SQL),
    "cli_runs": (cli_runs, _RUNS_SQL),
    "goldens_80": (goldens_80, _GOLDENS_SQL[0]),
    "goldens_57": (goldens_57, _GOLDENS_SQL[1]),
    "log_top_digests": (log_top_digests, _TOP_SQL),
    "log_summary": (log_summary, _SUMMARY_SQL),
    "log_first_seen": (log_first_seen, _FIRST_SQL),
    "log_numbered": (log_numbered, _NUMBERED_SQL),
    "log_windows": (log_windows, _WINDOWS_SQL),
    "log_sessions": (log_sessions, _SESSIONS_SQL),
    "log_changes": (log_changes, _CHANGES_SQL),
    "log_known": (log_known, _KNOWN_SQL),
    "hostile_input": (hostile_input, _HOSTILE_SQL),
    "hostile_quoted": (hostile_quoted, _QUOTED_SQL),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items()}
