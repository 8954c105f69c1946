"""Sources of statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space by Unicode, as it is trimmed around a statement.
_SPACE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


class NoStatement(ValueError):
    """There is nothing to digest."""

    def __init__(self) -> None:
        super().__init__("no SQL input provided")


def trimmed(sql: Column | str) -> Column:
    """A statement without the white space around it."""
    s = F.col(sql) if isinstance(sql, str) else sql
    return F.btrim(s, F.lit(_SPACE))


def from_text(spark: SparkSession, *statements: str) -> DataFrame:
    """One row (sql) for each statement."""
    return spark.createDataFrame([(s,) for s in statements], "sql string")


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """One row (sql) for each file: a whole file is one statement, trimmed; files without one have no row."""
    return spark.read.text(path, wholetext=True).select(trimmed("value").alias("sql")).where("sql <> ''")


def choose_statement(sql: str = "", path: str = "", positional: str | None = None, stdin: Callable[[], str] | None = None) -> str:
    """The statement of the first source that is given, trimmed: option, file, argument, standard input."""
    if sql:
        text = sql
    elif path:
        with open(path, "rb") as f:
            text = f.read().decode("utf-8", "surrogateescape")
    elif positional is not None:
        text = positional
    else:
        text = stdin() if stdin else ""
    text = text.strip(_SPACE)
    if not text:
        raise NoStatement
    return text
