"""Column functions: digests and tokens by Arrow batches, everything else by built-in expressions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from foldline.functions import engine
from foldline.functions import vocabulary as v
from foldline.functions.lexer import Lexer

#: Statements that a worker remembers with their digests, and how many bytes the longest of them has.
REMEMBERED, REMEMBERED_BYTES = 20_000, 2_000
#: How many bytes all of them have, each with what is kept of its digest.
REMEMBERED_TOTAL = 16 << 20


@dataclass(frozen=True)
class Options:
    """How statements are read: server version, two modes, and how many bytes of text a digest shows (0: all)."""

    version: str = "8.0"
    ansi_quotes: bool = False
    no_backslash_escapes: bool = False
    max_length: int = 0

    def __post_init__(self) -> None:
        if self.version not in v.KEYWORDS:
            raise ValueError(f"unknown version {self.version!r}; there are {', '.join(v.VERSIONS)}")


_NAME = r"A-Za-z0-9_$\x80-\x{10FFFF}"
_SINGLE = {False: r"'(?:[^'\\\x00]++|''|\\[^\x00])*+'", True: r"'(?:[^'\x00]++|'')*+'"}
#: A number that no name, dot, at sign or quote touches, and that is no exponent.
_LONE_NUMBER = rf"(?<![{_NAME}.@'\x22`])(?<![0-9.][eE][+-])[0-9]++(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+(?![{_NAME}.])"


def _quoted(plain_backslash: bool, ansi_quotes: bool) -> str:
    """Strings before which no name stands, as a letter there may change what they are, nor another string."""
    single = _SINGLE[plain_backslash]
    either = single if ansi_quotes else f"(?:{single}|{single.replace(chr(39), chr(92) + 'x22')})"
    return f"(?<![{_NAME}'\\x22]){either}"


def without_literals(sql: Column | str, options: Options = Options()) -> Column:  # noqa: B008
    """A statement with the same digest in which numbers are 0 and strings 's', as far as that is sure; JVM-side.

    Statements that differ in literals only become one, which is then read once. A statement is left alone as a whole
    if it has comments, hints, names in quotes, dollar signs, control characters, or a quote that opens a string only in
    part: there a digit may be no number, or reading may end in an error that tells where. Patterns are possessive.
    """
    s = F.col(sql) if isinstance(sql, str) else sql
    s = s.cast("string")
    text = _quoted(options.no_backslash_escapes, options.ansi_quotes)
    # What is not valid UTF-8 shows as U+FFFD here and must stay what it is.
    plain = rf"\A(?:[A-Za-z0-9_\x80-\x{{FFFC}}\x{{FFFE}}-\x{{10FFFF}} \t\n\r\x0b\f.,()=<>+*%;&|^~!:?@\[\]{{}}]++|-(?!-)|/(?!\*)|{text})*+\z"
    return F.when(s.rlike(plain), F.regexp_replace(F.regexp_replace(s, text, "'s'"), _LONE_NUMBER, "0")).otherwise(s)


_FAULT = "struct<position:int,message:string,input:binary>"
_RAW = f"struct<hash:string,text:binary,fault:{_FAULT}>"
_RAW_ARROW = pa.struct([("hash", pa.string()), ("text", pa.binary()), ("fault", pa.struct([("position", pa.int32()), ("message", pa.string()), ("input", pa.binary())]))])


class _Remembered(dict):
    """Digests of statements, as rows; and of their tokens, for statements that differ in comments and the like."""

    def __init__(self, options: Options) -> None:
        super().__init__()
        self.options = options
        self.of_tokens: dict[tuple, tuple[str, bytes]] = {}
        self.held = 0

    def __missing__(self, sql: bytes) -> dict:
        o = self.options
        chars, names, lexer = engine.scan(sql, o.version, o.ansi_quotes, o.no_backslash_escapes)
        key = (chars, lexer.aborted, *names)
        done = self.of_tokens.get(key) or engine.finish(chars, names, not lexer.aborted, o.version, o.max_length)
        f = lexer.fault
        out = {"hash": done[0], "text": done[1], "fault": f and {"position": f.position, "message": f.message, "input": f.input}}
        if len(sql) <= REMEMBERED_BYTES:
            size = len(sql) + len(done[1]) + 2 * len(chars) + sum(map(len, names)) + 40 * len(names)
            if len(self) >= REMEMBERED or self.held + size > REMEMBERED_TOTAL:
                self.clear()
                self.of_tokens.clear()
                self.held = 0
            self.held += size
            self[sql], self.of_tokens[key] = out, done
        return out


#: Bytes of statements that a worker takes out of an Arrow batch at a time.
SLICE_BYTES = 4 << 20


def _slices(values: pa.Array) -> Iterator[pa.Array]:
    """A column of bytes in parts of at most SLICE_BYTES, or of one value."""
    sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held + n > SLICE_BYTES and i > start:
            yield values.slice(start, i - start)
            start, held = i, 0
        held += n
    yield values.slice(start)


def _by_distinct(values: pa.Array, one: Callable[[bytes], object], kind: pa.DataType) -> pa.Array:
    """``one`` of each distinct value of a column, at the places of that value; null stays null. A slice at a time."""
    out = []
    for part in _slices(values.cast(pa.binary())):
        coded = part.dictionary_encode()
        out.append(pa.array([one(x) for x in coded.dictionary.to_pylist()], kind).take(coded.indices))
    return pa.concat_arrays(out)


def _digest_udf(options: Options):
    known = _Remembered(options)

    @F.arrow_udf(_RAW)
    def digest(sql: pa.Array) -> pa.Array:
        return _by_distinct(sql, known.__getitem__, _RAW_ARROW)

    return digest


def statement_digest(sql: Column | str, options: Options = Options()) -> Column:  # noqa: B008
    """struct(hash, text, error) of a statement; error is null, or a struct(position, message, input).

    A statement that cannot be read to its end has the digest of what was read, and the error. Null gives null. Lengths
    and positions count bytes; a text that is cut within a character is not valid UTF-8, as the rule asks for. Literals
    go JVM-side where that is safe, and each distinct statement of a batch is read once.
    """
    raw = _digest_udf(options)(without_literals(sql, options).cast("binary"))
    fault = raw["fault"]
    error = F.when(fault.isNotNull(), F.struct(fault["position"].alias("position"), fault["message"].alias("message"), fault["input"].cast("string").alias("input")))
    return F.when(raw.isNotNull(), F.struct(raw["hash"].alias("hash"), raw["text"].cast("string").alias("text"), error.alias("error")))


def statement_digest_text(sql: Column | str, options: Options = Options()) -> Column:  # noqa: B008
    return statement_digest(sql, options)["text"]


def statement_digest_hash(sql: Column | str, options: Options = Options()) -> Column:  # noqa: B008
    return statement_digest(sql, options)["hash"]


def statement_digest_hashes(sql: Column | str, versions: tuple[str, ...] = v.VERSIONS) -> Column:
    """array of a statement's hashes in each version, in the default modes. Null gives null.

    A statement is read once for all versions unless it has version comments or hints, which are read by version. For logs
    of long texts that don't repeat: nothing is remembered from batch to batch, and literals stay where they are.
    """
    if unknown := [x for x in versions if x not in v.KEYWORDS]:
        raise ValueError(f"unknown version {unknown[0]!r}; there are {', '.join(v.VERSIONS)}")
    col, kind = F.col(sql) if isinstance(sql, str) else sql, pa.list_(pa.string())

    @F.arrow_udf("array<string>")
    def hashes(x: pa.Array) -> pa.Array:
        return _by_distinct(x, lambda s: engine.hashes(s, versions), kind)

    return hashes(col.cast("binary"))


_TOKENS = pa.list_(pa.struct([("type", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.binary())]))


def statement_tokens(sql: Column | str, options: Options = Options(), prepared: bool = False) -> Column:  # noqa: B008
    """array of (type, start, end, text): a statement's tokens as they are read, before anything is folded."""
    col = F.col(sql) if isinstance(sql, str) else sql

    def one(x: bytes) -> list[dict]:
        lexer = Lexer(x, options.version, options.ansi_quotes, options.no_backslash_escapes, prepared)
        return [{"type": t.type, "start": t.start, "end": t.end, "text": x[t.start : t.end]} for t in lexer.tokens()]

    @F.arrow_udf("array<struct<type:int,start:int,end:int,text:binary>>")
    def tokens(x: pa.Array) -> pa.Array:
        return pa.array([None if s is None else one(s) for s in x.to_pylist()], _TOKENS)

    return F.transform(tokens(col.cast("binary")), lambda t: F.struct(t["type"].alias("type"), t["start"].alias("start"), t["end"].alias("end"), t["text"].cast("string").alias("text")))


def classify_integer(digits: Column | str) -> Column:
    """The literal class of an integer by its size: NUM, LONG_NUM, ULONGLONG_NUM or DECIMAL_NUM; a sign may lead."""
    s = F.col(digits) if isinstance(digits, str) else digits
    body = F.regexp_replace(s, r"^[+-]?0*", "")
    n, negative = F.octet_length(body), s.startswith("-")

    def fits(positive: str, minus: str) -> Column:
        return body <= F.when(negative, minus).otherwise(positive)

    return (
        F.when((F.octet_length(s) < 10) | (n < 10), "NUM")
        .when(n == 10, F.when(fits("2147483647", "2147483648"), "NUM").otherwise("LONG_NUM"))
        .when(n < 19, "LONG_NUM")
        .when(n == 19, F.when(fits("9223372036854775807", "9223372036854775808"), "LONG_NUM").when(negative, "DECIMAL_NUM").otherwise("ULONGLONG_NUM"))
        .when(negative | (n > 20) | (body > "18446744073709551615"), "DECIMAL_NUM")
        .otherwise("ULONGLONG_NUM")
    )


def quote_identifier(name: Column | str) -> Column:
    """A name in backticks, those inside doubled."""
    s = F.col(name) if isinstance(name, str) else name
    return F.concat(F.lit("`"), F.replace(s, F.lit("`"), F.lit("``")), F.lit("`"))


def unquote_identifier(name: Column | str) -> Column:
    """A name without the backticks or double quotes around it, doubled ones inside made single."""
    s = F.col(name) if isinstance(name, str) else name
    inner = s.substr(F.lit(2), F.length(s) - 2)

    def wrapped(q: str) -> Column:
        return (F.length(s) >= 2) & s.startswith(q) & s.endswith(q)

    return F.when(wrapped("`"), F.replace(inner, F.lit("``"), F.lit("`"))).when(wrapped('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(s)


def truncate_bytes(text: Column | str, most: int) -> Column:
    """At most so many bytes of a text, with three dots after a cut; 0 or less leaves it whole."""
    s = F.col(text) if isinstance(text, str) else text
    if most <= 0:
        return s
    cut = F.substring(s.cast("binary"), 1, most).cast("string")
    return F.when(F.octet_length(s) > most, F.concat(cut, F.lit("..."))).otherwise(s)


def register(spark: SparkSession, options: Options = Options()) -> None:  # noqa: B008
    """SQL functions on a statement and, where it is given, a server version:

    statement_digest_all, a struct (hash, text, json, error) from one reading; statement_digest, which is its hash;
    statement_digest_text; statement_digest_json; and the table function tokenize_sql(sql). A version that is not known
    reads as the options' own.
    """
    kept: dict[str, _Remembered] = {}

    def read(sql: bytes, version: str | None) -> dict:
        version = version if version in v.KEYWORDS else options.version
        if version not in kept:
            kept[version] = _Remembered(replace(options, version=version))
        raw = kept[version][sql]
        text, f = raw["text"].decode("utf-8", "replace"), raw["fault"]
        error = engine.fault_text(engine.LexFault(f["position"], f["message"], f["input"])) if f else None
        said = {"error": error} if error else {"text": text, "hash": raw["hash"]}
        return {"hash": raw["hash"], "text": text, "error": error, "json": escape_html(json.dumps(said, ensure_ascii=False, separators=(",", ":")))}

    def udf(name: str, returns: str, kind: pa.DataType, of: Callable[[dict], object]) -> None:
        @F.arrow_udf(returns)
        def one(*args: pa.Array) -> pa.Array:
            if len(args) == 1:
                return _by_distinct(args[0], lambda x: of(read(x, None)), kind)
            rows = zip(args[0].cast(pa.binary()).to_pylist(), args[1].to_pylist(), strict=True)
            return pa.array([None if x is None else of(read(x, version)) for x, version in rows], kind)

        spark.udf.register(name, one)

    fields = ("hash", "text", "json", "error")
    udf("statement_digest_all", ", ".join(f"{f} string" for f in fields), pa.struct([(f, pa.string()) for f in fields]), lambda d: d)
    for name, field in (("statement_digest", "hash"), ("statement_digest_text", "text"), ("statement_digest_json", "json")):
        udf(name, "string", pa.string(), lambda d, field=field: d[field])

    @F.udtf(returnType="type int, start int, end int, text string")
    class TokenizeSql:
        def eval(self, sql: str):
            if sql is not None:
                data = sql.encode()
                for t in Lexer(data, options.version, options.ansi_quotes, options.no_backslash_escapes).tokens():
                    yield t.type, t.start, t.end, data[t.start : t.end].decode("utf-8", "replace")

    spark.udtf.register("tokenize_sql", TokenizeSql)


def escape_html(encoded: str) -> str:
    """JSON with the three characters that must not stand in a page, and the two line separators, as escapes."""
    for c in ("<", ">", "&", chr(0x2028), chr(0x2029)):
        encoded = encoded.replace(c, f"\\u{ord(c):04x}")
    return encoded
