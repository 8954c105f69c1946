"""Personal data: regular expressions propose spans, validators confirm them, nearby words adjust the score.

Everything here is DataFrame expressions: one map over the rows, no shuffle and no Python on the executors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import fresh


@dataclass(frozen=True)
class Kind:
    """``needs``: a text without any of these can hold no span; ``cue``: words before a span that raise its score."""

    name: str
    pattern: str
    needs: tuple[str, ...]
    cue: str
    base: bool = True
    start_score: float = 0.8


# The patterns say the same as their plain forms, but never try a start that cannot match, nor back up: a run of the
# first class is entered only at its start, or where the last match ended (\G).
EMAIL = Kind(
    "email",
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    ("@",),
    r"mail|contact|write|reach",
)
IP = Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", (".",), r"\bip\b|host|server|address|from")
CARD = Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+", (), r"card|visa|credit|payment|pay")
PHONE = Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", ("+",), r"phone|tel|call|mobile|fax")
#: How long account codes are, by country; a code ends there, whatever follows.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_CODES = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in LENGTHS.items())
IBAN = Kind("iban", rf"(?<![A-Za-z0-9])(?:{_CODES})(?![A-Za-z0-9])", (), r"iban|account|bank|konto|compte|cuenta", False, 0.5)
SSN = Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ("-",), r"ssn|social|security", False, 0.5)
KINDS = (EMAIL, IP, CARD, PHONE, IBAN, SSN)

#: What a checksum adds to the score, what a cue word adds, how many characters before a span count as near, and the
#: score from which a span of the added kinds is kept. Spans of the base kinds are kept whatever their score.
CHECKED, CUED, NEAR, KEEP = 0.2, 0.2, 40, 0.7

_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a string of digits passes Luhn."""
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = back.substr(i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """True where an account code, its first four characters moved to the end, is 1 modulo 97."""
    moved = F.concat(code.substr(F.lit(5), F.length(code)), code.substr(F.lit(1), F.lit(4)))

    def add(acc: Column, i: Column) -> Column:
        c = F.ascii(moved.substr(i, F.lit(1)))
        return F.when(c < 58, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _valid(kind: Kind, m: Column) -> Column:
    if kind is IP:
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind is CARD:
        n = F.length(_digits(m))
        return F.when((n >= 13) & (n <= 19), luhn(_digits(m))).otherwise(False)
    if kind is PHONE:
        return F.length(_digits(m)).between(9, 15)
    if kind is IBAN:
        return mod97(F.regexp_replace(m, " ", ""))
    return F.lit(True)


#: Running values are worked out in parts of so many items, and the parts' ends first, so that long arrays aren't copied for each item.
TOGETHER = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Of an array of ints that is not empty, what ``add`` makes of the items up to each, in order, from 0."""
    zero = F.lit(0)

    def parts(x: Column) -> Column:
        return F.transform(F.sequence(zero, F.floor((F.size(x) - 1) / TOGETHER).cast("int")), lambda b: F.slice(x, b * TOGETHER + 1, TOGETHER))

    def run(x: Column, start: Column) -> Column:
        return F.slice(F.aggregate(x, F.array(start), lambda acc, v: F.array_append(acc, add(F.element_at(acc, -1), v))), 2, F.size(x))

    def whole(p: Column) -> Column:
        ends = F.concat(F.array(zero), run(F.transform(p, lambda x: F.aggregate(x, zero, add)), zero))
        return _let(ends, lambda e: F.flatten(F.zip_with(p, F.slice(e, 1, F.size(p)), run)))

    return _let(parts(values), whole)


def _kind_spans(kind: Kind, found: Column, gaps: Column, ends: Column) -> Column:
    """Spans of one kind from its matches, the stretches between them, and where they end."""

    def span(x: Column) -> Column:
        m, gap, end = x["m"], x["g"], x["e"]
        cued = F.lower(F.right(gap, F.lit(NEAR))).rlike(kind.cue)
        checked = kind in (CARD, IBAN)
        score = F.round(F.lit(kind.start_score + (CHECKED if checked else 0.0)) + F.when(cued, CUED).otherwise(0.0), 3)
        keep = _valid(kind, m) if kind.base else _valid(kind, m) & (score >= KEEP)
        return F.when(keep, F.struct(F.lit(kind.name).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score")))

    zipped = F.zip_with(F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g"))), ends, lambda x, e: F.struct(x["m"].alias("m"), x["g"].alias("g"), e.alias("e")))
    spans = F.filter(F.transform(zipped, span), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(_SPAN))


def find_spans(df: DataFrame, text_col: str = "text", out: str = "spans", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``df`` with a column ``out``: array of (kind, start, end, score), by kind as listed in ``kinds``, then start.

    Offsets count code points; the end is exclusive. A null or empty text has no spans. Other columns, whatever their
    names, repeated rows and null keys pass through; a column that is called ``out`` is replaced. Work is linear in the
    text and its spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    empty = F.array().cast("array<string>")
    names = fresh(df, *(f"_{k.name}_{x}" for k in kinds for x in "mge"))
    found, gaps, ends = (dict(zip(kinds, names[i::3], strict=True)) for i in range(3))
    stage: dict[str, Column] = {}
    for k in kinds:
        # What a span needs at the least, by tests that are far cheaper than its pattern.
        may = [F.contains(text, F.lit(x)) for x in k.needs] or [text.rlike({"card": r"[0-9](?:[\x20-]?[0-9]){12}", "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"}[k.name])]
        stage[found[k]] = F.when(may[0], F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(empty)
    df = df.withColumns(stage)
    df = df.withColumns({gaps[k]: F.when(F.size(found[k]) > 0, F.split(text, k.pattern, -1)).otherwise(empty) for k in kinds})
    lengths = {k: F.zip_with(F.col(found[k]), F.slice(gaps[k], 1, F.size(found[k])), lambda m, g: F.length(m) + F.length(g)) for k in kinds}
    df = df.withColumns({ends[k]: F.when(F.size(found[k]) > 0, _running(lengths[k], lambda a, b: a + b)).otherwise(F.array().cast("array<int>")) for k in kinds})
    return df.withColumn(out, F.concat(*(_kind_spans(k, F.col(found[k]), F.col(gaps[k]), F.col(ends[k])) for k in kinds))).drop(*names)


def redact(df: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``df`` with each span of the text replaced by its kind in brackets; overlapping spans become the first of them.

    A null text stays null. Other columns may have any names.
    """
    text = F.col(text_col)

    def by_start(a: Column, b: Column) -> Column:
        return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])

    spans, ends = fresh(df, "_spans", "_ends")
    found = find_spans(df, text_col, spans, kinds)
    found = found.withColumn(spans, F.array_sort(spans, by_start))
    # Up to where the text is used up after each span.
    found = found.withColumn(ends, F.when(F.size(spans) > 0, _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))))

    def put(s: Column, at: Column) -> Column:
        return F.when(s["start"] >= at, F.concat(text.substr(at + 1, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]")))

    said = F.zip_with(spans, F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(spans) - 1)), put)
    rest = text.substr(F.element_at(ends, -1) + 1, F.length(text))
    return found.withColumn(text_col, F.when(F.col(ends).isNull(), text).otherwise(F.concat(F.array_join(said, ""), rest))).drop(ends, spans)


def pii_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: counts of the base kinds, a digest of the base spans, and all spans as text."""

    def said(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def n(kind: Kind) -> Column:
        return F.size(F.filter("_spans", lambda s: s["kind"] == kind.name)).cast("long").alias(f"n_{kind.name}")

    base = [k for k in KINDS if k.base]
    found = find_spans(df.select(F.col(id_col), F.col(text_col).alias("_text")), "_text", "_spans")
    of_base = F.filter("_spans", lambda s: s["kind"].isin([k.name for k in base]))
    return found.select(
        id_col,
        *(n(k) for k in base),
        F.sha2(said(of_base), 256).alias("base_sha256"),
        said(F.col("_spans")).alias("spans"),
        F.array_join(F.transform("_spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
