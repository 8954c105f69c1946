"""Sinks for digests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.functions.columns import escape_html


def as_lines(digest: str = "digest", text: str = "digest_text") -> Column:
    """Two lines: the hash, and the text."""
    return F.concat(F.lit("DIGEST: "), F.col(digest), F.lit("\nDIGEST_TEXT: "), F.col(text))


def as_json(digest: str = "digest", text: str = "digest_text") -> Column:
    """A JSON object on one line, with the escapes of HTML's special characters."""
    out = F.to_json(F.struct(F.col(digest).alias("digest"), F.col(text).alias("digest_text")))
    for c in ("<", ">", "&", chr(0x2028), chr(0x2029)):
        out = F.replace(out, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return out


def write_digests(log: DataFrame, path: str, form: str = "lines") -> None:
    """Text files of a digested log: ``lines``, ``json``, ``text`` or ``hash``; rows with an error are left out."""
    col = {"lines": as_lines(), "json": as_json(), "text": F.col("digest_text"), "hash": F.col("digest")}[form]
    log.where(F.col("digest").isNotNull() & F.col("digest_error").isNull()).select(col.alias("value")).write.text(path)


def printed(hash_: str, text: str, form: str = "lines") -> str:
    """What the command prints for one digest."""
    if form == "json":
        return escape_html(json.dumps({"digest": hash_, "digest_text": text}, indent=2, ensure_ascii=False))
    return {"text": text, "hash": hash_}.get(form, f"DIGEST: {hash_}\nDIGEST_TEXT: {text}")
