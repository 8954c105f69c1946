"""Column functions over statements."""

from foldline.functions.columns import (
    Options,
    classify_integer,
    quote_identifier,
    register,
    statement_digest,
    statement_digest_hash,
    statement_digest_hashes,
    statement_digest_text,
    statement_tokens,
    truncate_bytes,
    unquote_identifier,
    without_literals,
)

__all__ = [
    "Options",
    "classify_integer",
    "quote_identifier",
    "register",
    "statement_digest",
    "statement_digest_hash",
    "statement_digest_hashes",
    "statement_digest_text",
    "statement_tokens",
    "truncate_bytes",
    "unquote_identifier",
    "without_literals",
]
