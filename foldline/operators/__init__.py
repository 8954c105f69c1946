"""Operators over query logs."""

from foldline.operators.digests import digest_statements, summarize_statements, with_digest
from foldline.operators.logs import compare_logs, first_seen, known_digests, numbered, summarize, top_digests, unknown_digests

__all__ = ["compare_logs", "digest_statements", "first_seen", "known_digests", "numbered", "summarize", "summarize_statements", "top_digests", "unknown_digests", "with_digest"]
