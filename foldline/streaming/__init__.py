"""Digests on streams."""

from foldline.streaming.windows import digest_sessions, digest_windows

__all__ = ["digest_sessions", "digest_windows"]
