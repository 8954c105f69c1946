"""Where statements come from and where digests go."""

from foldline.sources.readers import NoStatement, choose_statement, from_files, from_text, trimmed
from foldline.sources.writers import as_json, as_lines, write_digests

__all__ = ["NoStatement", "as_json", "as_lines", "choose_statement", "from_files", "from_text", "trimmed", "write_digests"]
