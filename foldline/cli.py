"""Command line: ``python -m foldline.cli --sql "SELECT 1"``; a single statement needs no Spark."""

from __future__ import annotations

import argparse
import sys

from foldline.functions import engine
from foldline.sources.readers import NoStatement, choose_statement
from foldline.sources.writers import printed


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="foldline", description="Digest of a SQL statement.")
    p.add_argument("statement", nargs="?")
    p.add_argument("--sql", default="", help="the statement")
    p.add_argument("-f", "--file", default="", help="a file that holds the statement")
    p.add_argument("--json", action="store_true", help="print JSON")
    p.add_argument("--text-only", action="store_true", help="print the text only")
    p.add_argument("--hash-only", action="store_true", help="print the hash only")
    a = p.parse_args(args)
    piped = None if sys.stdin is None or sys.stdin.isatty() else sys.stdin.read
    try:
        sql = choose_statement(a.sql, a.file, a.statement, piped).encode("utf-8", "surrogateescape")
    except (NoStatement, OSError) as e:
        print(f"Error: {e if isinstance(e, NoStatement) else f'reading file: {e}'}", file=sys.stderr)
        return 1
    d = engine.compute(sql)
    if d.fault:
        print(f"Error: computing digest: {engine.fault_text(d.fault)}", file=sys.stderr)
        return 1
    form = "json" if a.json else "text" if a.text_only else "hash" if a.hash_only else "lines"
    print(printed(d.hash, d.text.decode("utf-8", "replace"), form))
    return 0


if __name__ == "__main__":
    sys.exit(main())
