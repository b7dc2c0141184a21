"""Markdown and JSON sinks of small, finished results."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame


def markdown_table(rows: DataFrame, most: int = 100) -> str:
    """The first rows as a table; a report shows at most so many."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join([head, *("| " + " | ".join(map(cell, r)) + " |" for r in rows.limit(most).collect())])


def write_report(path: str, title: str, sections: dict[str, DataFrame], most: int = 100) -> None:
    parts = [f"# {title}", *(f"## {name}\n\n{markdown_table(rows, most)}" for name, rows in sections.items())]
    Path(path).write_text("\n\n".join(parts) + "\n", encoding="utf-8")


def manifest(sources: dict[str, str]) -> str:
    """One line of JSON: done, or partial with the sources that failed."""
    failed = sorted(s for s, status in sources.items() if status not in ("ok", "empty"))
    return json.dumps({"status": "partial" if failed else "done", "failed": failed})
