"""Report sinks: Markdown, JSON documents, and CSV that spreadsheets open safely."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_cell


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A table of at most ``limit`` rows; reports are small, and a larger one is an error."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in found]) + "\n"


def write_json(path: str, value: object) -> None:
    """Exclusive: fails if the file exists; nan is refused."""
    text = json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False)
    with Path(path).open("x", encoding="utf-8") as out:
        out.write(text + "\n")


def replace_text(path: str, text: str) -> None:
    """Atomic: a temporary file in the same folder, synced and renamed."""
    at = Path(path)
    tmp = at.with_name(f".{at.name}.{os.getpid()}")
    with tmp.open("w", encoding="utf-8") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    tmp.replace(at)


def csv_lines(rows: DataFrame) -> DataFrame:
    """One ``line`` for each row: quoted cells, semicolons, no formulas."""
    return rows.select(F.concat_ws(";", *(csv_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns)).alias("line"))
