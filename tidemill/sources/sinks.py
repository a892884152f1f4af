"""Text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, sorted_by: list[str] | None = None) -> None:
    """Columns joined by tabs, one line a row; the folder must not exist. With ``sorted_by``, one file in that order."""
    if sorted_by:
        df = df.coalesce(1).sortWithinPartitions(*sorted_by)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat_ws("\t", *cells).alias("value")).write.mode("errorifexists").text(path)


def counter_lines(counters: DataFrame) -> list[str]:
    """``COUNTER <name> <value>`` for a frame of one row."""
    row = counters.first()
    return [f"COUNTER {name} {row[name]}" for name in counters.columns]
