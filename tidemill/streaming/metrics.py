"""The text and average operators over streams: same rows, kept up to date (Structured Streaming, no new semantics)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from tidemill.operators import averages, text


def line_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def word_count_stream(lines: DataFrame) -> DataFrame:
    """Running counts; the state holds one row per distinct word."""
    return text.word_count(lines)


def average_stream(readings: DataFrame, keys: list[str], value: str) -> DataFrame:
    return averages.average(readings, keys, value)


def to_table(counts: DataFrame, name: str, checkpoint: str) -> DataStreamWriter:
    """Writer of the whole result after each batch to an in-memory table; ``checkpoint`` must be a shared folder."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
