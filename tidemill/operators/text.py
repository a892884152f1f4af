"""Text metrics over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed list of the words that are counted by default.
TARGETS = ["ahab", "captain", "harpoon"]


def tokens(lines: DataFrame, column: str = "value") -> DataFrame:
    """``word``: maximal runs of a-z of the lower-cased text, one row each."""
    return lines.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit("[a-z]+"), F.lit(0))).alias("word"))


def word_count(lines: DataFrame, column: str = "value", accept: Column | None = None) -> DataFrame:
    """Occurrences of each accepted word, summed before and after the shuffle."""
    words = tokens(lines, column)
    return (words if accept is None else words.filter(accept)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def target_words(lines: DataFrame, targets: list[str] = TARGETS, column: str = "value") -> DataFrame:
    return word_count(lines, column, F.col("word").isin(targets))


def distinct_by_length_and_last(lines: DataFrame, column: str = "value") -> DataFrame:
    """Exact number of distinct words for each ``length,last letter``.

    The key is a function of the word, so words are made distinct first and the second count has few keys.
    """
    distinct = tokens(lines, column).distinct()
    key = F.concat_ws(",", F.length("word").cast("string"), F.right("word", F.lit(1)))
    return distinct.groupBy(key.alias("len_last")).agg(F.count(F.lit(1)).alias("n"))
