"""Inverted indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_WORD = 12


def postings(rows: DataFrame, id_col: str = "id", texts: str = "texts") -> DataFrame:
    """Distinct (word, id); ``texts`` is an array of strings or one string."""
    kind = dict(rows.dtypes)[texts]
    text = F.explode(texts) if kind.startswith("array") else F.col(texts)
    each = rows.select(F.col(id_col).alias("id"), text.alias("text"))
    words = each.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.select("word", "id").distinct()


def inverted_index(rows: DataFrame, id_col: str = "id", texts: str = "texts") -> DataFrame:
    """word, ids (ascending, distinct)."""
    return postings(rows, id_col, texts).groupBy("word").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def rendered(index: DataFrame) -> DataFrame:
    """The index with its lists as ``1, 2, 3``."""
    return index.select("word", F.array_join(F.col("ids").cast("array<string>"), ", ").alias("ids"))


def read_rendered(lines: DataFrame) -> DataFrame:
    """word, ids of ``word<TAB>1, 2`` lines; lines without a tab are dropped."""
    at = F.instr("value", "\t")
    rest = F.substring(F.col("value"), at + 1, F.length("value"))
    return lines.filter(at > 0).select(F.substring_index("value", "\t", 1).alias("word"), F.split(rest, r",\s*").cast("array<int>").alias("ids"))


def longest_list_word(found: DataFrame, least: int = LONG_WORD) -> DataFrame:
    """The word of at least ``least`` letters with most ids, the smallest word on ties; from postings, so that no list
    is built: the count is summed before the shuffle and the top is kept by each task."""
    long = found.filter(F.length("word") >= least)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(1)
