"""Text sources: lines, naive CSV, capitals, chain TSV and pack listings. All are plain DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.strings import java_trim, strict_int, strict_long

LISTING_FIELDS = (5, 7)
CHAIN_FIELDS = (7, 8, 9, 10)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of a file or directory, in ``value``; hidden names are skipped."""
    return spark.read.text(path)


def split_fields(lines: DataFrame, separator: str, least: int) -> DataFrame:
    """``fields``: the line cut at every separator, without quoting; lines with fewer than ``least`` are dropped."""
    return lines.select(F.split("value", separator, -1).alias("fields")).filter(F.size("fields") >= least)


def trimmed(index: int) -> Column:
    return java_trim(F.col("fields")[index])


def temperatures(spark: SparkSession, folder: str, name: str = "dataset.csv") -> DataFrame:
    """region, state, city, year, temperature of ``<folder>/dataset.csv``; a reading that is none is null."""
    from tidemill.operators.averages import valid_temperature

    rows = split_fields(read_lines(spark, f"{folder}/{name}"), ",", 8)
    return rows.select(
        trimmed(0).alias("region"), trimmed(2).alias("state"), trimmed(3).alias("city"), trimmed(6).alias("year"), valid_temperature(F.col("fields")[7]).alias("temperature")
    )


def indexed_rows(spark: SparkSession, path: str) -> DataFrame:
    """id and the text fields 1, 2, 4 and 5 of rows with ten fields or more and an int id."""
    rows = split_fields(read_lines(spark, path), ",", 10)
    texts = F.array(*[F.lower(F.col("fields")[i]) for i in (1, 2, 4, 5)])
    return rows.select(strict_int(trimmed(0)).alias("id"), texts.alias("texts")).filter(F.col("id").isNotNull())


def capitals(spark: SparkSession, path: str) -> DataFrame:
    """state, capital. The first line that is not blank is a header if it names either column, in any order and case;
    else columns 0 and 1 count. Empty cells are dropped; of repeated states the last in the file wins. The file is a
    side table of one line per state and is read in one piece, so line order is known."""
    lines = spark.read.text(path, wholetext=False).coalesce(1).withColumn("line", F.monotonically_increasing_id())
    shown = lines.filter(java_trim(F.col("value")) != "")
    first = shown.orderBy("line").select("line", F.transform(F.split("value", ",", -1), lambda x: F.lower(java_trim(x))).alias("names")).first()
    names, start = (list(first["names"]), first["line"]) if first else ([], -1)
    header = "state" in names or "capital" in names
    state = names.index("state") if "state" in names else 0
    capital = names.index("capital") if "capital" in names else 1
    rows = shown.filter(F.col("line") > start) if header else shown
    cells = rows.select("line", F.split("value", ",", -1).alias("fields")).filter(F.size("fields") > max(state, capital))
    pairs = cells.select("line", trimmed(state).alias("state"), trimmed(capital).alias("capital")).filter("state <> '' and capital <> ''")
    return pairs.groupBy("state").agg(F.max_by("capital", "line").alias("capital"))


def parse_chain(lines: DataFrame) -> DataFrame:
    """Chain rows of 7 to 10 tab-separated columns, with ``malformed`` for those that are none; empty lines are left out.

    Missing time stamps and origins are 0, a missing payload is null. ``payload64`` is left as text, so that column
    pruning keeps it out of plans that do not need it.
    """
    f = F.col("f")
    width = F.size(f)
    optional = lambda i, least: F.when(width >= least, strict_long(F.get(f, F.lit(i)))).otherwise(F.lit(0).cast("long"))
    raw = lines.filter("value <> ''").select(F.split("value", "\t", -1).alias("f"))
    fits = width.isin(*CHAIN_FIELDS)
    cell = lambda i: F.get(f, F.lit(i))
    number = lambda i: strict_long(cell(i))
    rows = raw.select(
        cell(0).alias("root"), number(1).alias("position"), cell(2).alias("sha"), cell(3).alias("base_sha"), cell(4).alias("type"),
        number(5).alias("size"), cell(5).alias("size_text"), number(6).alias("offset"), F.when(width >= 8, cell(7)).alias("payload64"),
        optional(8, 9).alias("ts"), optional(9, 10).alias("origin"), width.alias("width"), fits.alias("fits"),
    )
    bad = ~F.col("fits") | F.col("position").isNull() | F.col("size").isNull() | F.col("ts").isNull() | F.col("origin").isNull()
    return rows.withColumn("malformed", bad).drop("fits")


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    return parse_chain(read_lines(spark, path))


def parse_listing(lines: DataFrame) -> DataFrame:
    """Object lines of a pack listing: sha, type, size, offset, depth and base_sha (null for whole objects).

    A line that begins with 40 hex digits must have five or seven fields. Repeated ids: the last line counts.
    """
    shown = lines.select(java_trim(F.col("value")).alias("value"), F.monotonically_increasing_id().alias("line")).filter(F.col("value").rlike(r"^[0-9a-fA-F]{40}\s"))
    f = F.split("value", r"\s+")
    checked = F.when(F.size(f).isin(*LISTING_FIELDS), f).otherwise(F.raise_error(F.concat(F.lit("unexpected object line: "), F.col("value"))))
    rows = shown.select("line", checked.alias("f"))
    cell = lambda i: F.get("f", F.lit(i))
    rows = rows.select(
        "line", cell(0).alias("sha"), cell(1).alias("type"), cell(2).cast("long").alias("size"), cell(4).cast("long").alias("offset"),
        cell(5).cast("int").alias("depth"), cell(6).alias("base_sha"),
    )
    last = F.max_by(F.struct("type", "size", "offset", "depth", "base_sha"), "line").alias("x")
    return rows.groupBy("sha").agg(last).select("sha", "x.*")


def listing_summary(lines: DataFrame) -> DataFrame:
    """(depth, objects) as the listing's own summary lines say; depth 0 stands for whole objects."""
    value = java_trim(F.col("value"))
    whole, chain = r"^non delta: (\d+) objects?$", r"^chain length = (\d+): (\d+) objects?$"
    return lines.select(
        F.when(value.rlike(whole), F.struct(F.lit(0).alias("depth"), F.regexp_extract(value, whole, 1).try_cast("long").alias("objects")))
        .when(value.rlike(chain), F.struct(F.regexp_extract(value, chain, 1).try_cast("int").alias("depth"), F.regexp_extract(value, chain, 2).try_cast("long").alias("objects")))
        .alias("s")
    ).filter("s is not null").select("s.*")
