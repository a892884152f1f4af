"""Exact deduplication by a 128-bit content hash with a byte comparison inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.runtime import durable, keep_rows, maybe_member, table, text_key

WHITE_SPACE = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def content_hash(norm: Column) -> Column:
    """MD5: 128 bits."""
    return F.unhex(F.md5(norm))


def collided_hashes(docs: DataFrame, base: DataFrame, text_col: str, hashed: Callable[[Column], Column]) -> DataFrame:
    """Hashes whose group holds different bytes.

    Only rows of hashes that occur more than once are compared. A bitmap of their texts' keys preselects them, so single
    texts are neither normalised again nor moved. The smallest and largest text of a group are equal only if all are; both
    are partial aggregates, so a hot group reaches the shuffle as one row for each task.
    """
    shared = base.groupBy("digest").count().filter("count > 1").select("digest")
    keys = durable(base.join(shared, "digest", "left_semi").select("text_key").distinct())
    texts = docs.select(text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    candidates = maybe_member(texts, keys, "text_key").filter("maybe_").select(normalised(F.col("text")).alias("norm"))
    compared = candidates.withColumn("digest", hashed(F.col("norm"))).groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    return compared.filter(F.col("low") != F.col("high")).select("digest")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of ``docs``: its group of equal texts and the row of the group that stays.

    Texts are equal when identical after deleting ASCII white space. The row with the most code points in the
    original text stays, then the smallest id (a null id comes last), then the first of fully repeated rows:
    exactly one row of a group is kept. A null text counts as empty; an empty table gives no rows; other columns
    are ignored. Columns: id, keep_id, group_size, kept, text_sha256, text_key.
    """
    norm = normalised(F.col(text_col))
    base = durable(
        docs.select(
            F.col(id_col).alias("id"),
            F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"),
            text_key(text_col).alias("text_key"),
            norm.alias("norm"),
        )
        .withColumn("digest", hashed(F.col("norm")))
        .withColumn("sha", F.unhex(F.sha2("norm", 256)))
        .withColumn("row", F.monotonically_increasing_id())
        .drop("norm")
    )
    collided = durable(collided_hashes(docs, base, text_col, hashed))
    if collided.isEmpty():
        keyed = base.withColumn("part", F.lit(None).cast("binary"))
    else:  # different bytes under one hash: their SHA-256 tells them apart
        keyed = base.join(collided.withColumn("mixed", F.lit(True)), "digest", "left").withColumn("part", F.when(F.col("mixed"), F.col("sha")))
    rank = F.struct(-F.col("points"), F.col("id").isNull(), F.col("id"), F.col("row"))
    groups = keyed.groupBy("digest", "part").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("best")).filter("group_size > 1")
    right = groups.select(F.col("digest").alias("g_digest"), F.col("part").alias("g_part"), "group_size", "best")
    joined = keyed.join(right, (keyed["digest"] == right["g_digest"]) & keyed["part"].eqNullSafe(right["g_part"]), "left")
    single = F.col("best").isNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "text_key",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` does not keep."""
    return keep_rows(docs, exact_dedup(docs, id_col, text_col), "kept", id_col, text_col)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("text_key")


ORACLE = {
    "op10_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, length(coalesce(text, '')) AS points,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
          FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id) = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM n
    """,
}
