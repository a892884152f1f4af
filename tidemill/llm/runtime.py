"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A bitmap that preselects rows before a text shuffle has BITMAP_SPARSE bits for each key, 2**BITMAP_MOST bits (64 MiB) at most,
#: and is kept in rows of 2**BITMAP_ROW bits.
BITMAP_SPARSE = 16
BITMAP_MOST = 29
BITMAP_ROW = 15
#: Seconds between two collections that let Spark remove files of rounds that are over.
RELEASE_S = 4.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names; on one machine (tests) a temporary one will do."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemill-checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the folder the session names."""
    shared_folder(df.sparkSession)
    kept = df.checkpoint(eager=True)
    release(df.sparkSession)
    return kept


def release(spark: SparkSession) -> None:
    """Has the driver's JVM collect garbage, every RELEASE_S seconds at most: Spark removes shuffle files (and, if so configured,
    checkpoints) only after what refers to them is collected, and a job of many small rounds piles them up before the heap fills."""
    context = spark.sparkContext
    if time.monotonic() - getattr(context, "_tidemill_released", 0.0) >= RELEASE_S:
        context._jvm.System.gc()
        context._tidemill_released = time.monotonic()


def whole_rows(df: DataFrame) -> DataFrame:
    """All columns in one struct ``row_``, so that names an operator adds cannot clash with any of them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row_"))


def text_key(column: Column | str) -> Column:
    """Identity of a row's original text beside its id (null and empty differ)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(column))


def maybe_member(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` with ``maybe_``: true for every row whose ``key`` is among ``keys`` (one distinct column of that name), false for
    nearly all others.

    The keys are counted first and hashed into a bitmap sized for them, which is broadcast. Where that would be larger than
    2**BITMAP_MOST bits nothing is broadcast: ``maybe_`` is then true everywhere, and a join must do the whole work.
    """
    count = keys.count()
    bits = max(BITMAP_ROW, (count * BITMAP_SPARSE).bit_length())
    if bits > BITMAP_MOST:
        return df.withColumn("maybe_", F.lit(True))
    low = F.lit((1 << BITMAP_ROW) - 1)
    spots = keys.select(F.pmod(F.xxhash64(key), F.lit(1 << bits)).alias("spot"))
    bitmap = spots.groupBy(F.shiftright("spot", BITMAP_ROW).alias("bitmap_row_")).agg(F.bitmap_construct_agg(F.col("spot").bitwiseAND(low)).alias("bitmap_"))
    columns = df.columns
    inside = F.col("spot_").bitwiseAND(low)
    byte = F.conv(F.hex(F.substring(F.col("bitmap_"), (F.shiftright(inside, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    spotted = df.withColumn("spot_", F.pmod(F.xxhash64(key), F.lit(1 << bits))).withColumn("bitmap_row_", F.shiftright("spot_", BITMAP_ROW))
    marked = spotted.join(F.broadcast(bitmap), "bitmap_row_", "left")
    return marked.withColumn("maybe_", F.coalesce(F.getbit(byte, inside.bitwiseAND(7).cast("int")) == 1, F.lit(False))).select(*columns, "maybe_")


def keep_rows(docs: DataFrame, verdicts: DataFrame, keep: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose (id, text_key) is marked ``keep`` in ``verdicts`` (at least one row for each row of ``docs``).

    Of rows equal in id and text one stays, whatever their other columns. Texts of rows that stay do not move: a bitmap
    of the few pairs that go or are repeated picks the rows to look at, and only those are joined with their verdicts.
    """
    named = verdicts.select(F.xxhash64(id_col, "text_key").alias("pair_"), F.col(id_col).alias("v_id_"), F.col("text_key").alias("v_key_"), F.col(keep).alias("keep_"))
    touched = durable(named.groupBy("pair_", "v_id_", "v_key_").agg(F.count(F.lit(1)).alias("n"), F.max("keep_").alias("keep_")).filter("n > 1 or not keep_"))
    marked = whole_rows(docs).withColumns({"id_": F.col(f"row_.`{id_col}`"), "key_": text_key(F.col(f"row_.`{text_col}`"))})
    marked = maybe_member(marked.withColumn("pair_", F.xxhash64("id_", "key_")), touched.select("pair_").distinct(), "pair_")
    same = (F.col("t.pair_") == F.col("m.pair_")) & F.col("m.id_").eqNullSafe(F.col("t.v_id_")) & (F.col("m.key_") == F.col("t.v_key_"))
    looked_at = marked.filter("maybe_").alias("m").join(touched.alias("t"), same, "left").filter("keep_ is null or keep_")
    # rows that are not named count as different from all others
    own = F.when(F.col("keep_").isNull(), F.monotonically_increasing_id())
    few = looked_at.select("row_", "id_", "key_", own.alias("own_")).dropDuplicates(["id_", "key_", "own_"])
    return marked.filter("not maybe_").select("row_").unionByName(few.select("row_")).select("row_.*")
