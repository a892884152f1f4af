"""Objects of git pack files, read at given offsets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.gitcodec import TYPE_NAMES, read_packed

PACKED = "path string, offset long, obj_type int, base_offset long, base_sha binary, data binary"


def read_pack_objects(spark: SparkSession, path: str, offsets: DataFrame) -> DataFrame:
    """One row per offset and pack file under ``path``; a wrong header or short data fails the job.

    A pack is one binary row, so packs are read in parallel and each by one task; ``offsets``: long column ``offset``
    (and ``path`` if there are several packs).
    """
    packs = spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("pack"))
    wanted = offsets
    if "path" not in offsets.columns:
        names = spark.read.format("binaryFile").load(path).select("path").take(2)
        if len(names) != 1:
            raise ValueError("several packs: offsets need a path")
        wanted = offsets.withColumn("path", F.lit(names[0]["path"]))
    lists = wanted.groupBy("path").agg(F.sort_array(F.collect_set("offset")).alias("offsets"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, pack, found in zip(batch["path"], batch["pack"], batch["offsets"], strict=True):
                pack = bytes(pack)
                for at in range(0, len(found), 1024):
                    yield pd.DataFrame([(name, *read_packed(pack, int(o))) for o in found[at : at + 1024]], columns=["path", "offset", "obj_type", "base_offset", "base_sha", "data"])

    return packs.join(lists, "path").mapInPandas(read, PACKED)


def type_name(code):
    """Name of an object type code, null if it has none."""
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    return F.try_element_at(names, code)
