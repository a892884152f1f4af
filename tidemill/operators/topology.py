"""Roots and depths of objects from their base links, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.sources.shared import checkpointed


def close_chains(objects: DataFrame, key: str = "sha", base: str = "base_sha", max_depth: int = 1 << 20) -> DataFrame:
    """``objects`` with ``root`` and ``depth``. A null base marks a root; a base that is no object, or a cycle, raises.

    Every round joins the open links with all links and so doubles the distance covered: log2(depth) rounds. Links
    that have reached their root leave the loop.
    """
    links = objects.select(F.col(key).alias("node"), F.coalesce(F.col(base), F.col(key)).alias("up"), F.col(base).isNull().alias("done"), F.when(F.col(base).isNull(), 0).otherwise(1).cast("long").alias("depth"))
    dangling = links.join(links.select(F.col("node").alias("up")), "up", "left_anti").select("node", "up").take(1)
    if dangling:
        raise ValueError(f"base {dangling[0]['up']} of {dangling[0]['node']} is not in the listing")
    state = checkpointed(links)
    reach = 1
    while state.filter(~F.col("done")).take(1):
        if reach > max_depth:
            raise ValueError("cycle between bases")
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("done").alias("ended"), F.col("depth").alias("more"))
        moved = state.filter(~F.col("done")).join(above, "up").select("node", F.col("next").alias("up"), F.col("ended").alias("done"), (F.col("depth") + F.col("more")).alias("depth"))
        after = checkpointed(state.filter("done").unionByName(moved))
        # in a cycle no open link can ever end: a round that ends none, with none left that could, is the last
        ended = after.filter("done").count()
        if ended == state.filter("done").count():
            raise ValueError("cycle between bases")
        state, reach = after, reach * 2
    found = state.select(F.col("node").alias(key), F.col("up").alias("root"), "depth")
    return objects.join(found, key)


def depth_histogram(closed: DataFrame) -> DataFrame:
    return closed.groupBy("depth").agg(F.count(F.lit(1)).alias("objects"))


def topology_mismatches(closed: DataFrame, summary: DataFrame) -> DataFrame:
    """Depths whose number of objects differs from the listing's summary (depth 0: whole objects)."""
    said = summary.select("depth", F.col("objects").alias("said"))
    both = depth_histogram(closed).join(said, "depth", "full_outer").fillna(0, ["objects", "said"])
    return both.filter("objects <> said")


def depth_mismatches(closed: DataFrame, listed: str = "listed_depth") -> DataFrame:
    """Objects whose own listed depth differs from the one found."""
    return closed.filter(F.coalesce(F.col(listed), F.lit(0)) != F.col("depth"))


def chain_rows(closed: DataFrame) -> DataFrame:
    """The seven chain columns of a closed listing."""
    return closed.select("root", F.col("depth").alias("position"), "sha", F.coalesce("base_sha", F.lit("-")).alias("base_sha"), "type", "size", "offset")
