"""First time at which a commit reaches each object."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.gitcodec import commit_tree, identity_time, tree_entries
from tidemill.sources.shared import checkpointed


def object_links(objects: DataFrame) -> DataFrame:
    """(parent, child, is_tree, time) read from the contents of commits, trees and tags (sha, type, content).

    A commit links to its tree with its committer time and a tag to itself with its tagger time; a commit without
    either gives no row; submodules are left out.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sha, kind, content in zip(batch["sha"], batch["type"], batch["content"], strict=True):
                content = bytes(content)
                if kind == "commit":
                    tree, time = commit_tree(content), identity_time(content, "committer ")
                    if tree is not None and time is not None:
                        out.append((sha, tree, True, time))
                elif kind == "tag":
                    time = identity_time(content, "tagger ")
                    if time is not None:
                        out.append((sha, sha, False, time))
                elif kind == "tree":
                    out += [(sha, child, sub, None) for child, sub in tree_entries(content)]
            yield pd.DataFrame(out, columns=["parent", "child", "is_tree", "time"]).astype({"time": "Int64"})

    wanted = objects.filter(F.col("type").isin("commit", "tree", "tag")).select("sha", "type", "content")
    return wanted.mapInPandas(read, "parent string, child string, is_tree boolean, time long")


def first_reach(links: DataFrame) -> DataFrame:
    """(sha, ts): smallest time over all commits that reach an object; objects reached by none are absent.

    A frontier of improved times is pushed down the containment links until nothing improves: the result is a
    minimum, so order does not matter and each round is a join and an aggregation with partial minima.
    """
    starts = links.filter(F.col("time").isNotNull())
    edges = checkpointed(links.filter(F.col("time").isNull()).select("parent", "child").distinct())
    own = starts.select(F.col("parent").alias("sha"), F.col("time").alias("ts"))
    trees = starts.filter("is_tree").select(F.col("child").alias("sha"), F.col("time").alias("ts"))
    frontier = checkpointed(own.unionByName(trees).groupBy("sha").agg(F.min("ts").alias("ts")))
    reached = frontier
    while frontier.take(1):
        below = frontier.join(edges, F.col("sha") == F.col("parent")).groupBy("child").agg(F.min("ts").alias("offer"))
        known = reached.groupBy("sha").agg(F.min("ts").alias("ts"))
        better = below.join(known, F.col("child") == F.col("sha"), "left").filter("ts is null or offer < ts")
        frontier = checkpointed(better.select(F.col("child").alias("sha"), F.col("offer").alias("ts")))
        reached = reached.unionByName(frontier)  # only improved rows are written
    return reached.groupBy("sha").agg(F.min("ts").alias("ts"))


def unparsable_commits(objects: DataFrame) -> DataFrame:
    """One row: commits without a tree or a committer time, which ``object_links`` leaves out."""
    commits = objects.filter(F.col("type") == "commit").select("sha", "type", "content")
    links = object_links(commits).select(F.col("parent").alias("sha")).distinct()
    return commits.select("sha").distinct().join(links, "sha", "left_anti").agg(F.count(F.lit(1)).alias("unparsable"))


def with_times(rows: DataFrame, reached: DataFrame) -> DataFrame:
    """Chain rows with ``ts``: their first-reach time, 0 where there is none."""
    times = reached.select("sha", F.col("ts").alias("found"))
    return rows.drop("ts").join(times, "sha", "left").withColumn("ts", F.coalesce("found", F.lit(0).cast("long"))).drop("found")


def time_report(rows: DataFrame) -> DataFrame:
    """One row: objects reached and not reached, oldest and newest time."""
    stamped = F.col("ts") != 0
    return rows.agg(
        F.count_if(stamped).alias("reached"), F.count_if(~stamped).alias("unreached"), F.min(F.when(stamped, F.col("ts"))).alias("oldest"), F.max(F.when(stamped, F.col("ts"))).alias("newest")
    )
