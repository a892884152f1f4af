"""Readings joined with the capital of their state, under three physical strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HINTS = {"broadcast": "broadcast", "merge": "merge", "shuffle_hash": "shuffle_hash", "auto": None}
#: Rows of the small side up to which "broadcast" broadcasts; beyond, Spark chooses.
BROADCAST_ROWS = 100_000


def capital_readings(facts: DataFrame, capitals: DataFrame, strategy: str = "auto") -> DataFrame:
    """Rows of ``facts`` (state, city, ...) whose city is the capital of their state, by an equi-join on both.

    Both keys are in the join, so readings of other cities are dropped before anything else, and with a shuffle a
    large state is spread over its cities. "broadcast" is a request: the small side is counted (up to the bound)
    first, and a larger one is left to the planner.
    """
    if strategy not in HINTS:
        raise ValueError(f"unknown strategy {strategy!r}")
    side = capitals.select(F.col("state").alias("key_state"), F.col("capital").alias("key_capital"))
    if strategy == "broadcast" and side.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        strategy = "auto"
    if HINTS[strategy]:
        side = side.hint(HINTS[strategy])
    return facts.join(side, (F.col("state") == F.col("key_state")) & (F.col("city") == F.col("key_capital"))).drop("key_state", "key_capital")


def tagged_union(facts: DataFrame, sides: DataFrame, key: str) -> DataFrame:
    """Rows of two inputs under one key with a tag, T for ``facts`` and C for ``sides``; other columns are kept, null
    where an input lacks them."""
    return facts.withColumn("tag", F.lit("T")).unionByName(sides.withColumn("tag", F.lit("C")), allowMissingColumns=True)
