"""The batch jobs as functions of an input and an output path, and a command line for them.

``python -m tidemill.plans.jobs <job> [-D key=value ...] <arguments>``: any -D sets a Spark SQL option, or one of the
chain job's own (chain.topk, chain.sample.size, chain.sample.seed). Verifiers write what is wrong, so an empty output is a
pass: ``payload_verifier <rows> <out>``, ``pack_verifier <rows> <out> <pack>``, ``top_k_verifier <rows> <out> <reports> <k>``.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.strings import base64_line
from tidemill.operators import averages, chains, history, index, joins, text, topology
from tidemill.sources import files, packs
from tidemill.sources.sinks import counter_lines, write_tsv

PARTITIONS = 4


def text_metrics(spark: SparkSession, source: str, part: str) -> DataFrame:
    """A: word counts. B: counts of the target words. C: distinct words by length and last letter."""
    jobs = {"A": text.word_count, "B": text.target_words, "C": text.distinct_by_length_and_last}
    if part not in jobs:
        raise ValueError(f"part must be A, B or C, not {part!r}")
    return jobs[part](files.read_lines(spark, source))


def field_indexer(spark: SparkSession, source: str, part: str) -> DataFrame:
    """A: inverted index. B: the long word with the longest list."""
    if part not in ("A", "B"):
        raise ValueError(f"part must be A or B, not {part!r}")
    found = index.postings(files.indexed_rows(spark, source))
    if part == "B":
        return index.longest_list_word(found)
    return index.rendered(found.groupBy("word").agg(F.sort_array(F.collect_list("id")).alias("ids")))


def group_by_average(spark: SparkSession, source: str, region: str = "West") -> DataFrame:
    rows = files.temperatures(spark, source).filter((F.col("region") == region) & (F.col("state") != "") & (F.col("year") != ""))
    found = averages.average(rows, ["state", "year"], "temperature")
    return found.select("state", "year", averages.two_decimals(F.col("average")).alias("average"))


def capital_average(spark: SparkSession, source: str, strategy: str) -> DataFrame:
    """Average reading of each state's capital; the strategy changes the plan only."""
    readings = files.temperatures(spark, source).filter("state <> '' and temperature is not null")
    found = averages.average(joins.capital_readings(readings, files.capitals(spark, f"{source}/dataset2.csv"), strategy), ["state", "city"], "temperature")
    return found.select("state", "city", averages.two_decimals(F.col("average")).alias("average"))


def map_side_join(spark: SparkSession, source: str) -> DataFrame:
    return capital_average(spark, source, "broadcast")


def reduce_side_join(spark: SparkSession, source: str) -> DataFrame:
    return capital_average(spark, source, "merge")


def delta_chains(spark: SparkSession, source: str, k: int = 0, partitions: int = PARTITIONS, mode: str = "total") -> tuple[DataFrame, DataFrame]:
    """Report lines of all chains, ordered, and one row of counters. k > 0: largest deltas; else verification."""
    if mode not in ("total", "hash"):
        raise ValueError(f"mode must be total or hash, not {mode!r}")
    if partitions < 1:
        raise ValueError("at least one partition")
    rows = files.read_chain(spark, source)
    if k > 0:
        found = chains.top_k(rows, k)
        lines = chains.top_k_text(found)
    else:
        found = chains.resolve(rows)
        lines = chains.resolve_text(found)
    split = chains.roots_with_several_origins(rows.filter(~F.col("malformed"))).take(1)
    if split:
        raise ValueError(f"root {split[0]['root']} has several origins: its chain would be cut")
    placed = lines.repartitionByRange(partitions, *chains.CHAIN) if mode == "total" else lines.repartition(partitions, "root")
    placed = placed.sortWithinPartitions(*chains.CHAIN)
    counters = chains.top_k_counters(rows, found, k, placed) if k > 0 else chains.resolve_counters(rows, found, placed)
    return placed.select("root", "report"), counters


def topology_pre_pass(spark: SparkSession, listing: str, pack: str | None = None) -> DataFrame:
    """Chain rows of a pack listing (with payloads if the pack is given); a listing that contradicts itself raises."""
    lines = files.read_lines(spark, listing)
    listed = files.parse_listing(lines).withColumnRenamed("depth", "listed_depth")
    closed = topology.checkpointed(topology.close_chains(listed))
    wrong = topology.depth_mismatches(closed).take(1) or topology.topology_mismatches(closed, files.listing_summary(lines)).take(1)
    if wrong:
        raise ValueError(f"listing and computed depths differ: {wrong[0].asDict()}")
    rows = topology.chain_rows(closed)
    if pack is None:
        return rows
    stored = packs.read_pack_objects(spark, pack, rows.select("offset")).select("offset", "obj_type", "data")
    both = rows.join(stored, "offset")
    agreed = (F.col("obj_type") >= 6) == (F.col("base_sha") != "-")
    payload = F.when(agreed, base64_line("data")).otherwise(F.raise_error(F.concat(F.lit("pack and listing disagree on "), "sha")))
    return both.select("root", "position", "sha", "base_sha", "type", "size", "offset", payload.alias("payload64"))


def contents(rows: DataFrame) -> DataFrame:
    """sha, type and resolved content of every object; an object that fails verification raises."""
    failed = chains.verify_objects(rows).filter(~F.col("ok")).take(1)
    if failed:
        raise ValueError(f"{failed[0]['sha']}: {failed[0]['error']}")
    return chains.resolved_contents(rows)


def timestamp_annotator(spark: SparkSession, source: str) -> DataFrame:
    """The nine-column rows of eight-column ones: time of the first commit that reaches each object, else 0."""
    rows = files.read_chain(spark, source)
    odd = rows.filter(F.col("malformed") | (F.col("width") != 8)).take(1)
    if odd:
        raise ValueError("eight columns are needed")
    reached = history.first_reach(history.object_links(contents(rows)))
    return history.with_times(rows, reached).select("root", "position", "sha", "base_sha", "type", "size", "offset", "payload64", "ts")


def origin_annotator(spark: SparkSession, source: str) -> DataFrame:
    """The ten-column rows of nine-column ones."""
    rows = files.read_chain(spark, source)
    if rows.filter(F.col("malformed") | (F.col("width") != 9)).take(1):
        raise ValueError("nine columns are needed")
    return chains.with_origin(rows).select("root", "position", "sha", "base_sha", "type", "size", "offset", "payload64", "ts", "origin")


def payload_verifier(spark: SparkSession, source: str) -> DataFrame:
    """One row per object of an eight-column file that does not rebuild to its id."""
    rows = files.read_chain(spark, source)
    if rows.filter(F.col("malformed") | (F.col("width") != 8)).take(1):
        raise ValueError("eight columns are needed")
    return chains.verify_objects(rows).filter(~F.col("ok")).select("root", "sha", "error")


def pack_verifier(spark: SparkSession, source: str, pack: str) -> DataFrame:
    """One row per object of a seven-column file that does not rebuild from the pack, or that the pack stores as another
    kind (whole or delta) than the file says."""
    rows = files.read_chain(spark, source)
    if rows.filter(F.col("malformed") | (F.col("width") != 7)).take(1):
        raise ValueError("seven columns are needed")
    stored = packs.read_pack_objects(spark, pack, rows.select("offset").distinct()).select("offset", "obj_type", base64_line("data").alias("stored64"))
    both = rows.join(stored, "offset").withColumn("payload64", F.col("stored64"))
    kinds = both.filter((F.col("obj_type") >= 6) != chains.is_delta()).select("root", "sha", F.lit("pack and listing disagree").alias("error"))
    return chains.verify_objects(both).filter(~F.col("ok")).select("root", "sha", "error").unionByName(kinds)


def top_k_verifier(spark: SparkSession, source: str, reports: str, k: int) -> DataFrame:
    """Chains whose line in the folder ``reports`` differs from a recomputation."""
    lines = files.read_lines(spark, reports).select(F.substring_index("value", "\t", 1).alias("root"), F.substring_index("value", "\t", -1).alias("report"))
    return chains.top_k_mismatches(files.read_chain(spark, source), lines, k)


def sample_bounds(spark: SparkSession, source: str, partitions: int = PARTITIONS, size: int = 2000, seed: int = 42) -> DataFrame:
    """The boundaries (origin, root) of a seeded sample of the chains."""
    return spark.createDataFrame(chains.partition_bounds(files.read_chain(spark, source), partitions, size, seed), "origin long, root string")


#: Jobs whose output is one sorted file, and those whose files follow each other in order, by these columns.
SORTED = {"group_by_average": [0, 1], "map_side_join": [0, 1], "reduce_side_join": [0, 1]}
RANGED = {"text_metrics": [0], "field_indexer": [0]}


def main(args: list[str]) -> int:
    builder, own, rest = SparkSession.builder, {}, []
    it = iter(args)
    for a in it:
        if a == "-D" or a.startswith("-D"):
            key, _, value = (next(it, "") if a == "-D" else a[2:]).partition("=")
            own[key] = value
            builder = builder.config(key, value)
        else:
            rest.append(a)
    job, *rest = rest or [""]
    two = {"group_by_average": group_by_average, "map_side_join": map_side_join, "reduce_side_join": reduce_side_join,
           "timestamp_annotator": timestamp_annotator, "origin_annotator": origin_annotator}
    three = {"text_metrics": text_metrics, "field_indexer": field_indexer}
    two["payload_verifier"] = payload_verifier
    try:
        spark = builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if job in two and len(rest) == 2:
            found = two[job](spark, rest[0])
        elif job in three and len(rest) == 3:
            found = three[job](spark, rest[0], rest[2])
        elif job == "topology_pre_pass" and len(rest) in (2, 3):
            found = topology_pre_pass(spark, rest[0], *rest[2:])
        elif job == "pack_verifier" and len(rest) == 3:
            found = pack_verifier(spark, rest[0], rest[2])
        elif job == "top_k_verifier" and len(rest) == 4:
            found = top_k_verifier(spark, rest[0], rest[2], int(rest[3]))
        elif job == "sample_bounds" and len(rest) in (2, 3):
            n = int(rest[2]) if len(rest) > 2 else PARTITIONS
            found = sample_bounds(spark, rest[0], n, int(own.get("chain.sample.size", 2000)), int(own.get("chain.sample.seed", 42)))
        elif job == "delta_chains" and 2 <= len(rest) <= 4:
            n, mode = int(rest[2]) if len(rest) > 2 else PARTITIONS, rest[3] if len(rest) > 3 else "total"
            found, counters = delta_chains(spark, rest[0], int(own.get("chain.topk", 0)), n, mode)
            write_tsv(found, rest[1])
            print("\n".join(counter_lines(counters)))
            return 0
        else:
            raise ValueError(__doc__)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    if job in RANGED:
        keys = [found.columns[i] for i in RANGED[job]]
        found = found.repartitionByRange(*keys).sortWithinPartitions(*keys)
    write_tsv(found, rest[1], [found.columns[i] for i in SORTED[job]] if job in SORTED else None)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
