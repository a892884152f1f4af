"""Queries on the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.gitcodec import object_id
from tidemill.functions.strings import base64_line
from tidemill.operators import averages, chains, history, index, joins, text, topology
from tidemill.sources.shared import checkpointed

TARGETS = ["the", "of", "and"]
TOP_K = 3


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_by_place(spark: SparkSession, sf_dir: str, region: str | None = None) -> DataFrame:
    """Orders with their nation and segment; the small dimension tables are joined first."""
    nations = _t(spark, sf_dir, "nation")
    if region:
        regions = _t(spark, sf_dir, "region").filter(F.col("r_name") == region)
        nations = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"], "left_semi")
    customers = _t(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = _t(spark, sf_dir, "orders")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("n_name", "c_mktsegment", "o_totalprice", "o_orderdate")


def group_by_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_by_place(spark, sf_dir, "ASIA").withColumn("year", F.year("o_orderdate"))
    return averages.average(rows, ["n_name", "year"], "o_totalprice", "avg_price", 2)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value"))


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.word_count(_documents(spark, sf_dir))


def target_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.target_words(_documents(spark, sf_dir), TARGETS)


def distinct_by_len_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.distinct_by_length_and_last(_documents(spark, sf_dir))


def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.rendered(index.inverted_index(_documents(spark, sf_dir), "doc_id", "value"))


def field_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array("p_name", "p_brand", "p_type").alias("texts"))
    return index.rendered(index.inverted_index(parts))


def longest_list_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.longest_list_word(index.postings(_documents(spark, sf_dir), "doc_id", "value"))


def _capital_average(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    facts = orders_by_place(spark, sf_dir).select(F.col("n_name").alias("state"), F.col("c_mktsegment").alias("city"), "o_totalprice")
    customers = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sides = customers.groupBy(F.col("n_name").alias("state")).agg(F.min_by("c_mktsegment", "c_custkey").alias("capital"))
    found = joins.capital_readings(facts, sides, strategy)
    return averages.average(found, ["state", "city"], "o_totalprice", "avg_price", 2)


def map_side_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capital_average(spark, sf_dir, "broadcast")


def reduce_side_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capital_average(spark, sf_dir, "merge")


def union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = orders_by_place(spark, sf_dir).select(F.col("n_name").alias("state"), "o_totalprice")
    rows = joins.tagged_union(facts, _t(spark, sf_dir, "nation").select(F.col("n_name").alias("state")), "state")
    return rows.groupBy("state", "tag").agg(F.count(F.lit(1)).alias("n"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chain rows: root is the user, position the day of the year, size the value in cents."""
    return _t(spark, sf_dir, "events").select(
        F.col("event_id").alias("sha"), F.col("user_id").alias("root"), F.dayofyear("ts").cast("long").alias("position"), F.col("value").alias("size"), "ts"
    )


def secondary_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.secondary_sort(_events(spark, sf_dir).withColumn("origin", F.lit(0))).select("sha", "root", "position", "rn")


def chain_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("sha", "root", F.min("ts").over(Window.partitionBy("root")).alias("origin"))


def total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global rank in chain order, without one task for all rows: range partitions are ranked inside, and the counts of
    the ones before are added."""
    rows = _events(spark, sf_dir).withColumn("origin", F.min("ts").over(Window.partitionBy("root")))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(chains.total_order(rows, partitions).select("sha", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b.part") < F.col("a.part"), "left")  # a row per partition
    starts = before.groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("start"))
    inside = F.col("at").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(starts), "part").select("sha", (F.col("start") + inside + 1).alias("rn"))


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("root", "position", F.floor(F.col("size") / 10).alias("size"), F.lit(0).alias("ts"))
    return chains.slots(rows, ["root"])


def chain_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir).select("root", "ties")


def position_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir).select("root", "positions")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chain rows: a turn is a delta on the one before."""
    return _t(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("root"), F.col("turn").alias("position"), F.concat_ws(".", "conv_id", "turn").alias("sha"),
        F.when(F.col("turn") > 0, F.concat_ws(".", F.col("conv_id"), F.col("turn") - 1)).otherwise("-").alias("base_sha"),
        F.length("text").cast("long").alias("size"), "text",
    )


def topk_per_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chains.top_k(_turns(spark, sf_dir), TOP_K, ["root"])
    items = F.transform("top", lambda t: F.concat(t["size"].cast("string"), F.lit("@"), t["position"].cast("string")))
    return found.select("root", "n", "deltas", "kept", "patch_bytes", "top_bytes", F.coalesce(F.array_join(items, ","), F.lit("-")).alias("top"))


def topology_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = _turns(spark, sf_dir).select("sha", F.nullif("base_sha", F.lit("-")).alias("base_sha"))
    return topology.close_chains(objects).select("sha", "root", "depth")


def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.depth_histogram(topology_query(spark, sf_dir))


def first_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits (time: date), their lines as links to parts."""
    orders, lines = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    no_time = F.lit(None).cast("long")
    commit = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    starts = orders.select(commit.alias("parent"), commit.alias("child"), F.lit(False).alias("is_tree"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("time"))
    links = lines.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("parent"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("child"), F.lit(False).alias("is_tree"), no_time.alias("time")
    )
    found = history.first_reach(starts.unionByName(links)).filter(F.startswith("sha", F.lit("p")))
    return found.select(F.substring("sha", 2, 20).cast("long").alias("part"), F.col("ts").alias("day"))


def object_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.encode("value", "UTF-8")
    head = F.encode(F.concat(F.lit("blob "), F.octet_length("value").cast("string")), "US-ASCII")
    return _documents(spark, sf_dir).select("doc_id", F.sha1(F.concat(head, F.lit(b"\0"), body)).alias("sha"))


def _encode_turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each conversation so far as a git object: the first in full, the others as deltas (copy the base, insert the turn)."""

    def number(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    root, content, sha = None, b"", ""
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            new = r.text.encode()
            if r.root != root:
                root, base, payload, content = r.root, "-", new, new
            else:
                base, old = sha, content
                content = old + new
                payload = number(len(old)) + number(len(content))
                for at in range(0, len(old), 0xFFFF):
                    size = min(0xFFFF, len(old) - at)
                    payload += bytes([0xBF]) + at.to_bytes(4, "little") + size.to_bytes(2, "little")
                for at in range(0, len(new), 127):
                    payload += bytes([len(new[at : at + 127])]) + new[at : at + 127]
            sha = object_id("blob", content)
            rows.append((f"{root}", r.position, sha, base, "blob", len(payload), payload))
        yield pd.DataFrame(rows, columns=["root", "position", "sha", "base_sha", "type", "size", "payload"])


def _turn_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).select("root", "position", "text").repartition("root").sortWithinPartitions("root", "position")
    made = turns.mapInPandas(_encode_turns, "root string, position long, sha string, base_sha string, type string, size long, payload binary")
    return made.withColumns({
        "payload64": base64_line("payload"), "ts": F.lit(0).cast("long"), "origin": F.lit(0).cast("long"), "malformed": F.lit(False),
        "size_text": F.col("size").cast("string"), "width": F.lit(8), "offset": F.lit(0).cast("long"),
    }).drop("payload")


def delta_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chains.verify_objects(_turn_objects(spark, sf_dir))
    return done.select(F.col("root").cast("long").alias("root"), "position", F.when(F.col("ok"), F.col("sha")).alias("sha"))


def chain_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turn_objects(spark, sf_dir)
    found = chains.resolve_counters(rows, chains.resolve(rows))
    return found.select(*[F.col(c).alias(c.lower()) for c in ("RECORDS", "MALFORMED", "GROUPS", "VERIFIED", "FAILED", "DELTAS_APPLIED", "NO_PAYLOAD", "TIED_RECORDS")])


QUERIES = {
    "group_by_average": group_by_average, "word_count": word_count, "target_words": target_words, "distinct_by_len_last": distinct_by_len_last,
    "inverted_index": inverted_index, "field_index": field_index, "longest_list_word": longest_list_word, "map_side_join": map_side_join,
    "reduce_side_join": reduce_side_join, "union_tagged": union_tagged, "secondary_sort": secondary_sort, "chain_origin": chain_origin,
    "total_order": total_order, "chain_ties": chain_ties, "position_runs": position_runs, "topk_per_chain": topk_per_chain,
    "topology": topology_query, "depth_histogram": depth_histogram, "first_reach": first_reach, "object_hash": object_hash,
    "delta_reconstruct": delta_reconstruct, "chain_counters": chain_counters,
}

_PLACES = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_CAPITALS = f"""
    WITH side AS (SELECT n_name, arg_min(c_mktsegment, c_custkey) AS capital
                  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT n_name AS state, c_mktsegment AS city, round(avg(o_totalprice), 2) AS avg_price
    FROM {_PLACES} JOIN side USING (n_name) WHERE c_mktsegment = capital GROUP BY 1, 2
"""
_WORDS = "(SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)"
_SLOTS = "SELECT user_id AS root, dayofyear(ts) AS pos, floor(value / 10) AS size, count(*) AS c FROM events GROUP BY 1, 2, 3"

ORACLE_SQL = {
    "group_by_average": f"""
        SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice), 2) AS avg_price
        FROM {_PLACES} JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1, 2
    """,
    "word_count": f"SELECT word, count(*) AS n FROM {_WORDS} GROUP BY 1",
    "target_words": f"SELECT word, count(*) AS n FROM {_WORDS} WHERE word IN ('the', 'of', 'and') GROUP BY 1",
    "distinct_by_len_last": f"SELECT length(word) || ',' || right(word, 1) AS len_last, count(DISTINCT word) AS n FROM {_WORDS} GROUP BY 1",
    "inverted_index": f"SELECT word, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY doc_id) AS ids FROM (SELECT DISTINCT word, doc_id FROM {_WORDS}) GROUP BY 1",
    "field_index": """
        WITH f AS (SELECT p_partkey, unnest([p_name, p_brand, p_type]) AS t FROM part),
        w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(t), '[a-z]+')) AS word, p_partkey FROM f)
        SELECT word, string_agg(CAST(p_partkey AS VARCHAR), ', ' ORDER BY p_partkey) AS ids FROM w GROUP BY 1
    """,
    "longest_list_word": f"SELECT word, count(DISTINCT doc_id) AS n FROM {_WORDS} WHERE length(word) >= 12 GROUP BY 1 ORDER BY n DESC, word LIMIT 1",
    "map_side_join": _CAPITALS,
    "reduce_side_join": _CAPITALS,
    "union_tagged": f"""
        SELECT state, tag, count(*) AS n
        FROM (SELECT n_name AS state, 'T' AS tag FROM {_PLACES} UNION ALL SELECT n_name, 'C' FROM nation) GROUP BY 1, 2
    """,
    "secondary_sort": """
        SELECT event_id AS sha, user_id AS root, dayofyear(ts) AS position,
               row_number() OVER (PARTITION BY user_id ORDER BY dayofyear(ts), value DESC, ts, event_id) AS rn FROM events
    """,
    "chain_origin": "SELECT event_id AS sha, user_id AS root, min(ts) OVER (PARTITION BY user_id) AS origin FROM events",
    "total_order": """
        SELECT event_id AS sha, row_number() OVER (ORDER BY origin, user_id, dayofyear(ts), value DESC, ts, event_id) AS rn
        FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS origin FROM events)
    """,
    "chain_ties": f"SELECT root, CAST(sum(c - 1) AS BIGINT) AS ties FROM ({_SLOTS}) GROUP BY 1",
    "position_runs": f"""
        SELECT root, string_agg(pos || 'x' || c, ',' ORDER BY pos) AS positions
        FROM (SELECT root, pos, CAST(sum(c) AS BIGINT) AS c FROM ({_SLOTS}) GROUP BY 1, 2) GROUP BY 1
    """,
    "topk_per_chain": """
        WITH t AS (SELECT conv_id AS root, turn, length(text) AS size FROM conversations),
        r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY size DESC, turn) AS k FROM t WHERE turn > 0),
        b AS (SELECT root, count(*) AS kept, sum(size) AS top_bytes, string_agg(size || '@' || turn, ',' ORDER BY k) AS top FROM r WHERE k <= 3 GROUP BY 1)
        SELECT root, count(*) AS n, count(*) FILTER (turn > 0) AS deltas, coalesce(any_value(kept), 0) AS kept,
               CAST(coalesce(sum(size) FILTER (turn > 0), 0) AS BIGINT) AS patch_bytes,
               CAST(coalesce(any_value(top_bytes), 0) AS BIGINT) AS top_bytes, coalesce(any_value(top), '-') AS top
        FROM t LEFT JOIN b USING (root) GROUP BY 1
    """,
    "topology": """
        WITH RECURSIVE c AS (
          SELECT conv_id, turn, conv_id || '.' || turn AS root, 0 AS depth FROM conversations WHERE turn = 0
          UNION ALL
          SELECT t.conv_id, t.turn, c.root, c.depth + 1 FROM conversations t JOIN c ON t.conv_id = c.conv_id AND t.turn = c.turn + 1)
        SELECT conv_id || '.' || turn AS sha, root, CAST(depth AS BIGINT) AS depth FROM c
    """,
    "depth_histogram": "SELECT turn AS depth, count(*) AS objects FROM conversations GROUP BY 1",
    "first_reach": """
        SELECT l_partkey AS part, CAST(min(CAST(o_orderdate AS DATE)) - DATE '1970-01-01' AS BIGINT) AS day
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
    """,
    "object_hash": "SELECT doc_id, sha1('blob ' || strlen(text) || chr(0) || text) AS sha FROM documents",
    "delta_reconstruct": """
        WITH s AS (SELECT conv_id AS root, turn AS position, string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn) AS body FROM conversations)
        SELECT root, position, sha1('blob ' || strlen(body) || chr(0) || body) AS sha FROM s
    """,
    "chain_counters": """
        SELECT count(*) AS records, CAST(0 AS BIGINT) AS malformed, count(DISTINCT conv_id) AS groups, count(*) AS verified, CAST(0 AS BIGINT) AS failed,
               count(*) FILTER (turn > 0) AS deltas_applied, CAST(0 AS BIGINT) AS no_payload, CAST(0 AS BIGINT) AS tied_records FROM conversations
    """,
}
