"""Queries through files: the driver's tables are written as the text and pack files that the jobs read, with bad rows mixed
in, and read back through the sources, sinks, jobs and verifiers; each with the SQL that must give the same rows."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import strings
from tidemill.operators import chains, history, index
from tidemill.plans import catalog, jobs
from tidemill.sources import files, packs
from tidemill.sources.shared import checkpointed, scratch, write_file
from tidemill.sources.sinks import write_tsv


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(df: DataFrame, path: str, *cells, separator: str = "\t") -> str:
    df.select(F.concat_ws(separator, *cells).alias("value")).write.text(path)
    return path


def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "lines")
    write_tsv(_table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lit(None).cast("string").alias("none"), "p_type"), path)
    f = F.split("value", "\t", -1)
    return files.read_lines(spark, path).select(f[0].cast("long").alias("id"), f[1].alias("name"), f[2].alias("none"), f[3].alias("type"), F.size(f).alias("width"))


def one_sorted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a sorted sink with their place in its only file."""
    path = scratch(spark, "sorted")
    write_tsv(_table(spark, sf_dir, "nation").select("n_name", "n_nationkey"), path, ["n_name"])
    read = files.read_lines(spark, path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    return read.select(F.substring_index("value", "\t", 1).alias("name"), place.alias("place"), F.size(F.collect_set("file").over(Window.partitionBy(F.lit(1)))).alias("files"))


def _readings(spark: SparkSession, sf_dir: str) -> str:
    """dataset.csv: orders as readings, with blanks around cells, readings that are none, other regions and a header."""
    folder = scratch(spark, "readings")
    key = F.col("o_orderkey")
    places = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = _table(spark, sf_dir, "orders").join(places, F.col("o_custkey") == F.col("c_custkey"))
    reading = (
        F.when(key % 11 == 0, "none").when(key % 13 == 0, "-99").when(key % 17 == 0, " -99.0 ").otherwise(F.concat(F.lit(" "), F.floor("o_totalprice").cast("string")))
    )
    region = F.when(key % 3 == 0, "\tWest ").when(key % 3 == 1, "West").otherwise("west")
    _lines(orders, f"{folder}/dataset.csv", region, F.lit('"a'), F.concat(F.lit(" "), "n_name"), "c_mktsegment", F.lit(""), F.lit('b"'), F.date_format("o_orderdate", "yyyy"), reading, separator=",")
    write_file(spark, f"{folder}/dataset.csv/header", "Region,Country,State,City,Month,Day,Year,AvgTemperature\nWest,too,few\nWest,x,,y,1,1,1995,5\n")
    return folder


def csv_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.group_by_average(spark, _readings(spark, sf_dir))


def _csv_capitals(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    folder = _readings(spark, sf_dir)
    names = [r["n_name"] for r in _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    body = "".join(f" {'BUILDING' if i % 2 else 'MACHINERY'} ,{name}, x\n" for i, name in enumerate(names))
    write_file(spark, f"{folder}/dataset2.csv", "\n capital,State,Type\nFURNITURE,CHINA\nNOWHERE,\nalone\n" + body)
    return jobs.capital_average(spark, folder, strategy)


def csv_broadcast_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv_capitals(spark, sf_dir, "broadcast")


def csv_merge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv_capitals(spark, sf_dir, "merge")


def chain_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain rows of four widths, with wrong widths, numbers that are none and an empty line."""
    key = F.col("event_id")
    cells = [
        F.col("user_id").cast("string"), F.when(key % 19 == 0, " 5").otherwise(F.dayofyear("ts").cast("string")), key.cast("string"), F.lit("-"), F.lit("blob"),
        F.when(key % 23 == 0, "1e3").otherwise((key % 1000).cast("string")), F.when(key % 7 == 0, "x").otherwise("12"), F.lit("cGF5"), (key * 3).cast("string"), F.lit("8"), F.lit("more"),
    ]
    width = F.when(key % 29 == 0, F.when(key % 2 == 0, 6).otherwise(11)).otherwise((key % 4 + 7).cast("int"))
    path = scratch(spark, "chain")
    _table(spark, sf_dir, "events").select(F.array_join(F.slice(F.array(*cells), F.lit(1), width), "\t").alias("value")).unionByName(spark.createDataFrame([("",)], "value string")).write.text(path)
    rows = files.read_chain(spark, path)
    return rows.select("malformed", "width", "root", "sha", "position", "size", "offset", "payload64", "ts", "origin").filter("width > 6")


def index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written, and read again by the job that follows."""
    path = scratch(spark, "index")
    write_tsv(catalog.field_index(spark, sf_dir), path)
    write_file(spark, f"{path}/other", "no tab here\n")
    read = index.read_rendered(files.read_lines(spark, path))
    return read.select("word", F.size("ids").alias("n"), F.array_min("ids").alias("low"), F.array_max("ids").alias("high"))


def _sha(*parts: str) -> str:
    return hashlib.sha1(".".join(parts).encode()).hexdigest()


def pack_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack listing of all turns with its summary lines, through the pre-pass that checks depths against it."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn")
    sha = lambda turn: F.sha1(F.concat_ws(".", F.col("conv_id"), turn).cast("binary"))
    line = F.concat_ws(
        "  ", sha(F.col("turn")), F.lit("blob"), (F.col("turn") + 5).cast("string"), F.lit("9"), F.col("conv_id").cast("string"),
        F.when(F.col("turn") > 0, F.col("turn").cast("string")), F.when(F.col("turn") > 0, sha(F.col("turn") - 1)),
    )
    said = turns.groupBy("turn").count().select(F.when(F.col("turn") == 0, F.concat_ws(" ", F.lit("non delta:"), "count", F.lit("objects"))).otherwise(F.concat(F.lit("chain length = "), "turn", F.lit(": "), "count", F.lit(" objects"))).alias("value"))
    path = scratch(spark, "listing")
    turns.select(F.concat(F.lit(" "), line).alias("value")).unionByName(said).unionByName(spark.createDataFrame([("a.pack: ok",)], "value string")).write.text(path)
    return jobs.topology_pre_pass(spark, path).drop("offset")


def pack_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as whole objects of four types, offset deltas and id deltas of a pack file."""
    pack, offsets, last = b"PACK", [], {}
    for r in _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # 25 rows
        key, data = r["n_nationkey"], (r["n_name"] * (r["n_nationkey"] + 1)).encode()
        kind = key % 6 + 1 if key % 6 < 4 else key % 6 + 2
        head = [kind << 4 | len(data) & 15]
        rest = len(data) >> 4
        while rest:
            head[-1] |= 128
            head.append(rest & 127)
            rest >>= 7
        base = b""
        if kind == 6:
            back = len(pack) - last["at"]
            base = [back & 127]
            while back := (back >> 7):
                back -= 1
                base.insert(0, back & 127 | 128)
        elif kind == 7:
            base = bytes.fromhex(_sha(str(key)))
        offsets.append((len(pack),))
        last["at"] = len(pack)
        pack += bytes(head) + bytes(base) + zlib.compress(data)
    path = write_file(spark, scratch(spark, "objects") + ".pack", pack)
    found = packs.read_pack_objects(spark, path, spark.createDataFrame(offsets, "offset long"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("offset")) - 1
    kind = F.coalesce(packs.type_name(F.col("obj_type")), F.when(F.col("obj_type") == 6, "offset delta").otherwise("id delta"))
    before = F.lag("offset").over(Window.partitionBy("path").orderBy("offset"))
    return found.select(place.cast("long").alias("key"), kind.alias("kind"), F.decode("data", "UTF-8").alias("data"), F.lower(F.hex("base_sha")).alias("base"), F.when(F.col("obj_type") == 6, F.col("base_offset") == before).alias("base_found"))


def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").withColumn("padded", F.concat(F.lit("\t "), "p_name", F.lit(" \n")))
    number = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(" "), "p_partkey")).when(F.col("p_partkey") % 5 == 1, F.concat("p_partkey", F.lit(".0"))).otherwise(F.concat(F.lit("-"), "p_partkey"))
    return rows.select(
        "p_partkey", strings.java_trim(F.col("padded")).alias("trimmed"), strings.strict_long(number).alias("strict"), strings.strict_int(F.concat(number, F.lit("000000"))).alias("strict_int"),
        F.left("p_name", F.lit(7)).alias("short"), F.instr("p_name", " ").alias("first_blank"), F.substring_index("p_name", " ", -1).alias("last_word"), F.startswith("p_name", F.lit("s")).alias("starts"),
        F.size(F.split(F.concat("p_name", F.lit("  ")), " ", -1)).alias("parts"), F.translate("padded", "\t\n", "  ").alias("one_line"), F.regexp_extract("p_brand", r"#(\d)", 1).alias("digit"),
        strings.iso_seconds(F.col("p_partkey") * 86_461).alias("iso"), strings.base64_line(F.encode("p_name", "UTF-8")).alias("base64"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-K report lines written, and their ``name=value`` parts read again."""
    path = scratch(spark, "reports")
    rows = _chain_rows(spark, sf_dir)
    write_tsv(chains.top_k_text(chains.top_k(rows, 2)).select("root", "report"), path)
    fields = chains.report_fields(F.substring_index("value", "\t", -1))
    read = files.read_lines(spark, path).select(F.substring_index("value", "\t", 1).cast("long").alias("root"), fields.alias("f"))
    return read.select("root", *[F.col("f")[name].cast("long").alias(name.lower()) for name in ("n", "deltas", "k", "kept", "patchBytes", "topBytes", "origin")], (F.col("f")["top"] == "-").alias("none"))


def _chain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    return catalog._turns(spark, sf_dir).select(
        F.col("root").cast("string").alias("root"), F.col("position").cast("long").alias("position"), "sha", "base_sha", "size", F.col("size").cast("string").alias("size_text"),
        F.lit(False).alias("malformed"), F.lit(7).alias("width"), zero.alias("ts"), zero.alias("origin"),
    )


def report_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains whose report line is wrong, missing, repeated or of no chain."""
    rows = _chain_rows(spark, sf_dir)
    root = F.col("root").cast("long")
    lines = chains.top_k_text(chains.top_k(rows, 2)).select("root", F.when(root % 10 == 1, F.concat("report", F.lit("0"))).otherwise(F.col("report")).alias("report"))
    lines = lines.filter(root % 10 != 2).unionByName(lines.filter(root % 10 == 3)).unionByName(spark.createDataFrame([("unknown", "n=1")], "root string, report string"))
    found = chains.top_k_mismatches(rows, lines, 2)
    return found.select("root", F.when(F.col("want").isNull(), "unknown").when(F.col("report").isNull(), "missing").when(F.col("lines") > 1, "repeated").otherwise("wrong").alias("fault"))


def heap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chains.heap_counters(_chain_rows(spark, sf_dir), 2)
    return found.select(F.col("root").cast("long").alias("root"), "offered", "accepted", "evicted", "rejected")


def order_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before their turn in a delivery by falling time, where only the first of each day is in place."""
    rows = catalog._events(spark, sf_dir).select(F.lit(0).cast("long").alias("origin"), F.col("root").cast("string").alias("root"), "position", F.lit(1).cast("long").alias("size"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("sha").cast("string").alias("sha"))
    delivered = rows.repartition("root").sortWithinPartitions("root", F.desc("ts"), F.desc("sha"))
    return chains.late_rows(delivered).select(F.col("sha").cast("long").alias("sha"))


def group_order_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains that come after a larger one: nations by name, with their region as origin, in one partition."""
    rows = _table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("origin"), F.col("n_name").alias("root"))
    return chains.group_order_violations(rows.coalesce(1).sortWithinPartitions("root"))


def mixed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of chains with missing and broken payloads, repeated rows and malformed ones."""
    rows = checkpointed(catalog._turn_objects(spark, sf_dir))
    conv = F.col("root").cast("long") % 7
    first = F.col("position") == 0
    broken = F.when((conv == 2) & first, "!!").when((conv == 1) & (F.col("position") == 1), F.lit(None)).otherwise(F.col("payload64"))
    rows = rows.withColumn("payload64", broken)
    rows = rows.unionByName(rows.filter((conv == 3) & first)).unionByName(rows.filter((conv == 4) & first).withColumn("malformed", F.lit(True)))
    found = chains.resolve_counters(rows, chains.resolve(rows))
    names = ("RECORDS", "MALFORMED", "WITH_PAYLOAD", "GROUPS", "OUT_OF_ORDER_GROUPS", "GROUP_ORDER_VIOLATIONS", "VERIFIED", "FAILED", "DELTAS_APPLIED", "NO_PAYLOAD", "TIED_RECORDS")
    return found.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])))


def payload_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a written chain file that do not rebuild: those of chains whose first size is wrong."""
    rows = catalog._turn_objects(spark, sf_dir)
    size = F.when((F.col("root").cast("long") % 5 == 0) & (F.col("position") == 0), F.col("size") + 1).otherwise(F.col("size"))
    path = _lines(rows, scratch(spark, "payloads"), "root", "position", "sha", "base_sha", "type", size, F.lit("0"), "payload64")
    return jobs.payload_verifier(spark, path).groupBy(F.col("root").cast("long").alias("root")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains("error", F.lit("not resolved"))).alias("unresolved"))


def deep_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times handed down conversations turn by turn: as many rounds as there are turns."""
    turns = _table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat_ws(".", F.col("conv_id"), turn)
    no, time = F.lit(False).alias("is_tree"), (F.length(F.coalesce("text", F.lit(""))) + 1).cast("long")
    links = turns.filter("turn > 0").select(name(F.col("turn") - 1).alias("parent"), name(F.col("turn")).alias("child"), no, F.lit(None).cast("long").alias("time"))
    starts = turns.filter("turn % 3 = 0").select(name(F.col("turn")).alias("parent"), name(F.col("turn")).alias("child"), no, time.alias("time"))
    return history.first_reach(links.unionByName(starts))


def commit_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits: the links and times read from them; those without a committer give none."""
    orders = _commits(spark, sf_dir)
    return history.object_links(orders).select(F.col("parent").cast("long").alias("key"), F.col("child").alias("tree"), "is_tree", "time")


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    who = F.when(key % 9 == 0, "author").otherwise("committer")
    body = F.concat(F.lit("tree "), F.sha1(key.cast("string").cast("binary")), F.lit("\nauthor A <a@b> 5 +0000\n"), who, F.lit(" C. <c@d> "), (key * 7).cast("string"), F.lit(" +0100\n\ncommitter in the message\n"))
    return _table(spark, sf_dir, "orders").select(key.cast("string").alias("sha"), F.lit("commit").alias("type"), F.encode(body, "UTF-8").alias("content"))


def unparsable_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.unparsable_commits(_commits(spark, sf_dir))


def tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as entries of a tree: files, folders and submodules, which are left out."""
    mode = F.when(F.col("l_linenumber") % 3 == 0, "160000").when(F.col("l_linenumber") % 3 == 1, "40000").otherwise("100644")
    entry = F.concat(F.encode(F.concat(mode, F.lit(" name")), "UTF-8"), F.lit(b"\0"), F.unhex(F.sha1(F.col("l_partkey").cast("string").cast("binary"))))
    trees = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.hex(entry)).alias("entries"))
    objects = trees.select(F.col("l_orderkey").cast("string").alias("sha"), F.lit("tree").alias("type"), F.unhex(F.array_join("entries", "")).alias("content"))
    return history.object_links(objects).groupBy(F.col("parent").cast("long").alias("key"), "child", "is_tree").agg(F.count(F.lit(1)).alias("n"))


def time_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    reached = orders.filter(F.col("o_orderkey") % 3 > 0).select(F.col("o_orderkey").cast("string").alias("sha"), (F.col("o_orderkey") * 5).alias("ts"))
    return history.time_report(history.with_times(orders.select(F.col("o_orderkey").cast("string").alias("sha"), F.lit(1).alias("ts")), reached))


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest time of a chain that is not 0, and 0 where there is none."""
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("sha"), F.col("user_id").alias("root"), F.when(F.col("user_id") % 4 == 0, 0).when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("event_id")).cast("long").alias("ts"))
    return chains.with_origin(rows).select("sha", "origin")


def hash_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions that each chain is in, and whether its rows are in order there."""
    rows = catalog._events(spark, sf_dir).withColumn("origin", F.lit(0).cast("long"))
    placed = checkpointed(chains.hash_order(rows, 5).select("root", "position", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    late = F.col("position") < F.lag("position").over(Window.partitionBy("root").orderBy("at"))
    return placed.withColumn("late", late).groupBy("root").agg(F.count_distinct("part").alias("parts"), F.count_if("late").alias("late"))


def range_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of all chains and the bounds in it; the sample holds every chain, so the bounds are its exact quarters."""
    rows = _table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("origin"), F.col("n_name").alias("root"), F.col("n_name").alias("sha"))
    bounds = chains.partition_bounds(rows, 5)
    return spark.createDataFrame(bounds, "origin long, root string")


QUERIES = {
    f.__name__: f
    for f in (
        line_scan, one_sorted_file, csv_average, csv_broadcast_join, csv_merge_join, chain_file, index_file, pack_listing, pack_objects, string_functions, reports, report_faults, heap_counts,
        order_faults, group_order_faults, mixed_counters, payload_faults, deep_reach, commit_times, unparsable_commits, tree_links, time_report, origins, hash_partitions, range_bounds,
    )
}

_READINGS = """
    SELECT n_name AS state, c_mktsegment AS city, CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderkey % 3 < 2 AS west, CAST(floor(o_totalprice) AS HUGEINT) AS t
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0
"""
_HALF_UP = "(SELECT *, (200 * s + c) // (2 * c) AS q FROM sums)"
_TWO = "CAST(q // 100 AS VARCHAR) || '.' || lpad(CAST(q % 100 AS VARCHAR), 2, '0')"
_CAPITALS = f"""
    WITH r AS ({_READINGS}),
    sums AS (
      SELECT state, city, sum(t) AS s, count(*) AS c FROM r JOIN nation ON n_name = state
      WHERE city = CASE WHEN n_nationkey % 2 = 1 THEN 'BUILDING' ELSE 'MACHINERY' END GROUP BY 1, 2)
    SELECT state, city, {_TWO} AS average FROM {_HALF_UP}
"""
_TURNS = "SELECT conv_id, turn, length(text) AS size FROM conversations"
_HELD = f"""
    WITH t AS ({_TURNS}),
    d AS (
      SELECT a.conv_id, a.turn, a.size,
             (SELECT count(*) FROM t b WHERE b.conv_id = a.conv_id AND b.turn > 0 AND b.turn < a.turn AND b.size >= a.size) AS better
      FROM t a WHERE turn > 0)
"""

ORACLE_SQL = {
    "line_scan": "SELECT p_partkey AS id, p_name AS name, '' AS none, p_type AS type, 4 AS width FROM part",
    "one_sorted_file": "SELECT n_name AS name, row_number() OVER (ORDER BY n_name) AS place, 1 AS files FROM nation",
    "csv_average": f"WITH r AS ({_READINGS}), sums AS (SELECT state, year, sum(t) AS s, count(*) AS c FROM r WHERE west GROUP BY 1, 2) SELECT state, year, {_TWO} AS average FROM {_HALF_UP}",
    "csv_broadcast_join": _CAPITALS,
    "csv_merge_join": _CAPITALS,
    "chain_file": """
        WITH w AS (SELECT *, CASE WHEN event_id % 29 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 6 ELSE 11 END ELSE event_id % 4 + 7 END AS width FROM events)
        SELECT event_id % 29 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0 AS malformed, CAST(width AS INT) AS width, CAST(user_id AS VARCHAR) AS root, CAST(event_id AS VARCHAR) AS sha,
               CASE WHEN event_id % 19 <> 0 THEN CAST(dayofyear(ts) AS BIGINT) END AS position, CASE WHEN event_id % 23 <> 0 THEN event_id % 1000 END AS size,
               CASE WHEN event_id % 7 <> 0 THEN CAST(12 AS BIGINT) END AS "offset", CASE WHEN width >= 8 THEN 'cGF5' END AS payload64,
               CASE WHEN width >= 9 THEN event_id * 3 ELSE 0 END AS ts, CASE WHEN width >= 10 THEN CAST(8 AS BIGINT) ELSE 0 END AS origin
        FROM w WHERE width > 6
    """,
    "index_file": """
        WITH f AS (SELECT p_partkey, unnest([p_name, p_brand, p_type]) AS t FROM part),
        w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(t), '[a-z]+')) AS word, p_partkey FROM f)
        SELECT word, CAST(count(*) AS INT) AS n, CAST(min(p_partkey) AS INT) AS low, CAST(max(p_partkey) AS INT) AS high FROM w GROUP BY 1
    """,
    "pack_listing": """
        SELECT sha1(conv_id || '.0') AS root, CAST(turn AS BIGINT) AS position, sha1(conv_id || '.' || turn) AS sha,
               CASE WHEN turn > 0 THEN sha1(conv_id || '.' || (turn - 1)) ELSE '-' END AS base_sha, 'blob' AS type, CAST(turn + 5 AS BIGINT) AS size FROM conversations
    """,
    "pack_objects": """
        SELECT CAST(n_nationkey AS BIGINT) AS key, ['commit', 'tree', 'blob', 'tag', 'offset delta', 'id delta'][n_nationkey % 6 + 1] AS kind, repeat(n_name, CAST(n_nationkey + 1 AS INT)) AS data,
               CASE WHEN n_nationkey % 6 = 5 THEN sha1(CAST(n_nationkey AS VARCHAR)) END AS base, CASE WHEN n_nationkey % 6 = 4 THEN true END AS base_found FROM nation
    """,
    "string_functions": r"""
        SELECT p_partkey, p_name AS trimmed, CASE WHEN p_partkey % 5 > 1 THEN -p_partkey END AS strict,
               CASE WHEN p_partkey % 5 > 1 THEN TRY_CAST('-' || p_partkey || '000000' AS INT) END AS strict_int,
               left(p_name, 7) AS short, CAST(instr(p_name, ' ') AS INT) AS first_blank, list_last(string_split(p_name, ' ')) AS last_word, starts_with(p_name, 's') AS starts,
               CAST(len(string_split(p_name || '  ', ' ')) AS INT) AS parts, '  ' || p_name || '  ' AS one_line, regexp_extract(p_brand, '#(\d)', 1) AS digit,
               strftime(make_timestamp(p_partkey * 86461 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso, base64(encode(p_name)) AS base64
        FROM part
    """,
    "reports": f"""
        WITH t AS ({_TURNS}),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY size DESC, turn) AS k FROM t WHERE turn > 0),
        b AS (SELECT conv_id, count(*) AS kept, sum(size) AS top FROM r WHERE k <= 2 GROUP BY 1)
        SELECT conv_id AS root, count(*) AS n, count(*) FILTER (turn > 0) AS deltas, CAST(2 AS BIGINT) AS k, coalesce(any_value(kept), 0) AS kept,
               CAST(coalesce(sum(size) FILTER (turn > 0), 0) AS BIGINT) AS patchbytes, CAST(coalesce(any_value(top), 0) AS BIGINT) AS topbytes, CAST(0 AS BIGINT) AS origin, any_value(kept) IS NULL AS none
        FROM t LEFT JOIN b USING (conv_id) GROUP BY 1
    """,
    "report_faults": """
        SELECT DISTINCT CAST(conv_id AS VARCHAR) AS root, ['wrong', 'missing', 'repeated'][conv_id % 10] AS fault FROM conversations WHERE conv_id % 10 IN (1, 2, 3)
        UNION ALL SELECT 'unknown', 'unknown'
    """,
    "heap_counts": f"""
        {_HELD}
        SELECT conv_id AS root, count(*) AS offered, count(*) FILTER (better < 2) AS accepted, greatest(count(*) FILTER (better < 2) - 2, 0) AS evicted, count(*) FILTER (better >= 2) AS rejected
        FROM d GROUP BY 1
    """,
    "order_faults": """
        SELECT event_id AS sha FROM (SELECT event_id, dayofyear(ts) AS day, ts, lag(dayofyear(ts)) OVER w AS before, lag(ts) OVER w AS ts_before FROM events
                                     WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC))
        WHERE day < before OR (day = before AND ts < ts_before)
    """,
    "group_order_faults": """
        SELECT CAST(n_regionkey AS BIGINT) AS origin, n_name AS root FROM (SELECT n_regionkey, n_name, lag(n_regionkey) OVER (ORDER BY n_name) AS before FROM nation) WHERE n_regionkey < before
    """,
    "mixed_counters": """
        WITH t AS (SELECT conv_id, turn, conv_id % 7 AS m FROM conversations),
        c AS (SELECT count(*) AS n, count(DISTINCT conv_id) AS groups, count(*) FILTER (m = 3 AND turn = 0) AS twice, count(*) FILTER (m = 4 AND turn = 0) AS bad,
                     count(*) FILTER (m = 1 AND turn = 1) AS bare, count(*) FILTER (m = 1 AND turn > 1 OR m = 2) AS failed, count(*) FILTER (turn > 0 AND m NOT IN (1, 2)) AS applied FROM t)
        SELECT unnest(['RECORDS', 'MALFORMED', 'WITH_PAYLOAD', 'GROUPS', 'OUT_OF_ORDER_GROUPS', 'GROUP_ORDER_VIOLATIONS', 'VERIFIED', 'FAILED', 'DELTAS_APPLIED', 'NO_PAYLOAD', 'TIED_RECORDS']) AS name,
               unnest([n + twice, bad, n + twice, groups, 0, 0, n + twice - bare - failed, failed, applied, bare, twice]) AS value
        FROM c
    """,
    "payload_faults": "SELECT conv_id AS root, count(*) AS n, count(*) - 1 AS unresolved FROM conversations WHERE conv_id % 5 = 0 GROUP BY 1",
    "deep_reach": """
        SELECT conv_id || '.' || turn AS sha,
               min(CASE WHEN turn % 3 = 0 THEN length(coalesce(text, '')) + 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS ts
        FROM conversations
    """,
    "commit_times": "SELECT o_orderkey AS key, sha1(CAST(o_orderkey AS VARCHAR)) AS tree, true AS is_tree, o_orderkey * 7 AS time FROM orders WHERE o_orderkey % 9 <> 0",
    "unparsable_commits": "SELECT count(*) AS unparsable FROM orders WHERE o_orderkey % 9 = 0",
    "tree_links": """
        SELECT l_orderkey AS key, sha1(CAST(l_partkey AS VARCHAR)) AS child, l_linenumber % 3 = 1 AS is_tree, count(*) AS n FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY ALL
    """,
    "time_report": """
        SELECT count(*) FILTER (o_orderkey % 3 > 0) AS reached, count(*) FILTER (o_orderkey % 3 = 0) AS unreached, min(o_orderkey * 5) FILTER (o_orderkey % 3 > 0) AS oldest,
               max(o_orderkey * 5) FILTER (o_orderkey % 3 > 0) AS newest FROM orders
    """,
    "origins": "SELECT event_id AS sha, coalesce(min(CASE WHEN user_id % 4 <> 0 AND event_id % 2 = 1 AND event_id <> 0 THEN event_id END) OVER (PARTITION BY user_id), 0) AS origin FROM events",
    "hash_partitions": "SELECT user_id AS root, CAST(1 AS BIGINT) AS parts, CAST(0 AS BIGINT) AS late FROM events GROUP BY 1",
    "range_bounds": """
        SELECT CAST(n_regionkey AS BIGINT) AS origin, n_name AS root FROM (SELECT *, row_number() OVER (ORDER BY n_regionkey, n_name) - 1 AS i, count(*) OVER () AS n FROM nation)
        WHERE i IN (round(n * 1 / 5.0), round(n * 2 / 5.0), round(n * 3 / 5.0), round(n * 4 / 5.0))
    """,
}
