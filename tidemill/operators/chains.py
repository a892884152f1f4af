"""Ordered processing of delta chains: order, origins, diagnostics, top-K and verification.

A chain is the rows with one (origin, root). Input columns are those of ``sources.files.parse_chain``.
"""

from __future__ import annotations

import base64
import binascii
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.gitcodec import apply_delta, object_id
from tidemill.functions.strings import iso_seconds

CHAIN = ["origin", "root"]
DEFAULT_K = 5


def slot_order() -> list[Column]:
    return [F.col("position"), F.desc("size"), F.col("ts"), F.col("sha")]


def chain_order() -> list[Column]:
    return [F.col("origin"), F.col("root"), *slot_order()]


def secondary_sort(rows: DataFrame) -> DataFrame:
    """``rn``: place of each row in its chain (position, size descending, time)."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*CHAIN).orderBy(*slot_order())))


def total_order(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows range-partitioned by chain, ordered inside: partitions follow each other and cut no chain."""
    return rows.repartitionByRange(partitions, *CHAIN).sortWithinPartitions(*chain_order())


def seeded_sample(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by a seeded hash of their chain and id: the same rows on every run, however they are
    partitioned. Each task keeps its own ``n`` smallest hashes, so rows are not sorted as a whole."""
    if n < 1:
        raise ValueError("a sample needs at least one row")
    return rows.orderBy(F.xxhash64(*CHAIN, "sha", F.lit(seed)), *CHAIN, "sha").limit(n)


def partition_bounds(rows: DataFrame, partitions: int, sample: int = 2000, seed: int = 42) -> list[tuple]:
    """Boundaries (origin, root) that cut a seeded sample into equal parts, without repeats and at chain starts only.

    For callers that place chains themselves; ``total_order`` lets Spark sample. At most ``sample`` keys reach the
    driver. Fewer distinct chains than partitions give fewer boundaries; none at all is an error."""
    if partitions < 2:
        raise ValueError("boundaries need at least two partitions")
    keys = sorted(tuple(r) for r in seeded_sample(rows, sample, seed).select(*CHAIN).collect())
    if not keys:
        raise ValueError("no rows to sample")
    found: list[tuple] = []
    for i in range(1, partitions):
        bound = next((k for k in keys[round(len(keys) * i / partitions) :] if not found or k > found[-1]), None)
        if bound is not None:
            found.append(bound)
    return found


def group_order_violations(ordered: DataFrame) -> DataFrame:
    """Chains that do not follow the one before them in their partition: for partitions that were ordered elsewhere.

    One streamed pass; a chain may be seen once per partition only, in increasing (origin, root).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            bad = []
            for chain in zip(batch["origin"], batch["root"], strict=True):
                if last is not None and chain < last:
                    bad.append(chain)
                last = chain
            yield pd.DataFrame(bad, columns=CHAIN)

    return ordered.select(*CHAIN).mapInPandas(run, "origin long, root string")


def hash_order(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows hash-partitioned by chain, ordered inside each partition."""
    return rows.repartition(partitions, *CHAIN).sortWithinPartitions(*chain_order())


def with_origin(rows: DataFrame) -> DataFrame:
    """``origin``: the smallest time of the chain's root that is not 0, else 0."""
    seen = F.min(F.when(F.col("ts") != 0, F.col("ts"))).over(Window.partitionBy("root"))
    return rows.withColumn("origin", F.coalesce(seen, F.lit(0).cast("long")))


def roots_with_several_origins(rows: DataFrame) -> DataFrame:
    """Roots whose rows do not agree on the origin (their chain would be cut)."""
    return rows.groupBy("root").agg(F.min("origin").alias("low"), F.max("origin").alias("high")).filter("low <> high")


def is_delta() -> Column:
    return F.col("base_sha") != "-"


def slots(rows: DataFrame, keys: list[str] = CHAIN) -> DataFrame:
    """Per chain: ``positions`` as run lengths (``0x1,1x3``) and ``ties``, rows equal to the one before in
    (position, size, time). Counted by slot first, so a large chain is small before its slots are gathered."""
    same = rows.groupBy(*keys, "position", "size", "ts").agg(F.count(F.lit(1)).alias("c"))
    runs = same.groupBy(*keys, "position").agg(F.sum("c").alias("c"), F.sum(F.col("c") - 1).alias("tied"))
    run = F.sort_array(F.collect_list(F.struct("position", "c")))
    text = F.array_join(F.transform(run, lambda r: F.concat_ws("x", r["position"].cast("string"), r["c"].cast("string"))), ",")
    return runs.groupBy(*keys).agg(text.alias("positions"), F.sum("tied").alias("ties"))


def verify_objects(rows: DataFrame) -> DataFrame:
    """origin, root, sha, ok, applied, error of each object with a payload.

    Chains are co-located and ordered, then streamed: only the verified contents of one chain are held. An object
    is verified if its payload has the stated size, its base is verified in the same chain, its delta applies and
    its content has its id; a failure fails everything built on it.
    """
    return _checked(rows).filter("ok is not null").drop("late")


def _checked(rows: DataFrame) -> DataFrame:
    """As ``verify_objects`` for all rows (``ok`` is null without a payload), with ``late``: whether a row came before its turn."""
    needed = rows.select(*CHAIN, "position", "size", "ts", "sha", "base_sha", "type", "payload64")
    ordered = needed.repartition(*CHAIN).sortWithinPartitions(*chain_order())
    return ordered.mapInPandas(_verify, "origin long, root string, position long, size long, ts long, sha string, ok boolean, applied boolean, error string, late boolean")


def late_rows(delivered: DataFrame) -> DataFrame:
    """origin, root, sha of the rows that are not in (position, size descending, time) order after the row before them in their
    chain, as ``delivered``: for partitions that were ordered elsewhere. One streamed pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = place = None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                here = (row.position, -row.size, row.ts)
                if chain == (row.origin, row.root) and here < place:
                    out.append((row.origin, row.root, row.sha))
                chain, place = (row.origin, row.root), here
            yield pd.DataFrame(out, columns=[*CHAIN, "sha"])

    return delivered.select(*CHAIN, "position", "size", "ts", "sha").mapInPandas(run, "origin long, root string, sha string")


def resolved_contents(rows: DataFrame) -> DataFrame:
    """sha, type, content of every object that verifies, in one streamed pass over the ordered chains."""
    needed = rows.filter(F.col("payload64").isNotNull()).select(*CHAIN, "position", "size", "ts", "sha", "base_sha", "type", "payload64")
    ordered = needed.repartition(*CHAIN).sortWithinPartitions(*chain_order())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, held = None, {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if chain != (row.origin, row.root):
                    chain, held = (row.origin, row.root), {}
                if _check(row, held) is None:
                    out.append((row.sha, row.type, held[row.sha]))
            yield pd.DataFrame(out, columns=["sha", "type", "content"])

    return ordered.mapInPandas(run, "sha string, type string, content binary")


def _check(row, contents: dict[str, bytes]) -> str | None:
    try:
        payload = base64.b64decode(row.payload64, validate=True)
    except (binascii.Error, ValueError) as e:
        return f"bad value ({e})"
    if len(payload) != row.size:
        return f"payload {len(payload)} bytes != expected {row.size}"
    content = payload
    if row.base_sha != "-":
        if row.base_sha not in contents:
            return f"base {row.base_sha} not resolved (missing or failed earlier)"
        try:
            content = apply_delta(contents[row.base_sha], payload)
        except ValueError as e:
            return str(e)
    actual = object_id(row.type, content)
    if actual != row.sha:
        return f"sha mismatch, computed {actual}"
    contents[row.sha] = content
    return None


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    chain, place, contents = None, None, {}
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            here = (row.position, -row.size, row.ts)
            late = chain == (row.origin, row.root) and here < place
            if chain != (row.origin, row.root):
                contents = {}
            chain, place = (row.origin, row.root), here
            stored = row.payload64 is not None
            error = _check(row, contents) if stored else None
            ok = error is None if stored else None
            out.append((row.origin, row.root, row.position, row.size, row.ts, row.sha, ok, bool(ok) and row.base_sha != "-", error, late))
        yield pd.DataFrame(out, columns=["origin", "root", "position", "size", "ts", "sha", "ok", "applied", "error", "late"])


def resolve(rows: DataFrame) -> DataFrame:
    """One row per chain: counts, order, verification, patch sizes, times and first error."""
    rows = rows.filter(~F.col("malformed"))
    stored = F.col("payload64").isNotNull()
    patch = stored & is_delta()
    stamped = F.col("ts") != 0
    biggest = F.min_by(F.struct("size", "position", "sha"), F.when(patch, F.struct(-F.col("size"), F.col("position"), F.col("ts"), F.col("sha"))))
    facts = rows.groupBy(*CHAIN).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("position").alias("max_position"),
        F.coalesce(F.sum(F.when(patch, F.col("size"))), F.lit(0)).alias("patch_bytes"),
        F.count_if(patch).alias("patches"),
        biggest.alias("biggest"),
        F.min(F.when(stamped, F.col("ts"))).alias("oldest"),
        F.max(F.when(stamped, F.col("ts"))).alias("newest"),
        F.count_if(stamped).alias("timestamped"),
        F.count_if(~stored).alias("no_payload"),
        F.count_if(stored & (F.col("size_text") != F.col("size").cast("string"))).alias("size_mismatch"),
    )
    first = F.min_by(F.concat_ws(": ", "sha", "error"), F.when(~F.col("ok"), F.struct(F.col("position"), -F.col("size"), F.col("ts"), F.col("sha"))))
    checks = _checked(rows).groupBy(*CHAIN).agg(
        F.count_if("late").alias("late"), F.count_if("ok").alias("verified"), F.count_if(~F.col("ok")).alias("failed"), F.count_if("applied").alias("deltas_applied"), first.alias("first_error")
    )
    whole = facts.join(slots(rows), CHAIN).join(checks, CHAIN)
    return whole.withColumns({
        "ordered": F.col("late") == 0,
        "biggest": F.when(F.col("patches") > 0, F.col("biggest")),
        "origin_mismatch": (F.col("origin") != 0) & (F.col("timestamped") > 0) & (F.col("origin") != F.col("oldest")),
    })


def resolve_text(resolved: DataFrame) -> DataFrame:
    """origin, root and the report line of each chain."""
    part = lambda name, value: F.concat(F.lit(f"{name}="), F.col(value).cast("string") if isinstance(value, str) else value)
    stamped = F.col("timestamped") > 0
    biggest = F.concat(F.col("biggest.size").cast("string"), F.lit("@"), F.col("biggest.position").cast("string"), F.lit(":"), F.left("biggest.sha", F.lit(7)))
    line = F.concat_ws(
        " ", part("n", "n"), part("maxPos", "max_position"), part("ordered", "ordered"), part("verified", "verified"), part("failed", "failed"),
        part("positions", "positions"), part("origin", "origin"), part("patchBytes", "patch_bytes"),
        F.when(F.col("biggest").isNotNull(), part("biggestPatch", biggest)),
        F.when(stamped, part("oldest", iso_seconds(F.col("oldest")))), F.when(stamped, part("newest", iso_seconds(F.col("newest")))), F.when(stamped, part("ties", "ties")),
        F.when(F.col("first_error").isNotNull(), part("firstError", F.translate("first_error", "\t\n", "  "))),
    )
    return resolved.select("origin", "root", line.alias("report"))


def read_counters(rows: DataFrame, drop_payload: bool = False) -> dict[str, Column]:
    good = ~F.col("malformed")
    return {
        "RECORDS": F.count_if(good),
        "MALFORMED": F.count_if("malformed"),
        "WITH_PAYLOAD": F.count_if(good & (F.col("width") >= 8)),
        "WITH_TIMESTAMP": F.count_if(good & (F.col("width") >= 9)),
        "WITH_ORIGIN": F.count_if(good & (F.col("width") >= 10)),
        "PAYLOAD_DROPPED": F.count_if(good & (F.col("width") >= 8)) if drop_payload else F.lit(0).cast("long"),
    }


def _one_row(*frames: DataFrame) -> DataFrame:
    """The columns of frames of one row each in one row."""
    whole = frames[0]
    for other in frames[1:]:
        whole = whole.unionByName(other, allowMissingColumns=True)
    return whole.agg(*[F.max(c).alias(c) for c in whole.columns])


def _violations(found: DataFrame, placed: DataFrame | None) -> DataFrame:
    if placed is None:
        placed = found.select(*CHAIN).repartitionByRange(*CHAIN).sortWithinPartitions(*CHAIN)
    return group_order_violations(placed).agg(F.count(F.lit(1)).alias("GROUP_ORDER_VIOLATIONS"))


def resolve_counters(rows: DataFrame, resolved: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """One row of totals; each is there even when it is 0. ``placed``: the chains as delivered, whose order is checked."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    chains = resolved.agg(
        F.count(F.lit(1)).alias("GROUPS"), F.count_if(~F.col("ordered")).alias("OUT_OF_ORDER_GROUPS"),
        total("verified").alias("VERIFIED"), total("failed").alias("FAILED"), total("deltas_applied").alias("DELTAS_APPLIED"),
        total("no_payload").alias("NO_PAYLOAD"), total("ties").alias("TIED_RECORDS"), total("timestamped").alias("TIMESTAMPED_RECORDS"),
        total("size_mismatch").alias("SIZE_MISMATCH"), total("patch_bytes").alias("PATCH_BYTES"), F.count_if("origin_mismatch").alias("ORIGIN_MISMATCH"),
    )
    read = rows.agg(*[c.alias(n) for n, c in read_counters(rows).items()])
    return _one_row(read, chains, _violations(resolved, placed))


def top_k(rows: DataFrame, k: int = DEFAULT_K, keys: list[str] = CHAIN) -> DataFrame:
    """One row per chain: n, deltas, kept, patch_bytes, top_bytes and the ``k`` largest deltas (size, position, sha).

    The rank is limited per task before the shuffle (Spark's window group limit), the totals are partial sums; the
    payload is in neither.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if "malformed" in rows.columns:
        rows = rows.filter(~F.col("malformed"))
    facts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_delta()).alias("deltas"), F.coalesce(F.sum(F.when(is_delta(), F.col("size"))), F.lit(0)).alias("patch_bytes")
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("size"), "position", "sha"))
    best = rows.filter(is_delta()).select(*keys, "size", "position", "sha").withColumn("rank", rank).filter(F.col("rank") <= k)
    kept = best.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("kept"), F.sum("size").alias("top_bytes"), F.sort_array(F.collect_list(F.struct("rank", "size", "position", "sha"))).alias("top")
    )
    return facts.join(kept, keys, "left").fillna(0, ["kept", "top_bytes"]).withColumn("k", F.lit(k))


def top_list(top: Column | str = "top") -> Column:
    one = lambda t: F.concat(t["size"].cast("string"), F.lit("@"), t["position"].cast("string"), F.lit(":"), F.left(t["sha"], F.lit(7)))
    return F.coalesce(F.array_join(F.transform(top, one), ","), F.lit("-"))


def top_k_mismatches(rows: DataFrame, reports: DataFrame, k: int) -> DataFrame:
    """Chains whose report line (root, report) is not what sorting all deltas and cutting the list gives: wrong lines,
    repeated, unknown and missing chains."""
    good = rows.filter(~F.col("malformed"))
    deltas = F.sort_array(F.collect_list(F.when(is_delta(), F.struct((-F.col("size")).alias("less"), F.col("position"), F.col("sha"), F.col("size")))))
    whole = good.groupBy(*CHAIN).agg(F.count(F.lit(1)).alias("n"), deltas.alias("deltas"))
    total = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda acc, d: acc + d["size"])
    kept = F.slice("deltas", 1, k)
    one = lambda d: F.concat(d["size"].cast("string"), F.lit("@"), d["position"].cast("string"), F.lit(":"), F.left(d["sha"], F.lit(7)))
    part = lambda name, value: F.concat(F.lit(f"{name}="), value.cast("string"))
    line = F.concat_ws(
        " ", part("n", F.col("n")), part("deltas", F.size("deltas")), part("k", F.lit(k)), part("kept", F.size(kept)), part("patchBytes", total("deltas")),
        part("topBytes", total(kept)), F.concat(F.lit("top="), F.when(F.size("deltas") > 0, F.array_join(F.transform(kept, one), ",")).otherwise("-")), part("origin", F.col("origin")),
    )
    wanted = whole.select(F.col("root").alias("want_root"), line.alias("want"))
    seen = reports.groupBy("root").agg(F.min("report").alias("report"), F.count(F.lit(1)).alias("lines"))
    both = seen.join(wanted, F.col("root") == F.col("want_root"), "full_outer")
    wrong = F.col("root").isNull() | F.col("want_root").isNull() | (F.col("lines") > 1) | (F.col("report") != F.col("want"))
    return both.filter(wrong).select(F.coalesce("root", "want_root").alias("root"), "report", "want", "lines")


def top_k_text(found: DataFrame) -> DataFrame:
    names = {"n": "n", "deltas": "deltas", "k": "k", "kept": "kept", "patchBytes": "patch_bytes", "topBytes": "top_bytes"}
    parts = [F.concat(F.lit(f"{a}="), F.col(b).cast("string")) for a, b in names.items()]
    line = F.concat_ws(" ", *parts, F.concat(F.lit("top="), top_list()), F.concat(F.lit("origin="), F.col("origin").cast("string")))
    return found.select("origin", "root", line.alias("report"))


def heap_counters(rows: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """origin, root, offered, accepted, evicted, rejected of a heap of ``k`` that is offered a chain's deltas in chain order.

    A delta is accepted if it is among the ``k`` largest so far; then the smallest held goes if there are more. So
    offered = accepted + rejected, and accepted - evicted are kept. One streamed pass that holds ``k`` deltas.
    """
    if k < 1:
        raise ValueError("k must be at least 1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, heap, counts = None, [], [0, 0, 0, 0]
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if chain != (row.origin, row.root):
                    if chain:
                        out.append((*chain, *counts))
                    chain, heap, counts = (row.origin, row.root), [], [0, 0, 0, 0]
                item = (row.size, -row.position, [*(-ord(c) for c in row.sha), 1])
                counts[0] += 1
                if len(heap) < k:
                    heapq.heappush(heap, item)
                    counts[1] += 1
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
                    counts[1] += 1
                    counts[2] += 1
                else:
                    counts[3] += 1
            yield pd.DataFrame(out, columns=names)
        if chain:
            yield pd.DataFrame([(*chain, *counts)], columns=names)

    names = [*CHAIN, "offered", "accepted", "evicted", "rejected"]
    deltas = rows.filter(is_delta()).select(*CHAIN, "position", "size", "ts", "sha")
    ordered = deltas.repartition(*CHAIN).sortWithinPartitions(*chain_order())
    return ordered.mapInPandas(run, "origin long, root string, offered long, accepted long, evicted long, rejected long")


def report_fields(report: Column) -> Column:
    """A report line's ``name=value`` parts as a map."""
    return F.str_to_map(report, F.lit(" "), F.lit("="))


def top_k_counters(rows: DataFrame, found: DataFrame, k: int = DEFAULT_K, placed: DataFrame | None = None) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    chains = found.agg(
        F.count(F.lit(1)).alias("GROUPS"), total("deltas").alias("DELTAS"),
        total("kept").alias("KEPT"), total("patch_bytes").alias("PATCH_BYTES"), total("top_bytes").alias("TOP_BYTES"),
    )
    mismatch = F.count_if(~F.col("malformed") & (F.col("size_text") != F.col("size").cast("string"))).alias("SIZE_MISMATCH")
    read = rows.agg(*[c.alias(n) for n, c in read_counters(rows, drop_payload=True).items()], mismatch)
    heaps = heap_counters(rows.filter(~F.col("malformed")), k).agg(*[total(c).alias(c.upper()) for c in ("accepted", "evicted", "rejected")])
    return _one_row(read, chains, heaps, _violations(found, placed))
