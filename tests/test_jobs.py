"""Edge-case and golden fixtures of FIXTURES.md."""

import base64
import re
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemill.operators import chains, history, topology
from tidemill.plans import jobs
from tidemill.sources import files

FIXTURES = (Path(__file__).resolve().parents[1] / "FIXTURES.md").read_text()
BLOCKS = re.findall(r"```\n(.*?)```", FIXTURES, re.S)
TEXT, INDEXED, TEMPERATURES, GOLDEN, LISTING, RESOLVED, TOP2 = BLOCKS[:7]
CHAIN = "f0e9ea9cdcd1c7d022373365088a65e94c5ab13e"


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    write.folder = str(tmp_path)
    return write


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_text_metrics(spark, put):
    path = put("t.txt", TEXT)
    assert rows(jobs.text_metrics(spark, path, "A")) == [("ahab", 2), ("caf", 1), ("captain", 1), ("s", 1), ("ship", 2), ("the", 1)]
    assert rows(jobs.text_metrics(spark, path, "B")) == [("ahab", 2), ("captain", 1)]
    assert rows(jobs.text_metrics(spark, path, "C")) == [("1,s", 1), ("3,e", 1), ("3,f", 1), ("4,b", 1), ("4,p", 1), ("7,n", 1)]
    with pytest.raises(ValueError):
        jobs.text_metrics(spark, path, "D")


def test_field_indexer(spark, put):
    path = put("i.csv", INDEXED)
    assert rows(jobs.field_indexer(spark, path, "A")) == [
        ("extraordinary", "3, 7"), ("mel", "7"), ("misunderstandings", "3"), ("the", "7"), ("ville", "7"), ("whale", "3, 7, 12"), ("x", "12"), ("y", "12"),
    ]
    assert rows(jobs.field_indexer(spark, path, "B")) == [("extraordinary", 2)]


def test_averages_and_joins(spark, put):
    put("dataset.csv", TEMPERATURES)
    put("dataset2.csv", "State,Capital,Type\nArizona,Phoenix,x\nNew York,Albany,x\nAlaska,Juneau,x\nHawaii,Honolulu,x\n")
    assert rows(jobs.group_by_average(spark, put.folder)) == [("Alaska", "1996", "0.13"), ("Arizona", "1995", "64.00")]
    want = [("Alaska", "Juneau", "0.13"), ("Arizona", "Phoenix", "30.40"), ("New York", "Albany", "30.13")]
    for strategy in ("broadcast", "merge", "shuffle_hash", "auto"):
        assert rows(jobs.capital_average(spark, put.folder, strategy)) == want


def test_join_plans(spark, put):
    put("dataset.csv", TEMPERATURES)
    put("dataset2.csv", "State,Capital\nArizona,Phoenix\n")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(jobs.map_side_join(spark, put.folder))
    assert "SortMergeJoin" in plan(jobs.reduce_side_join(spark, put.folder))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("capital,state\nBoise,Idaho\n", [("Idaho", "Boise")]),
        ("Idaho,Boise\n", [("Idaho", "Boise")]),
        ("\n  \nState,Capital\nIdaho,Boise\n", [("Idaho", "Boise")]),
        ("Idaho,Boise\nIdaho,Nampa\n", [("Idaho", "Nampa")]),
        (",Boise\nIdaho,\n", []),
        ("", []),
    ],
)
def test_capitals(spark, put, text, want):
    assert rows(files.capitals(spark, put("c.csv", text))) == want


def test_missing_capitals(spark, put):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.capitals(spark, put.folder + "/none.csv").collect()


def golden(change=lambda cells: cells):
    return "".join("\t".join(c) + "\n" for line in GOLDEN.splitlines() for c in [change(line.split("\t"))] if c)


def resolved(spark, path):
    lines, counters = jobs.delta_chains(spark, path, partitions=2)
    return [f"{r[0]}\t{r[1]}" for r in lines.collect()], counters.first().asDict()


def test_golden_resolve_and_top_k(spark, put):
    path = put("g.tsv", GOLDEN)
    lines, counters = resolved(spark, path)
    assert lines == RESOLVED.splitlines()
    want = {"RECORDS": 9, "GROUPS": 6, "VERIFIED": 9, "FAILED": 0, "DELTAS_APPLIED": 3, "TIED_RECORDS": 0, "TIMESTAMPED_RECORDS": 7, "PATCH_BYTES": 38}
    assert {k: counters[k] for k in want} == want
    assert not any(counters[k] for k in ("MALFORMED", "NO_PAYLOAD", "SIZE_MISMATCH", "ORIGIN_MISMATCH", "OUT_OF_ORDER_GROUPS", "GROUP_ORDER_VIOLATIONS"))
    lines, counters = jobs.delta_chains(spark, path, k=2, partitions=2)
    assert [f"{r[0]}\t{r[1]}" for r in lines.collect()] == TOP2.splitlines()
    row = counters.first().asDict()
    assert (row["DELTAS"], row["TOP_BYTES"], row["PAYLOAD_DROPPED"]) == (3, 29, 9)


def mutate(sha, **cells):
    def change(c):
        if c[2].startswith(sha):
            c = list(c)
            for k, v in cells.items():
                c[int(k[1:])] = v
        return c

    return change


@pytest.mark.parametrize(
    ("change", "parts", "counters"),
    [
        (lambda c: c[:7], ["verified=0 failed=0", "patchBytes=0"], {"NO_PAYLOAD": 9}),
        (mutate("8c18e67", _7="!!"), ["verified=2 failed=2", "patchBytes=38"], {"FAILED": 2}),
        (mutate("c167f36", _5="10"), ["verified=3 failed=1", "patchBytes=39"], {"FAILED": 1}),
        (mutate("c167f36", _7="GAUA", _5="3"), ["reserved delta opcode 0"], {"FAILED": 1}),
        (mutate("8c18e67", _5="011"), ["verified=4 failed=0"], {"SIZE_MISMATCH": 1}),
        (lambda c: None if c[2].startswith("8c18e67") else c, ["n=3", "verified=2 failed=1", "not resolved"], {"FAILED": 1}),
        (lambda c: [*c[:9], "1000000001"] if c[0] == CHAIN else c, ["origin=1000000001"], {"ORIGIN_MISMATCH": 1}),
    ],
)
def test_mutations(spark, put, change, parts, counters):
    lines, found = resolved(spark, put("m.tsv", golden(change)))
    line = next(x for x in lines if x.startswith(CHAIN))
    assert all(p in line for p in parts), line
    assert {k: found[k] for k in counters} == counters
    if len(change(GOLDEN.splitlines()[0].split("\t"))) == 7:
        assert "oldest" not in line and "ties" not in line and "biggestPatch" not in line


def test_malformed_and_ties(spark, put):
    extra = "a\tx\tb\t-\tblob\t1\t1\n" + "a\t1\tb\t-\tblob\t1\n" + "a\t 5 \tb\t-\tblob\t1\t1\n" + "\n"
    twice = next(x for x in GOLDEN.splitlines() if "c167f36" in x) + "\n"
    lines, counters = resolved(spark, put("t.tsv", GOLDEN + twice + extra))
    line = next(x for x in lines if x.startswith(CHAIN))
    assert counters["MALFORMED"] == 3 and counters["TIED_RECORDS"] == 1
    assert "n=5" in line and "ties=1" in line and "positions=0x1,1x3,2x1" in line


def test_topology(spark, put):
    path = put("l.txt", LISTING)
    found = {r["sha"]: (r["root"], r["position"]) for r in jobs.topology_pre_pass(spark, path).collect()}
    want = {line.split("\t")[2]: (line.split("\t")[0], int(line.split("\t")[1])) for line in GOLDEN.splitlines()}
    assert found == want
    with pytest.raises(ValueError, match="differ"):
        jobs.topology_pre_pass(spark, put("w.txt", LISTING.replace("chain length = 2: 1 object", "chain length = 2: 2 objects")))


def test_closure_errors_and_depth(spark):
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(120)], "sha string, base_sha string")
    deep = {r["sha"]: (r["root"], r["depth"]) for r in topology.close_chains(chain).collect()}
    assert deep == {str(i): ("0", i) for i in range(120)}
    with pytest.raises(ValueError, match="not in the listing"):
        topology.close_chains(spark.createDataFrame([("a", "z")], "sha string, base_sha string"))
    with pytest.raises(ValueError, match="cycle"):
        topology.close_chains(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "sha string, base_sha string"))


def test_annotators(spark, put):
    eight = put("8.tsv", golden(lambda c: c[:8]))
    nine = jobs.timestamp_annotator(spark, eight)
    want = {line.split("\t")[2]: (int(line.split("\t")[8]), int(line.split("\t")[9])) for line in GOLDEN.splitlines()}
    assert {r["sha"]: r["ts"] for r in nine.collect()} == {k: v[0] for k, v in want.items()}
    ten = jobs.origin_annotator(spark, put("9.tsv", golden(lambda c: c[:9])))
    assert {r["sha"]: r["origin"] for r in ten.collect()} == {k: v[1] for k, v in want.items()}
    report = history.time_report(nine).first()
    assert (report["reached"], report["unreached"]) == (7, 2)


def test_range_partitions_hold_whole_chains(spark, put):
    ordered = chains.total_order(files.read_chain(spark, put("g.tsv", GOLDEN)), 3)
    parts = ordered.select("root", F.spark_partition_id().alias("p")).distinct().groupBy("root").count()
    assert parts.filter("count > 1").count() == 0


def test_top_k_against_sort_then_cut(spark):
    data = [("r%d" % (i % 5), i % 3, "s%d" % i, "-" if i % 7 == 0 else "b", (i * 37) % 11) for i in range(200)]
    df = spark.createDataFrame(data, "root string, position long, sha string, base_sha string, size long")
    for k in (1, 2, 5, 50):
        for r in chains.top_k(df, k, ["root"]).collect():
            want = sorted((-s, p, h) for root, p, h, b, s in data if root == r["root"] and b != "-")[:k]
            assert [(-t["size"], t["position"], t["sha"]) for t in r["top"]] == want
    with pytest.raises(ValueError):
        chains.top_k(df, 0, ["root"])


def test_command_line(spark, put):
    put("dataset.csv", TEMPERATURES)
    assert jobs.main(["group_by_average", put.folder, put.folder + "/out"]) == 0
    found = "".join(p.read_text() for p in Path(put.folder, "out").glob("part-*"))
    assert found == "Alaska\t1996\t0.13\nArizona\t1995\t64.00\n"
    assert jobs.main(["text_metrics", "a", "b", "Z"]) == 2
    assert jobs.main(["nothing"]) == 2


def test_verifiers(spark, put):
    path = put("g.tsv", GOLDEN)
    assert jobs.payload_verifier(spark, put("8.tsv", golden(lambda c: c[:8]))).count() == 0
    bad = jobs.payload_verifier(spark, put("b.tsv", golden(lambda c: mutate("c167f36", _5="10")(c)[:8]))).collect()
    assert [r["sha"][:7] for r in bad] == ["c167f36"]
    lines, _ = jobs.delta_chains(spark, path, k=2)
    jobs.write_tsv(lines, put.folder + "/top")
    assert jobs.top_k_verifier(spark, path, put.folder + "/top", 2).count() == 0
    wrong = TOP2.replace("topBytes=29", "topBytes=28").splitlines()
    put("w.txt", "\n".join([*wrong[1:], wrong[1], "unknown\tn=1"]) + "\n")
    found = {r["root"] for r in jobs.top_k_verifier(spark, path, put.folder + "/w.txt", 2).collect()}
    assert found == {wrong[0].split("\t")[0], wrong[1].split("\t")[0], CHAIN, "unknown"}


def test_pack_verifier(spark, put):
    pack, rows = b"PACK", []
    for line in GOLDEN.splitlines():
        c = line.split("\t")
        data = base64.b64decode(c[7])
        kind = {"commit": 1, "tree": 2, "blob": 3, "tag": 4}[c[4]] if c[3] == "-" else 7
        n, head = len(data) >> 4, kind << 4 | len(data) & 15
        rows.append([*c[:6], str(len(pack))])
        pack += (bytes([head | 128, n]) if n else bytes([head])) + (bytes.fromhex(c[3]) if kind == 7 else b"") + zlib.compress(data)
    Path(put.folder, "a.pack").write_bytes(pack)
    source = put("7.tsv", "".join("\t".join(r) + "\n" for r in rows))
    assert jobs.pack_verifier(spark, source, put.folder + "/a.pack").count() == 0
    rows[5][2] = "0" * 40
    errors = jobs.pack_verifier(spark, put("x.tsv", "".join("\t".join(r) + "\n" for r in rows)), put.folder + "/a.pack").collect()
    assert len(errors) == 4 and any("sha mismatch" in r["error"] for r in errors)


def test_sample_and_bounds(spark, put):
    rows = files.read_chain(spark, put("g.tsv", GOLDEN))
    pick = lambda df: sorted(r["sha"] for r in chains.seeded_sample(df, 4).collect())
    assert pick(rows) == pick(rows.repartition(3)) and len(pick(rows)) == 4
    bounds = chains.partition_bounds(rows, 3)
    assert bounds == sorted(set(bounds)) and len(bounds) == 2
    assert len(chains.partition_bounds(rows.filter(F.col("root") == CHAIN), 5)) == 1
    for wrong in (lambda: chains.partition_bounds(rows, 1), lambda: chains.partition_bounds(rows.limit(0), 3), lambda: chains.seeded_sample(rows, 0)):
        with pytest.raises(ValueError):
            wrong()
    assert chains.group_order_violations(chains.total_order(rows, 2)).count() == 0
    assert chains.group_order_violations(rows.coalesce(1).sortWithinPartitions(F.desc("origin"), "root")).count() > 0
