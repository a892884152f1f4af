"""URL filter, toxicity, secret scan and pipeline."""

import hashlib
import itertools
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import secret_scan, toxicity, url_filter
from tidemill.llm.catalog import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, default=(0, None, None))[1:]


URLS = [None, "", "nothing", "http://", "HTTP://A.Example.COM/en/7?x", "http://example.com/en/8", "http://com/en/", "http://xcom/en/", "http://a.example.net/de/8/9#z", "http://b.net/de/7", "http://É.org/es/a", "http://a.org?/es/", "x://y://z.com/en/"]


def test_url_filter(spark):
    rng = random.Random(1)
    spam = [f"http://{rng.choice(['win', 'free'])}-casino.example.xyz/promo/{i}?ref=a" for i in range(80)]
    fine = [f"http://{rng.choice(['win', 'news'])}.site{i % 7}.example.xyz/story/{i}?ref=a" for i in range(200)]
    new = ["http://x-casino.other.xyz/promo/1", "http://x.other.xyz/story/1"]
    urls = [*URLS, *spam, *fine, *new, *spam[:3]]
    pages = spark.createDataFrame([(i, u, "<html>", "rule") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    labels = spark.createDataFrame([(len(URLS) + i, 1, int(i < 80)) for i in range(280)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    found = {r["page_id"]: r for r in url_filter.judge_urls(pages, labels).collect()}
    assert len(found) == len(urls)
    for i, u in enumerate(urls):
        host, path, (rule, verdict) = plain_rule(u)
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule), u
        if rule:
            assert found[i]["verdict"] == verdict
    at = len(URLS)
    assert {found[i]["verdict"] for i in range(at, at + 80)} == {"block"} and {found[i]["verdict"] for i in range(at + 80, at + 280)} == {"allow"}
    assert (found[at + 280]["verdict"], found[at + 281]["verdict"]) == ("block", "allow")
    assert {found[i]["verdict"] for i in (0, 1, 2, 3)} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), labels.limit(0)).count() == 0


def test_mined_rules_are_pruned(spark):
    rows = [(["a", "b"], True)] * 60 + [(["a", "c"], True)] * 60 + [(["d"], False)] * 60
    rules = url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean")).collect()
    assert ["a"] in [r["tokens"] for r in rules] and not any(len(r["tokens"]) > 1 and "a" in r["tokens"] for r in rules)


def plain_rules(rows, min_support, min_confidence, min_lift):
    """All sets of tokens with their confidence, by enumeration, pruned as ``mine_rules`` says."""
    n, base = len(rows), sum(b for _, b in rows) / len(rows)
    support = max(min_support, url_filter.MIN_ROWS / n)
    least = max(min_confidence, min_lift * base)
    found = {}
    for tokens, _ in rows:
        for size in range(1, len(tokens) + 1):
            for part in itertools.combinations(sorted(tokens), size):
                if part not in found:
                    inside = [b for t, b in rows if set(part) <= set(t)]
                    found[part] = sum(inside) / len(inside) if sum(inside) >= support * n else 0
    good = {p: c for p, c in found.items() if c >= least}
    matches = lambda p: frozenset(i for i, (t, _) in enumerate(rows) if set(p) <= set(t))
    return {matches(p) for p, c in good.items() if not any(set(q) < set(p) and d >= c for q, d in good.items())}


def test_rules_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(500):
        tokens = {f"t{i}" for i in range(7) if rng.random() < 0.45}
        tokens |= {"twin"} if "t1" in tokens else set()
        bad = {"t1", "t2"} <= tokens and rng.random() < 0.9 or "t5" in tokens and "t3" not in tokens and rng.random() < 0.5 or rng.random() < 0.1
        rows.append((sorted(tokens), bool(bad)))
    frame = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    for confidence, lift in ((0.8, 1.5), (0.5, 1.0), (0.5, 2.2)):
        mined = {frozenset(i for i, (t, _) in enumerate(rows) if set(r["tokens"]) <= set(t)) for r in url_filter.mine_rules(frame, 0.02, confidence, lift).collect()}
        assert mined == plain_rules(rows, 0.02, confidence, lift)
    noise = spark.createDataFrame([(["a", f"b{i % 3}"], i % 4 == 0) for i in range(400)], "tokens array<string>, blocked boolean")
    assert url_filter.mine_rules(noise).count() == 0 and url_filter.mine_rules(noise, 0.02, 0.1).count() == 0


def test_late_tokens_of_long_urls_are_mined(spark):
    """A word behind twelve others, and one of a host label without a hyphen; very long URLs."""
    urls = [f"http://a.b.c.d.e{i % 30}.xyz/{'/'.join('uvwxyz'[: i % 7])}/k{i % 11}/l/m/n/o/p/q/{'bad' if i % 2 else 'good'}" for i in range(300)]
    urls += ["http://casino.z.xyz/", "http://a.xyz/" + "long/" * 20_000 + "bad", "http://" + "h" * 50_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    verdict = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, labels).collect()}
    assert [verdict[i] for i in range(300)] == ["block" if i % 2 else "allow" for i in range(300)]
    assert (verdict[300], verdict[301], verdict[302]) == ("allow", "block", "allow")
    words = spark.createDataFrame([("http://casino.z",), ("http://big-casino.z",)], "url string").select(url_filter.url_tokens(F.col("url"), *url_filter.parse_url(F.col("url"))).alias("t"))
    assert all("w:casino" in r["t"] for r in words.collect())


def test_toxicity(spark):
    rng = random.Random(8)
    plain = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(plain, k=30)
        bad = i % 6 == 0
        if bad:
            words[3:5] = ["insult", "group"]
        elif i % 6 == 1:
            words[3] = "insult"
        elif i % 6 == 2:
            words[3] = "group"
        rows.append((i, " ".join(words), "x", 1.0))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None, "x", 1.0), (5001, "", "x", 1.0), (None, "w1", "x", 1.0), (0, rows[0][1], "x", 1.0), (5002, "w1 " * 50_000, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score_ double")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    found = toxicity.toxicity_scores(docs, model).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in found if r["held_out"] and r["doc_id"] < 900]
    right = sum(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held)
    assert right / len(held) > 0.97  # a pair is toxic where each word alone is not: no additive score does this
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.filter(F.col("text").contains("insult group")).count() < 5
    none = toxicity.train(docs, marks.limit(0))
    assert none.score("insult group") < 0.5
    assert toxicity.toxicity_scores(docs.limit(0), none).count() == 0


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    model = toxicity.FactorizationMachine(0.3, rng.normal(0, 1, 9), rng.normal(0, 1, (9, toxicity.FACTORS)), np.arange(9))
    for at in ([], [4], [0, 3, 8], list(range(9))):
        z = model.bias + sum(model.weight[i] for i in at) + sum(model.factor[i] @ model.factor[j] for i in at for j in at if i < j)
        assert abs(model.probability(np.array([-1, *at], np.int64)) - 1 / (1 + np.exp(-z))) < 1e-9


def test_labels_of_repeated_ids_and_documents(spark):
    """Repeated ids never give more rows than the sample's bound, and partitioning does not change the model."""
    rows = [(i % 40, f"word{chr(97 + i % 23)} {'bad' if i % 40 < 9 else 'good'} thing") for i in range(400)] + [(None, "bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, int(i < 9)) for i in range(40)] * 2, "doc_id long, quality int, toxic int")
    a, b = (toxicity.train(docs.repartition(n), marks.repartition(n)) for n in (1, 5))
    assert a.bias == b.bias and (a.weight == b.weight).all() and a.score("bad thing") > a.score("good thing")


def test_stages_on_empty_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_pair_of_words_that_tell_nothing_alone():
    """Two words each in 600 texts toxic at the base rate, and together in 30 more, all toxic."""
    rng = random.Random(2)
    texts = []
    for i in range(12_000):
        words, bad = {f"w{rng.randrange(4000)}" for _ in range(20)}, i % 10 == 0
        if i < 30:
            words, bad = words | {"left", "right"}, True
        elif i < 1230:
            words.add("left" if i < 630 else "right")
        texts.append((" ".join(sorted(words)).replace("0", "a").translate(str.maketrans("123456789", "bcdefghij")), bad))
    rows = [np.array(toxicity.terms_of(t)) for t, _ in texts]
    model = toxicity.fit(rows, np.array([bad for _, bad in texts], float))
    assert model.score("left right other") > 0.9
    assert max(model.score(t) for t in ("left", "right", "other", "left other")) < 0.3


def plain_base(text):
    text, spans = text or "", []
    for rank, (pattern, least, group) in enumerate([(secret_scan.ASSIGN, 12, 2), (r"AKIA[A-Z0-9]+", 18, 0), (r"[0-9a-f]+", 16, 0)]):
        spans += [(m.start(), rank, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(spans)


KEY = "AKIA" + "ABCDEFGHIJ234567"
SECRETS = [
    None, "", "nothing here", 'password = "abcdefghijkl" and SECRET:0123456789abcdef0', "secret: token: abcdefghijklmn", "é🙂 api_key='ABCDEFGHIJKL.=' x", KEY + " " + "AKIASHORT", "deadbeef" * 400,
    "passwd=short12 x", f"{KEY}\npasswd=short12 https://api.example.com/v1", "user=joe token=abcdef", "user=joe", "token=abcdef " + "x" * 400 + " user=joe", "token=" * 30, "AKIA" * 9, ("token=abcdefabcdef12 " * 700),
    "apikey=aaaaaaaaaaaa apiKEY: bbbbbbbbbbbbb",
]


def test_secret_spans(spark):
    rng = random.Random(6)
    bits = ["password", "token", "api_key", "=", ":", " ", '"', "'", "abcdef012345", "AKIA", "ABCDEFGH12", "é", "🙂", "\n", "user=joe", "https://a.bc/d", "Zz9" * 11]
    texts = [*SECRETS, *["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(150)]]
    docs = spark.createDataFrame([(i, t, "c", "d") for i, t in enumerate(texts)], "doc_id long, text string, spans string, parts string")
    for r in secret_scan.secret_report(docs).collect():
        base = plain_base(texts[r["doc_id"]])
        names = [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in base) for n in range(3)], texts[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and x.split(":")[0] in secret_scan.BASE] == names
    by_text = {texts[r["doc_id"]]: r["spans"] for r in secret_scan.secret_report(docs).collect()}
    assert by_text["passwd=short12 x"] == by_text["user=joe"] == "" and "weak" not in by_text[SECRETS[12]]
    assert by_text["user=joe token=abcdef"] == "ident:0:8,weak:9:21"
    assert [x.split(":")[0] for x in by_text[SECRETS[9]].split(",")] == ["access", "weak", "endpoint"]
    assert secret_scan.secret_report(docs.limit(0)).count() == 0


def plain_links(parts):
    """Spans and credentials of (start, rank, end) parts, by comparing all parts with each other."""
    gap = lambda p, q: max(0, q[0] - p[2], p[0] - q[2])
    near = lambda p, ranks, scope: any(q[1] in ranks and (q[2] > p[0] - scope and q[0] < p[2] + scope) for q in parts)
    scope = secret_scan.SCOPE
    spans = []
    for p in parts:
        ident, secret = near(p, (1, 3), scope), near(p, (0, 4), scope)
        needed = {3: secret, 4: ident, 5: ident and secret}.get(p[1], True)
        if p[1] <= 2 or needed and not near(p, (0, 1, 2), 0):
            spans.append(p)
    credentials = []
    for i, p in enumerate(spans):
        if p[1] in (0, 4):

            def nearest(ranks, i=i, p=p):
                at = [[j for j, q in enumerate(spans) if q[1] in ranks and j < i][-1:], [j for j, q in enumerate(spans) if q[1] in ranks and j > i][:1]]
                return min(((gap(p, spans[j]), side, j) for side, js in enumerate(at) for j in js if gap(p, spans[j]) < scope), default=(0, 0, None))[2]

            if nearest((1, 3)) is not None:
                credentials.append((nearest((1, 3)), i, nearest((5,))))
    return spans, credentials


def test_links_against_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(120):
        parts, at = [], 0
        for _ in range(rng.randint(0, 25) if i % 10 else 600):
            at += rng.choice([5, 50, 299, 300, 301, 900])
            parts.append((at, rng.randrange(6), at + rng.choice([3, 20, 100])))
        rows.append((i, sorted(parts)))
    df = spark.createDataFrame(rows, "row_ long, parts_ array<struct<start:long,rank:int,end:long>>")
    linked = 0
    for r in secret_scan._linked(df).select("row_", "spans_", "credentials_").collect():
        spans, credentials = plain_links(rows[r["row_"]][1])
        assert [tuple(s) for s in r["spans_"]] == spans
        assert [tuple(c) for c in r["credentials_"]] == credentials
        linked += len(credentials)
    assert linked > 100


def test_credentials(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(SECRETS)], "doc_id long, text string")
    got = {SECRETS[r["doc_id"]]: r["credentials"] for r in secret_scan.secret_report(docs).collect()}
    assert got["user=joe token=abcdef"] == "ident:0:8+weak:9:21" and got["user=joe"] == got[""] == got[None] == ""
    assert got[SECRETS[9]] == "access:0:20+weak:21:35+endpoint:36:62"


def test_running_totals(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        row = spark.range(1).select(F.expr(f"transform(sequence(1, 1000), x -> CAST(x % 7 AS BIGINT))").alias("v")).select(F.slice("v", 1, n).alias("v"))
        got = row.select(F.expr(secret_scan.running("v", "{a} + {b}", 0)).alias("r")).first()["r"]
        want, total = [], 0
        for x in range(1, n + 1):
            total += x % 7
            want.append(total)
        assert got == want


def test_redaction(spark):
    docs = spark.createDataFrame([(i, t, len(t or ""), "a", "b", "c") for i, t in enumerate(SECRETS)], "doc_id long, text string, n_chars long, spans_ string, row_ string, text_ string")
    assert secret_scan.redact(docs).columns == docs.columns
    for r in secret_scan.redact(docs).collect():
        before, after = SECRETS[r["doc_id"]], r["text"]
        if not plain_base(before) and "user" not in (before or ""):
            assert after == before
        assert not plain_base(after) and r["n_chars"] == len(after or "")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = QUERIES[name](spark, SMALL).toPandas(), con.execute(ORACLE_SQL[name]).df()
    rows = lambda f: sorted(tuple(map(str, r)) for r in f[sorted(f.columns)].astype(object).values.tolist())
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, left = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SMALL)
        assert left.columns == columns, name
        left = left.checkpoint()
    texts = [re.sub(r"\s", "", r["text"]) for r in left.collect()]
    assert 0 < len(texts) == len(set(texts)) <= docs.count()
    packed = corpus_pipeline.run(spark, SMALL)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in left.collect()}
