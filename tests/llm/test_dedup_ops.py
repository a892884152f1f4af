"""Exact and near deduplication, components and search against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemill.llm import bm25_search, exact_dedup, graph, simhash_dedup

DOCS = "doc_id long, text string, text_key string, row_ string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0d]", "", text or "")


COPIES = [(1, "a b c"), (2, "abc"), (3, "a  b  c"), (4, None), (5, ""), (6, " \t"), (7, "x\u00a0y"), (8, "xy"), (9, "a  b  c"), (9, "a  b  c"), (10, "z" * 50_000), (11, "z " * 50_000), (None, "abc")]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    kind = (lambda norm: F.length(norm).cast("string").cast("binary")) if weak else exact_dedup.content_hash
    found = exact_dedup.exact_dedup(frame(spark, COPIES), hashed=kind).collect()
    assert len(found) == len(COPIES)
    groups = {}
    for i, t in COPIES:
        groups.setdefault(squeezed(t), []).append((-len(t or ""), i is None, i or 0, i))
    for r in found:
        group = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        assert (r["group_size"], r["keep_id"]) == (len(group), min(group)[3])
    for k in groups:
        assert sum(r["kept"] for r in found if r["text_sha256"] == hashlib.sha256(k.encode()).hexdigest()) == 1


def test_drop_exact_copies(spark):
    left = exact_dedup.drop_exact_copies(frame(spark, COPIES))
    assert left.columns == ["doc_id", "text", "text_key", "row_"]
    assert sorted((r["doc_id"], len(r["text"] or "")) for r in left.collect()) == [(3, 7), (6, 2), (7, 3), (8, 2), (11, 100_000)]
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(prints))]


def test_simhash_values(spark):
    texts = [None, "", "  ", "One", "one TWO", "a b c", "É é e\u00a0x y z", "w " * 40_000, "\x1c a b c d"]
    assert [simhash_dedup.simhash(t) for t in texts] == [plain_simhash(t) for t in texts]
    spark_hash = spark.createDataFrame([("a b c",)], "t string").select(F.hex(F.xxhash64("t"))).first()[0]
    assert int(spark_hash, 16) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_components_of_texts(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " ", "a", "a"]
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.randint(30, 200))
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            other = list(words)
            other[rng.randrange(len(other))] = "changed"
            texts.append(" ".join(other))
    ids = rng.sample(range(1000), len(texts))
    prints = [plain_simhash(t) for t in texts]
    root = plain_components(prints, 3)
    smallest = {r: min(i for i, x in zip(ids, root, strict=True) if x == r) for r in root}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_dedup.simhash_components(frame(spark, list(zip(ids, texts, strict=True)))).collect()}
    assert found == {i: (f"{p:016x}", smallest[r]) for i, p, r in zip(ids, prints, root, strict=True)}
    assert len(set(root)) < len(texts)


def test_near_copies(spark):
    """Texts of a similarity of 0.85 and more go but for one; those below 0.6 stay."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, group = ["", None, "one", "two words"], [0, 0, 1, 2]
    for g in range(3, 60):
        words = rng.choices(vocabulary, k=rng.randint(60, 300))
        for copy in range(rng.randint(1, 4)):
            other = list(words)
            if copy:
                for _ in range(len(words) // 80 + 1 if len(words) > 120 else 1):
                    other[rng.randrange(len(other))] = "changed"
            texts.append(" ".join(other))
            group.append(g)
    for g in range(60, 90):  # a third of the words are others
        words = rng.choices(vocabulary, k=100)
        other = [w if rng.random() < 0.67 else "other" for w in words]
        texts += [" ".join(words), " ".join(other)]
        group += [1000 + g, 2000 + g]
    left = simhash_dedup.drop_near_copies(frame(spark, list(enumerate(texts))))
    kept = [r["doc_id"] for r in left.collect()]
    assert left.columns == ["doc_id", "text", "text_key", "row_"]
    first = {g: group.index(g) for g in group}
    assert set(first.values()) <= set(kept) and len(kept) <= len(first) + 2


def plain_similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def pairs_of_texts(rng, count, words):
    """Pairs of texts that differ in one word: of 49 words, 40 of 50 shingles are shared; of 48, 39 of 49."""
    for _ in range(count):
        text = rng.sample(range(10**6), words)
        yield " ".join(map(str, text)), " ".join(map(str, [*text[:20], "changed", *text[21:]]))


def test_near_copies_at_the_threshold(spark):
    pairs = list(pairs_of_texts(random.Random(3), 150, 49))
    assert {plain_similarity(*p) for p in pairs} == {0.8}
    kept = simhash_dedup.drop_near_copies(frame(spark, list(enumerate(t for p in pairs for t in p)))).collect()
    assert [r["doc_id"] for r in sorted(kept)] == list(range(0, 300, 2))


def test_texts_below_the_threshold_stay(spark):
    """Links are confirmed on the sets: nothing below 0.8 goes, and no chain is made of such links."""
    texts = [t for p in pairs_of_texts(random.Random(4), 60, 48) for t in p]
    assert {plain_similarity(*p) for p in zip(texts[::2], texts[1::2], strict=True)} == {39 / 49}
    chain = [str(i) for i in range(300)]
    texts += [" ".join(chain[at : at + 200]) for at in range(0, 100, 30)]  # each shares 166 of 226 shingles with the next
    assert simhash_dedup.drop_near_copies(frame(spark, list(enumerate(texts)))).count() == len(texts)


def test_repeated_lines_count_once(spark):
    rng = random.Random(11)
    line = [str(rng.random()) for _ in range(20)]
    texts = [" ".join([*(str(rng.random()) for _ in range(300)), *line * 30]) for _ in range(12)]
    assert plain_similarity(*texts[:2]) < 0.05
    prints = [np.array(simhash_dedup.simhash_fields([simhash_dedup.shingle_set(t)], simhash_dedup.NEAR_FIELDS), np.uint64) for t in texts]
    assert all(simhash_dedup.distance(a, b) > simhash_dedup.NEAR_RADIUS for i, a in enumerate(prints) for b in prints[:i])
    assert simhash_dedup.drop_near_copies(frame(spark, list(enumerate(texts)))).count() == len(texts)


@pytest.mark.parametrize(("shard", "first"), [(7, 1), (4096, 2)])
def test_near_copies_in_rounds(spark, shard, first):
    """Every candidate pair of a large group is compared or inside a component, however few a round takes."""
    rng = random.Random(shard)
    base = [str(rng.random()) for _ in range(120)]
    texts = []
    for _ in range(90):
        other = list(base)
        for at in rng.sample(range(0, 120, 6), rng.choice([1, 2, 3])):
            other[at] = str(rng.random())
        texts.append(" ".join(other))
    label = list(range(90))
    for i in range(90):
        for j in range(i):
            if plain_similarity(texts[i], texts[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    found = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_copies(frame(spark, list(enumerate(texts))), shard=shard, first=first).collect()}
    assert found == {i: label.index(x) for i, x in enumerate(label)} and len(set(label)) > 1


def test_marks_tell_near_texts_from_far_ones(spark, monkeypatch):
    """Pairs of 0.8 agree on enough marks; a group of about 0.5 with one another gives next to no pairs to compare."""
    for a, b in pairs_of_texts(random.Random(6), 100, 49):
        both = [simhash_dedup.marks(simhash_dedup.minimal_hashes(simhash_dedup.shingle_set(t))).view(np.uint8) for t in (a, b)]
        assert (both[0] == both[1]).sum() >= simhash_dedup.NEAR_MARKS_LEAST
    rng = random.Random(6)
    base = [str(rng.random()) for _ in range(150)]
    texts = []
    for _ in range(60):
        other = list(base)
        for at in rng.sample(range(0, 150, 5), 9):
            other[at] = str(rng.random())
        texts.append(" ".join(other))
    compared = []
    plain = simhash_dedup._confirmed
    monkeypatch.setattr(simhash_dedup, "_confirmed", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    found = simhash_dedup.near_copies(frame(spark, list(enumerate(texts))))
    assert found.select("component_id").distinct().count() == 60
    assert sum(compared[1:]) <= 60 < 60 * 59 // 2  # after the stars


def edited(rng, base, edits):
    """``base`` with other words at ``edits`` places that share no shingle."""
    other = list(base)
    for at in rng.sample(range(4, len(base) - 4, 5), edits):
        other[at] = str(rng.random())
    return " ".join(other)


def test_large_group_just_below_the_threshold(spark, monkeypatch):
    """A group with 0.73 to 0.78 among its texts gives next to no pairs to compare after the stars; links in it are found."""
    rng = random.Random(16)
    base = [str(rng.random()) for _ in range(180)]
    texts = [edited(rng, base, 3) for _ in range(60)]
    texts += [texts[7] + " more", "first " + texts[30]]
    assert all(0.7 < plain_similarity(a, b) < 0.8 for i, a in enumerate(texts[:60]) for b in texts[:i])
    compared = []
    plain = simhash_dedup._confirmed
    monkeypatch.setattr(simhash_dedup, "_confirmed", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    found = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_copies(frame(spark, list(enumerate(texts)))).collect()}
    assert found == {i: i for i in range(60)} | {60: 7, 61: 30}
    assert sum(compared[1:]) <= 60 < 60 * 59 // 2


def test_parity_maps_exclude_no_link():
    rng = random.Random(17)
    sets = []
    for size in (1, 2, 9, 45, 150, 600, 3000):
        for _ in range(40):
            base = [rng.getrandbits(64) for _ in range(size)]
            apart = rng.randint(0, -(-size // 3))
            sets += [np.unique(np.array(x, np.uint64)) for x in (base, base[apart:] + [rng.getrandbits(64) for _ in range(rng.randint(0, apart))])]
    odd, sizes = np.stack([simhash_dedup.parity_map(x) if len(x) else np.zeros(simhash_dedup.NEAR_ODD // 64, np.uint64) for x in sets]), np.array(list(map(len, sets)))
    a = np.arange(0, len(sets), 2)
    shared = np.array([len(np.intersect1d(sets[i], sets[i + 1])) for i in a])
    similarity = shared / (sizes[a] + sizes[a + 1] - shared)
    allowed = simhash_dedup._may_link(odd, sizes, a, a + 1)
    assert allowed[similarity >= 0.8].all() and (similarity == 0.8).any() and not allowed[similarity < 0.7].any()


@pytest.mark.parametrize("shard", [8, 64, 4096])
def test_links_against_brute_force(spark, shard):
    rng = random.Random(shard)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:20]:  # dense balls and chains
        for _ in range(12):
            p ^= 1 << rng.randrange(64)
            prints.add(p)
            prints.add(p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    links = simhash_dedup.fingerprint_links(spark.createDataFrame([(x, x) for x in signed], "node long, w0 long"), simhash_dedup.block_keys(4), shard=shard)
    roots = {r["a"]: r["b"] for r in graph.connected_components(links).collect()}
    got = [roots.get(x, x) for x in signed]
    want = plain_components(prints, 3)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


@pytest.mark.parametrize("sizes", [[550], [5, 1, 2, 5, 300, 1, 3]])
def test_trees_link_all_and_follow_only_near_edges(sizes, monkeypatch):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 500).astype(np.uint64)
    values = np.unique(np.r_[values, values[:50] ^ np.uint64(5)])
    rng.shuffle(values)
    cells = np.repeat(np.arange(len(sizes)) * 3, sizes)
    values = values[: len(cells)]
    forest = simhash_dedup.BkForest(values[:, None], cells)
    assert len(forest.child) == len(values) - len(sizes)  # every value is a node: a cell of two and more branches
    parent, key = np.divmod(forest.edge, forest.span)
    assert (np.bitwise_count(values[parent] ^ values[forest.child]) == key).all() and (cells[parent] == cells[forest.child]).all()
    compared = 0
    plain = simhash_dedup.distance

    def counted(a, b):
        nonlocal compared
        compared += len(a)
        return plain(a, b)

    monkeypatch.setattr(simhash_dedup, "distance", counted)
    pairs = set()
    for i, j in forest.link(values[:, None], cells, 3):
        pairs |= set(zip(i.tolist(), j.tolist(), strict=True))
    assert pairs == {(i, j) for i in range(len(values)) for j in range(len(values)) if cells[i] == cells[j] and int(values[i] ^ values[j]).bit_count() <= 3}
    assert compared < sum(n * n for n in sizes)


def test_near_stage_on_nothing_and_null_ids(spark):
    assert simhash_dedup.simhash_components(frame(spark, [])).count() == 0
    assert simhash_dedup.drop_near_copies(frame(spark, [])).count() == 0
    words = " ".join(str(i) for i in range(100))
    rows = [(None, words), (4, words + " x"), (None, "alone"), (3, None), (2, " "), (7, "y " * 60_000)]
    named = {(r["doc_id"], r["component_id"]) for r in simhash_dedup.simhash_components(frame(spark, rows)).collect()}
    assert {(None, None), (3, 2), (2, 2), (7, 7)} <= named
    kept = sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in simhash_dedup.drop_near_copies(frame(spark, rows)).collect())
    assert kept == [(0, 5), (2, 1), (4, len(words) + 2), (7, 120_000)]


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    found = {r["a"]: r["b"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {x: found.get(x, x) for x in nodes} == label
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bm25(spark):
    rng = random.Random(4)
    words = [f"t{int(rng.paretovariate(0.7))}" for _ in range(6000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(220)] + [None, "", "t1 t1 t1", "t1 t1 t1"]
    texts[40] = texts[41] = " ".join(rng.choices(words, k=40_000))
    docs = frame(spark, [*enumerate(texts), (None, "t1 t2")])
    found = {}
    for r in bm25_search.bm25_top_k(docs, docs.filter("doc_id % 20 = 0"), 5, shard_postings=1500, query_terms=1500).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    terms = [bm25_search.terms_of(t) for t in texts]
    n, average = len(terms), sum(t.total() for t in terms) / len(terms)
    df = {w: sum(w in t for t in terms) for t in terms for w in t}
    for q in range(0, n, 20):
        scores = []
        for i, t in enumerate(terms):
            total = 0
            for w, c in terms[q].items():
                if w in t:
                    idf = np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    impact = t[w] * 2.2 / (t[w] + 1.2 * (0.25 + 0.75 * t.total() / average))
                    total += c * np.floor(idf * impact * bm25_search.UNIT + 0.5)
            if total:
                scores.append((-total, i))
        want = [(k + 1, i) for k, (_, i) in enumerate(sorted(scores)[:5])]
        assert [(k, i) for k, i, _ in sorted(found.get(q, []))] == want
    assert bm25_search.bm25_top_k(docs.limit(0), docs).count() == 0


@pytest.mark.parametrize("bounded", [True, False])
def test_frequent_terms_are_not_walked(bounded, monkeypatch):
    """Postings of terms of many documents are summed by matrix products; scores and ties are those of the plain sums."""
    rng = np.random.default_rng(8)
    docs, words, k = 1000, 60, 7
    tf = np.where(rng.random((docs, words)) < np.r_[np.full(20, 0.6), np.full(40, 0.03)], rng.integers(1, 4, (docs, words)), 0)
    tf[500:, :5] = 0  # blocks without some of the terms
    terms, idf = np.arange(words) * 7, rng.random(words) + 0.1
    rows, columns = np.nonzero(tf)
    ids, sizes = rng.permutation(docs), tf.sum(axis=1).astype(float)
    by_id = np.argsort(ids)
    index = bm25_search.ShardIndex(ids, sizes, (tf > 0).sum(axis=1), terms[columns], tf[rows, columns], sizes.mean(), terms, idf)
    norm = bm25_search.K1 * (1 - bm25_search.B + bm25_search.B * sizes / sizes.mean())
    units = np.floor(idf * (tf * (bm25_search.K1 + 1) / (tf + norm[:, None])) * bm25_search.UNIT + 0.5)[by_id]
    walked = []
    plain = bm25_search.ShardIndex._sparse_scores
    monkeypatch.setattr(bm25_search.ShardIndex, "_sparse_scores", lambda self, first, last, *rest: walked.append(int((last - first).sum())) or plain(self, first, last, *rest))
    monkeypatch.setattr(bm25_search.Bounds, "wanted", lambda self: bounded)
    for asked in (np.arange(words), np.arange(3), np.arange(30, 33), np.array([2, 40]), np.array([50])):
        times = rng.integers(1, 4, len(asked)).astype(float)
        scores = units[:, asked] @ times
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if s)[:k]
        walked.clear()
        found, got = index.search(asked, times, k, (np.zeros(0, np.int64), np.zeros(0)))
        assert [(-s, i) for i, s in zip(found.tolist(), got.tolist(), strict=True)] == want
        assert sum(walked) <= (tf[:, asked[asked >= 20]] > 0).sum()


@pytest.mark.parametrize("bounded", [True, False])
def test_sums_in_32_bits_choose_and_exact_ones_rank(bounded, monkeypatch):
    """Terms of one document in fourteen are in the 32-bit matrix; scores that such sums cannot tell apart are still ranked exactly."""
    rng = np.random.default_rng(5)
    docs, words = 1400, 40
    tf = np.where(rng.random((docs, words)) < np.r_[np.full(30, 0.7), np.full(10, 0.02)], 1, 0)
    tf[:, 28:30] = 0
    tf[::12, 28] = tf[5::13, 29] = 1
    tf[:60] = tf[0]  # a large group of ties
    tf[100:500, :28] = 1 - np.eye(28, dtype=int)[np.arange(400) % 14]  # each of 14 words is missing in turn
    terms, idf = np.sort(rng.integers(-(1 << 63), (1 << 63) - 1, words)), rng.random(words) * 8 + 0.1
    rows, columns = np.nonzero(tf)
    ids, sizes = rng.permutation(docs), rng.integers(1_000_000, 1_000_040, docs).astype(float)
    sizes[:60] = sizes[100:500] = 1_000_000
    idf[:28] = 2.5
    by_id = np.argsort(ids)
    index = bm25_search.ShardIndex(ids, sizes, tf.sum(axis=1), terms[columns], tf[rows, columns], sizes.mean(), terms, idf)
    assert index.dense.dtype == np.float32
    norm = bm25_search.K1 * (1 - bm25_search.B + bm25_search.B * sizes / sizes.mean())
    units = np.floor(idf * (tf * (bm25_search.K1 + 1) / (tf + norm[:, None])) * bm25_search.UNIT + 0.5)[by_id]
    walked = []
    plain = bm25_search.ShardIndex._sparse_scores
    monkeypatch.setattr(bm25_search.ShardIndex, "_sparse_scores", lambda self, first, last, *rest: walked.append(int((last - first).sum())) or plain(self, first, last, *rest))
    monkeypatch.setattr(bm25_search.Bounds, "wanted", lambda self: bounded)
    some = [(asked, rng.integers(1, 9000, len(asked))) for asked in (np.arange(words), rng.permutation(words)[:25], np.array([28]), np.array([28, 29]), np.array([35, 2]))]
    some += [(np.arange(28), np.r_[(1 << 23) + rng.permutation(14), rng.integers(1 << 22, 1 << 23, 14)]) for _ in range(5)]  # the missing words differ by one time
    for k, (asked, times) in ((k, x) for k in (1, 2, 9) for x in some):
        times = times.astype(float)
        scores = units[:, asked] @ times
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if s)[:k]
        walked.clear()
        found, got = index.search(asked, times, k, (np.zeros(0, np.int64), np.zeros(0)))
        assert [(-s, i) for i, s in zip(found.tolist(), got.tolist(), strict=True)] == want
        assert sum(walked) <= (tf[:, asked[asked >= 30]] > 0).sum()


def test_a_task_gives_one_row_for_a_query():
    """Batches and shards of a task are merged: a query has one row with its best, and none if nothing answers it."""
    docs = [{1: 2, 5: 1}, {5: 3}, {}, {1: 1}, {1: 2, 5: 1}, {9: 4}]
    terms, idf = np.array([1, 5, 7]), np.array([1.5, 0.5, 2.0])
    asked = [{1: 1, 5: 2}, {7: 3}, {5: 1}]
    edge = np.r_[0, np.cumsum([len(q) for q in asked])]
    flat = [(int(np.searchsorted(terms, t)), c) for q in asked for t, c in q.items()]

    class Sent:
        value = (np.array([3, 4, 8]), np.array([30, 40, 80]), edge, *np.array(flat, np.int32).T, terms, idf)

    def batch(start, stop):
        part = docs[start:stop]
        columns = [pa.array(range(start, stop), pa.int64()), pa.array([sum(d.values()) for d in part], pa.int64())]
        columns += [pa.array([list(d) for d in part], pa.list_(pa.int64())), pa.array([list(d.values()) for d in part], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["id", "size", "keys", "tf"])

    average = sum(sum(d.values()) for d in docs) / len(docs)

    def unit(t, d):
        norm = bm25_search.K1 * (1 - bm25_search.B + bm25_search.B * sum(d.values()) / average)
        return np.floor(idf[np.searchsorted(terms, t)] * (d[t] * (bm25_search.K1 + 1) / (d[t] + norm)) * bm25_search.UNIT + 0.5)

    for shard in (1, 3, 100):
        out = pa.Table.from_batches(bm25_search._search_shards(Sent, average, 3, shard)(iter([batch(0, 2), batch(2, 6)]))).to_pylist()
        assert [(r["row"], r["query_id"]) for r in out] == [(3, 30), (8, 80)]
        for r, q in zip(out, (asked[0], asked[2]), strict=True):
            scores = [(-sum(c * unit(t, d) for t, c in q.items() if t in d), i) for i, d in enumerate(docs)]
            assert [(-u, i) for u, i in zip(r["units"], r["found"], strict=True)] == sorted(x for x in scores if x[0])[:3]


def test_numbers_of_keys():
    """Hashes are found by their first bits, other numbers by bisection; keys that are no terms have no number."""
    rng = np.random.default_rng(6)
    hashes = rng.integers(-(1 << 63), (1 << 63) - 1, 3000)
    for terms in (np.unique(hashes), np.arange(-500, 500) * 7, np.array([-(1 << 63), 0, (1 << 63) - 1]), np.array([5]), np.zeros(0, np.int64)):
        keys = np.r_[rng.permutation(terms), terms + 1, rng.integers(-(1 << 63), (1 << 63) - 1, 50), -(1 << 63), (1 << 63) - 1]
        place = {t: i for i, t in enumerate(terms.tolist())}
        assert bm25_search._numbers(terms, keys).tolist() == [place.get(x, -1) for x in keys.tolist()]
    assert len(bm25_search._numbers(np.arange(3), np.zeros(0, np.int64))) == 0


def test_near_candidates_come_from_trees(monkeypatch):
    """A cell's candidates are those its Burkhard-Keller tree finds: the k nearest of other labels, in both directions."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 62, (1, 4)).astype(np.uint64)
    values = np.repeat(base, 60, axis=0)
    values[20:] ^= np.uint64(1) << rng.integers(0, 62, (40, 4)).astype(np.uint64)
    values[50:] = rng.integers(0, 1 << 62, (10, 4)).astype(np.uint64)  # far from all others
    nodes, label = rng.permutation(60).astype(np.int64), rng.integers(0, 30, 60)
    marked = np.zeros((60, simhash_dedup.NEAR_MARKS), np.uint8)
    asked = []
    plain = simhash_dedup.BkForest.link
    monkeypatch.setattr(simhash_dedup.BkForest, "link", lambda self, queries, *rest: asked.append(len(queries)) or plain(self, queries, *rest))
    names, sizes = np.unique(label, return_counts=True)
    most = names[np.argmax(sizes)]
    for side in (np.ones(60, np.int64), (np.arange(60) % 3 > 0).astype(np.int64)):
        meet = lambda i, j: side.all() or side[i] != side[j]
        near = [(i, j) for i in range(60) for j in range(60) if i != j and meet(i, j) and label[i] != label[j] and simhash_dedup.distance(values[i], values[j]) <= simhash_dedup.NEAR_RADIUS]
        asked.clear()
        pairs, more = simhash_dedup._nearest(nodes, values, marked, label, side, 100)
        got = {tuple(p) for x in pairs for p in x.T.tolist()}
        assert got == {tuple(sorted((nodes[i], nodes[j]))) for i, j in near} and not more
        assert sum(asked) == (label != most).sum()
        pairs, more = simhash_dedup._nearest(nodes, values, marked, label, side, 3)
        few = {tuple(p) for x in pairs for p in x.T.tolist()}
        assert more and few < got and all(sum(nodes[i] in p for p in few) >= 3 for i in range(50) if label[i] != most)


def test_stars_of_bands_cut_into_trees(spark):
    """Each part of a large band has the band's smallest text as its root; all texts of a group are stars of it."""
    fields = [f"w{i}" for i in range(simhash_dedup.NEAR_FIELDS)]
    rows = [(n, 1 << n % 60, 0, 0, 0, [7]) for n in range(-20, 40)] + [(100, 0, -1, -1, -1, [7])]
    prints = spark.createDataFrame(rows, "node long, " + ", ".join(f"{w} long" for w in fields) + ", bands array<long>")
    found = simhash_dedup._stars(simhash_dedup._shared_bands(prints), prints, fields, 8).collect()
    assert sorted(tuple(r) for r in found) == [(-20, n) for n in range(-19, 40)]


def test_release_removes_shuffle_files(spark, monkeypatch):
    from tidemill.llm import runtime

    asked = []
    monkeypatch.setattr(type(spark.sparkContext._jvm.System), "gc", lambda self: asked.append(1), raising=False)
    monkeypatch.setattr(runtime, "RELEASE_S", 0.0)
    runtime.durable(spark.range(3))
    runtime.durable(spark.range(3))
    monkeypatch.setattr(runtime, "RELEASE_S", 1e9)
    runtime.durable(spark.range(3))
    assert len(asked) == 2


@pytest.mark.parametrize("task_edges", [7, 1000])
def test_components_joined_in_tasks(spark, task_edges):
    rng = random.Random(21)
    edges = [(i + 1, i) for i in range(40)] + [(rng.randrange(-90, -50), rng.randrange(-90, -50)) for _ in range(30)] + [(300, 300), (5, -1)]
    found = graph.connected_components(spark.createDataFrame(edges, "a long, b long"), task_edges).collect()
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert sorted((r["a"], r["b"]) for r in found) == sorted((a, b) for a, b in label.items() if a != b)
