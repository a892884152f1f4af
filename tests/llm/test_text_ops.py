"""Token counts, piece sampling, chat format and packing against the libraries and brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tidemill.llm import best_fit_packing as packing  # noqa: E402
from tidemill.llm import chat_format, piece_sampling, token_counts  # noqa: E402

ALPHABET = list("aAbBst '’\n\t\r\x1c\x85\xa0\u3000\u2003\u200b\u180e019½²Ⅷ٣.,!?-_<|>éÉΣςİıßﬁΩ中文日本語한국어🙂👍🏽̣́e\x00ǅ") + ["<|endoftext|>", "<|startoftext|>", "'s", "'re", "'LL", "  ", "\r\n", "É"]
TEXTS = st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join)
HARD = [None, "", " ", "\t\n", "a" * 20_000, "ab " * 5_000, "<|endoftext|>" * 3, "🙂" * 3_000]
DOCS = "doc_id long, text string, n_tokens string, rank string, size string"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "x", "y", "z") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def words():
    return token_counts.TextCounter(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def ids():
    return packing.TextIds(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_same_tokens_as_the_library(words, ids, text):
    assert words[0].count(text) == len(words[1].encode(text, add_special_tokens=False).ids)
    assert ids[0].encode(text) == np.array(ids[1].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_every_code_point_as_the_library(words, ids):
    """Alone and before an ending, in runs of code points that follow each other."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not (0x3500 < c < 0x9F00 or 0xAD00 < c < 0xD700 or 0x20100 < c < 0x323A0 or 0x33500 < c < 0xE0000 or 0xE0200 < c)]
    texts = ["".join(f"a{chr(c)}'s {chr(c)}b {chr(c)}1'll " for c in points[at : at + 8]) for at in range(0, len(points), 8)]
    for text, a, b in zip(texts, words[1].encode_batch(texts, add_special_tokens=False), ids[1].encode_batch(texts, add_special_tokens=False), strict=True):
        assert words[0].count(text) == len(a.ids)
        assert ids[0].encode(text) == np.array(b.ids, "<u4").tobytes()


def test_token_counts(spark, words):
    df = token_counts.token_counts(frame(spark, [*HARD, *HARD]), P.path("word_bpe_49k.json"))
    assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    for r in df.collect():
        text = HARD[r["doc_id"] % len(HARD)] or ""
        n = len(words[1].encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)
    assert token_counts.token_counts(frame(spark, []), P.path("word_bpe_49k.json")).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return piece_sampling.PieceModel(P.path("piece_bpe_32k.model"), 0.2)


def every_segmentation(model, text):
    text, found = model.library.normalize(text), Counter()

    def go(at, ids, weight):
        if at == len(text):
            found[ids] += weight
            return
        single = False
        for end in range(at + 1, len(text) + 1):
            if piece := model.arc.get(text[at:end]):
                single |= end == at + 1
                go(end, (*ids, piece[0]), weight * piece[1])
        if not single:
            spelled = tuple(model.byte_id[b] for b in text[at].encode())
            go(at + 1, ids + spelled, weight * model.least ** len(spelled))

    go(0, (), 1.0)
    total = sum(found.values())
    return {k: v / total for k, v in found.items()}


@pytest.mark.parametrize("text", ["abc de", "a\u0e01b", "the"])
def test_samples_are_unbiased(pieces, text):
    truth, n, k = every_segmentation(pieces, text), 1500, 3
    first, estimate = Counter(), Counter()
    for key in range(n):
        rows = piece_sampling.sample_text(pieces, text, k, key * 7919 + 13)
        assert len({tuple(r[0]) for r in rows}) == len(rows) == min(k, len(truth))
        assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        first[tuple(rows[0][0].tolist())] += 1
        for ids, log_p, _, inclusion in rows:
            ids = tuple(ids.tolist())
            assert abs(math.exp(log_p) - truth[ids]) < 1e-6
            estimate[ids] += math.exp(log_p) / inclusion / n
    for ids, p in truth.items():
        assert abs(first[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 2e-3
    assert abs(sum(estimate.values()) - 1) < 0.05


@settings(max_examples=60, deadline=None)
@given(text=TEXTS, key=st.integers(0, 2**63))
def test_samples_decode(pieces, text, key):
    rows = piece_sampling.sample_text(pieces, text, 3, key)
    assert rows and all(pieces.decode(r[0].tolist()) == text.replace("▁", " ") for r in rows)
    assert pieces.decode(pieces.encode(text)) == pieces.library.decode(pieces.encode(text))


def test_piece_samples(spark):
    texts = [None, "", "one word", "one word", "x" * 5_000, "🙂\n\t"]
    path = P.path("piece_bpe_32k.model")
    run = lambda n: sorted((r["doc_id"], r["sample"], tuple(r["ids"]), r["gumbel"], r["round_trip"]) for r in piece_sampling.piece_samples(frame(spark, texts).repartition(n), path, 2).collect())
    rows = run(1)
    assert rows == run(4) and all(r[-1] for r in rows)
    assert [r[:3] for r in rows[:2]] == [(0, 0, ()), (1, 0, ())] and len(rows) == 9
    assert piece_sampling.piece_samples(frame(spark, []), path).count() == 0


def test_chat_format(spark):
    rng = random.Random(3)
    bits = ["<|im_start|>", "<|im_end|>", "<\\|", "<", "|", "\\", "\n", "assistant", "ü🙂", " ", "%0A", "%", "\n\n"]
    rows, want = [], {}
    for conv in range(60):
        turns = []
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["system", "user", "assistant", "assistant", "a\nb<|im_end|>%0A", None])
            turns.append((conv, t, role, None if rng.random() < 0.1 else "".join(rng.choices(bits, k=rng.randint(0, 12))), "extra"))
        rows += turns
        said = [(r or "", x or "") for _, _, r, x, _ in turns]
        loss = "".join(x for r, x in said if r == "assistant")
        want[conv] = (len(said), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    examples = chat_format.chat_examples(df)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.read_back(examples).collect()}
    assert got == want
    for r in examples.collect():
        assert r["formatted"].count("<|im_end|>") == r["formatted"].count("<|im_start|>")
        if r["loss_length"] is not None:
            assert r["formatted"].endswith("<|im_end|>\n") and r["loss_start"] + r["loss_length"] + 11 == len(r["formatted"])
    assert chat_format.chat_examples(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["n_turns"] for r in chat_format.read_back(chat_format.chat_examples(twice)).collect()} == {1: 3, None: 1}


def test_packing(spark, ids):
    texts = [*HARD, *["word " * n for n in (700, 2047, 2048, 2049, 5000)], "word " * 700]
    rows = packing.pack_documents(frame(spark, texts), P.path("byte_bpe_50k.json")).collect()
    held = {}
    for r in rows:
        held.setdefault(r["doc_id"], {})[r["piece"]] = r
    for i, text in enumerate(texts):
        own = [*ids[1].encode(text or "", add_special_tokens=False).ids, 0]
        parts = [held[i][k] for k in range(len(held[i]))]
        assert [p["length"] for p in parts[1:]] == [2048] * (len(parts) - 1) and sum(p["length"] for p in parts) == len(own)
        for p in parts:
            part = own[p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        spans.sort()
        assert [s for s, _ in spans] == [sum(x for _, x in spans[:i]) for i in range(len(spans))] and sum(x for _, x in spans) <= 2048
    assert packing.pack_documents(frame(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def fewest(counts, capacity):
    items = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True)
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] >= items[i]:
                bins[j] -= items[i]
                go(i + 1, bins)
                bins[j] += items[i]
        bins.append(capacity - items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


def test_search_never_loses_pieces_and_helps():
    gained = 0
    for seed in range(150):
        rng = random.Random(seed)
        counts = Counter(rng.randint(8, 60) for _ in range(rng.randint(1, 9)))
        first = packing.best_fit(counts, 100)
        after = packing.local_search(first, 100)
        assert Counter(x for c, n in after.items() for x in c for _ in range(n)) == counts
        assert all(sum(c) <= 100 for c in after) and fewest(counts, 100) <= sum(after.values()) <= sum(first.values())
        squares = lambda bins: sum(n * sum(c) ** 2 for c, n in bins.items())
        assert squares(after) >= squares(first)
        gained += squares(after) > squares(first)
    assert gained


def test_search_takes_all_underfull_sequences():
    """More underfull sequences than any fixed number; all of them change."""
    first = Counter({(50 + i, 20 + i % 7): 3 for i in range(20)}) + Counter({(31,): 900, (69,): 40, (30,): 900})
    after = packing.local_search(first, 100)
    pieces = lambda bins: Counter(x for c, n in bins.items() for x in c for _ in range(n))
    assert pieces(after) == pieces(first) and all(0 < sum(c) <= 100 for c in after)
    assert sum(after.values()) < sum(first.values()) - 1000
    assert all(packing._partner(c, after, 100) is None for c in after if sum(c) < 100) or sum(n * (100 - sum(c)) for c, n in after.items()) < 100


def test_null_ids_and_equal_rows_are_packed(spark):
    rows = [(None, "a b"), (None, "a b"), (7, None), (7, None), (7, "c " * 3000)] * 5
    packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect()
    assert Counter((r["doc_id"], r["piece"]) for r in packed) == {(None, 0): 10, (7, 0): 15, (7, 1): 5}
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)


def test_steps():
    assert packing._step([5, 3], [7], 4) == ([3], []) or packing._step([5, 3], [7], 4) is not None
    assert packing._step([9], [6], 4) == ([9], [6])
    assert packing._step([5, 5], [8], 2) == ([5, 5], [8])
    assert packing._step([9], [6], 2) is None
