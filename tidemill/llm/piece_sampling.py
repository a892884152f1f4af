"""Sampled segmentations with a SentencePiece vocabulary: Gumbel top-k without replacement over the lattice.

A text's lattice is a chain of independent word lattices, because no piece has a word mark after another character
(checked). A segmentation's probability is the product of its pieces' weights, normalised over the lattice by a
backward pass. The vocabulary ranks its pieces but gives no usable probabilities, so a piece's weight follows its
rank by Zipf's law: the share 1 / (rank + ZIPF_SHIFT), to the power ``theta`` (below 1: flatter).

The search is top-down A* on perturbed values: an agenda holds sets of segmentations (those that share a prefix and
leave a given path), with their mass and their largest perturbed value; the set with the largest is opened, its best
member is emitted, and what remains is put back. Because the masses are exact, no set is opened in vain and nothing
is pruned.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.runtime import table

MARK = "▁"
ZIPF_SHIFT = 2.7
SAMPLES = 2
THETA = 0.2
SEED = 42
#: Characters of texts that are sampled together.
CHUNK_CHARS = 1_000_000
_MASK = (1 << 64) - 1
_words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall


class PieceModel:
    """A vocabulary: its pieces as a trie in sorted arrays, their weights, and their bytes for decoding."""

    def __init__(self, path: str, theta: float = 1.0):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        piece: list[str] = [self.library.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(piece[i][3:5], 16): i for i in range(n) if self.library.is_byte(i)}
        byte_of = {i: b for b, i in self.byte_id.items()}
        plain = [i for i in range(n) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        if any(MARK in piece[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece goes on past a word mark: the lattice is no chain of words")
        share = {i: 1 / (r + ZIPF_SHIFT) for r, i in enumerate(plain)}
        scale = sum(share.values())
        self.arc = {piece[i]: (i, (w / scale) ** theta) for i, w in share.items()}
        self.least = min(w for _, w in self.arc.values())
        if any(text[0] not in self.arc for text in self.arc):
            raise ValueError("a piece starts with a character that is none")
        said = [bytes((byte_of[i],)) if i in byte_of else piece[i].replace(MARK, " ").encode() for i in range(n)]
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_size = np.fromiter(map(len, said), np.int64, n)
        self.said_at = np.cumsum(self.said_size) - self.said_size
        # a state is a prefix of a piece; 0 is the empty one
        state = {"": 0}
        for text in self.arc:
            for end in range(1, len(text) + 1):
                state.setdefault(text[:end], len(state))
        letters = sorted({char for text in self.arc for char in text})
        #: number of each code point, from 1; 0 for those in no piece
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        edges = sorted((state[text[:-1]] * self.letters + int(self.letter[ord(text[-1])]), at) for text, at in state.items() if text)
        #: (state, letter) -> next state, as sorted keys
        self.edge, self.next = (np.array(x, np.int64) for x in zip(*edges, strict=True))
        self.first = np.full(self.letters, -1, np.int64)
        from_root = self.edge < self.letters
        self.first[self.edge[from_root]] = self.next[from_root]
        found = [self.arc.get(text, (-1, 0.0)) for text in state]
        self.id = np.array([i for i, _ in found], np.int64)
        self.weight = np.array([w for _, w in found])
        self.byte_ids = np.array([self.byte_id.get(b, -1) for b in range(256)], np.int64)

    def decoded(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Bytes of consecutive lists of ids of these sizes: marks as spaces, no leading space of its own."""
        size = self.said_size[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.said_at[ids] - (ends - size), size)
        said = self.said[at].tobytes()
        cut = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]].tolist()
        return [said[a:b].removeprefix(b" ") for a, b in zip(cut, cut[1:], strict=False)]

    def decode(self, ids) -> str:
        """Text of a list of ids, as the library gives it."""
        return self.decoded(np.asarray(ids, np.int64), np.array([len(ids)]))[0].decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        """The vocabulary's own (best merge) segmentation."""
        return self.library.encode(text)


@lru_cache(maxsize=2)
def _model(path: str, theta: float) -> PieceModel:
    return PieceModel(path, theta)


class Lattice:
    """The lattices of a set of words, built and summed for all words at once.

    A node is a place in a word; node 0 is the end of every word. Nodes are numbered by the distance to their word's end
    and, inside a distance, by falling length of the word: so a place's successor is found without a search, and one step
    of the backward pass takes all nodes of a distance. Arcs of node i are start[i]:start[i + 1]; ``p`` is an arc's
    probability given its node; an id below 0 stands for the bytes of the code point -1 - id.
    """

    def __init__(self, model: PieceModel, words: list[str]):
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        rising = size[order][::-1]
        depth = int(rising[-1]) if len(words) else 0
        #: words of at least each length, from 1, and the first node of each distance
        width = len(words) - np.searchsorted(rising, np.arange(1, depth + 1))
        base = np.r_[0, 1, 1 + np.cumsum(width)].astype(np.int64)
        nodes = int(base[-1]) if depth else 1
        down = np.r_[0, 0, width[:-1]].astype(np.int64) if depth else np.zeros(1, np.int64)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        #: node of each word's start
        self.node = base[size] + rank
        codes = np.frombuffer("".join([words[i] for i in order.tolist()]).encode("utf-32-le"), np.uint32)
        sizes = size[order]
        inside = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = base[np.repeat(sizes, sizes) - inside] + np.repeat(np.arange(len(words)), sizes)
        point = np.zeros(nodes, np.int64)
        point[place] = codes
        letter = model.letter[point].astype(np.int64)
        # walk the trie from all nodes at once, a character at a time
        begin = np.arange(1, nodes)
        at, left = begin, np.repeat(np.arange(1, depth + 1), width)
        state = model.first[letter[1:]]
        unknown = begin[state < 0]
        spelled = point[unknown]
        cost = np.array([1, 2, 3, 4])[np.searchsorted([0x80, 0x800, 0x10000], spelled, side="right")]
        found = [(unknown, np.where(left[unknown - 1] == 1, 0, unknown - down[left[unknown - 1]]), -1 - spelled, model.least ** cost.astype(np.float64))]
        live = state >= 0
        begin, at, left, state = begin[live], at[live], left[live], state[live]
        while len(begin):
            after = np.where(left == 1, 0, at - down[left])
            whole = np.flatnonzero(model.id[state] >= 0)
            found.append((begin[whole], after[whole], model.id[state[whole]], model.weight[state[whole]]))
            on = np.flatnonzero(left > 1)
            begin, at, left = begin[on], after[on], left[on] - 1
            key = state[on] * model.letters + letter[at]
            edge = np.minimum(np.searchsorted(model.edge, key), len(model.edge) - 1)
            live = np.flatnonzero(model.edge[edge] == key)
            begin, at, left, state = begin[live], at[live], left[live], model.next[edge[live]]
        count = np.zeros(nodes, np.int64)
        for source, *_ in found:
            count[source] += 1
        self.start = np.r_[0, np.cumsum(count)]
        arcs = int(self.start[-1])
        self.to, self.id, weight = np.empty(arcs, np.int64), np.empty(arcs, np.int64), np.empty(arcs)
        free = self.start[:-1].copy()
        for source, to, name, w in found:
            slot = free[source]
            free[source] += 1
            self.to[slot], self.id[slot], weight[slot] = to, name, w
        # backward: log of the mass of the ways from each node to the end
        mass = np.zeros(nodes)
        self.p = np.empty(arcs)
        for d in range(1, depth + 1):
            lo, hi = base[d], base[d + 1]
            a, b = self.start[lo], self.start[hi]
            edge, n = self.start[lo:hi] - a, count[lo:hi]
            ways = mass[self.to[a:b]]
            top = ways[edge]
            part = weight[a:b] * np.exp(np.minimum(ways - np.repeat(top, n), 700.0))
            total = np.add.reduceat(part, edge)
            mass[lo:hi] = top + np.log(total)
            self.p[a:b] = part / np.repeat(total, n)


def _mix(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from 64-bit counters (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class RowRandom:
    """Uniform numbers of one row, in the order they are asked for."""

    def __init__(self, key: int, stream: int):
        self.state = (key * 0x9E3779B97F4A7C15 + stream * 0xD1B54A32D192ED03) & _MASK

    def __call__(self) -> float:
        self.state = x = (self.state + 0x9E3779B97F4A7C15) & _MASK
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
        return (((x ^ (x >> 31)) >> 11) + 0.5) * 2.0**-53


class Draws:
    """Independent draws of whole segmentations for a group of texts, all words at once."""

    def __init__(self, model: PieceModel, texts: list[list[str]], keys: list[int], count: int):
        self.model = model
        number: dict[str, int] = {}
        lengths = [len(t) for t in texts]
        word = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, sum(lengths))
        lattice = Lattice(model, list(number))
        self.first = lattice.node[word]
        self.start, self.to, self.p, self.id = lattice.start, lattice.to, lattice.p, lattice.id
        self.text0 = np.r_[0, np.cumsum(lengths)].astype(np.int64)
        at = np.arange(len(self.first)) - np.repeat(self.text0[:-1], lengths)
        key = np.repeat(np.array(keys, np.uint64), lengths)
        self.paths = [self._draw(key, at.astype(np.uint64), d) for d in range(count)]

    def _draw(self, key: np.ndarray, at: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray]:
        """Arcs of all words in order, and where each word's begin."""
        counter = key * np.uint64(0x9E3779B97F4A7C15) + at * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64((draw + 1) * 0xD6E8FEB86659FD93 & _MASK)
        node, live = self.first, np.arange(len(self.first))
        taken = np.zeros(len(self.first), np.int64)
        steps = []
        while len(live):
            counter = counter + np.uint64(0x165667B19E3779F9)
            arc, last = self.start[node], self.start[node + 1] - 1
            fork = np.flatnonzero(arc != last)
            choice, last, u = arc[fork], last[fork], _mix(counter[fork])
            todo = np.arange(len(fork))
            while len(todo):  # pass the arcs whose share lies before the number; rounding may not pass the last
                u[todo] -= self.p[choice[todo]]
                todo = todo[(u[todo] > 0) & (choice[todo] < last[todo])]
                choice[todo] += 1
            arc[fork] = choice
            steps.append((live, arc))
            taken[live] += 1
            node = self.to[arc]
            on = np.flatnonzero(node)
            live, node, counter = live[on], node[on], counter[on]
        begin = np.r_[0, np.cumsum(taken)]
        path = np.empty(begin[-1], np.int64)
        for t, (live, arc) in enumerate(steps):
            path[begin[live] + t] = arc
        return path, begin

    def arcs_of(self, node: int) -> range:
        return range(int(self.start[node]), int(self.start[node + 1]))

    def source(self, arc: int) -> int:
        return int(np.searchsorted(self.start, arc, side="right")) - 1

    def ids_of(self, arcs: np.ndarray) -> np.ndarray:
        ids = self.id[arcs]
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids.astype(np.int32)
        # characters in no piece are spelled in the bytes of their code points
        spelled = [chr(-1 - i).encode() for i in ids[odd].tolist()]
        size = np.ones(len(ids), np.int64)
        size[odd] = [len(b) for b in spelled]
        out = np.repeat(ids, size)
        out[np.repeat(ids < 0, size)] = self.model.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return out.astype(np.int32)


class Sampled:
    """One segmentation of a text: arcs, the probability of each given its node, and the word each arc is in."""

    __slots__ = ("arcs", "q", "word")

    def __init__(self, arcs, q, word):
        self.arcs, self.q, self.word = arcs, q, word


def _truncated(mass: float, bound: float, u: float) -> float:
    """Largest of the perturbed values of a set with this mass, given that it lies below ``bound``."""
    loc = math.log(mass)
    return loc - math.log(math.exp(min(700.0, loc - bound)) - math.log(u))


def top_k(draws: Draws, text: int, k: int, key: int) -> list[tuple[Sampled, float, float, float]]:
    """(segmentation, log probability, perturbed value, inclusion probability), distinct, best first; at most ``k``.

    The inclusion probability is that of lying above the (k + 1)-th value; it is 1 if there is none.
    """
    lo, hi = draws.text0[text], draws.text0[text + 1]
    random = RowRandom(key, 1)

    def whole(draw: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        path, begin = draws.paths[draw]
        return path[begin[first] : begin[hi]], np.repeat(np.arange(first, hi), np.diff(begin[first : hi + 1]))

    arcs, word = whole(0, lo)
    best = Sampled(arcs, draws.p[arcs], word)
    value = -math.log(-math.log(random()))
    emitted = [(best, value)]
    agenda: list = []
    serial = 0

    def offer(path: Sampled, at: int, removed: dict[int, list[int]], mass: float, bound: float) -> None:
        nonlocal serial
        if mass > 1e-300:
            serial += 1
            heapq.heappush(agenda, (-_truncated(mass, bound, random()), serial, path, at, removed))

    def leaving(path: Sampled, at: int, removed: dict[int, list[int]]) -> np.ndarray:
        """Mass of the segmentations that leave the path at each arc from ``at`` on."""
        before = np.r_[1.0, np.cumprod(path.q)[:-1]] if len(path.q) else np.zeros(0)
        rest = 1.0 - path.q
        for t, gone in removed.items():
            rest[t] -= draws.p[gone].sum()
            if len(draws.arcs_of(draws.source(int(path.arcs[t])))) == len(gone) + 1:
                rest[t] = 0.0
        rest[:at] = 0.0
        return np.maximum(before * rest, 0.0)

    offer(best, 0, {}, float(leaving(best, 0, {}).sum()), value)
    while agenda and len(emitted) < k:
        negative, _, path, at, removed = heapq.heappop(agenda)
        value = -negative
        out = leaving(path, at, removed)
        summed = np.cumsum(out)
        t = int(min(np.searchsorted(summed, random() * summed[-1], side="right"), len(out) - 1))
        while out[t] <= 0.0:
            t -= 1
        node, taken = draws.source(int(path.arcs[t])), {int(path.arcs[t]), *removed.get(t, [])}
        options = [a for a in draws.arcs_of(node) if a not in taken]
        u = random() * float(draws.p[options].sum())
        for arc in options:
            u -= draws.p[arc]
            if u <= 0:
                break
        inside, here, w = [arc], int(draws.to[arc]), int(path.word[t])
        while here:
            u = random()
            for a in draws.arcs_of(here):
                u -= draws.p[a]
                if u <= 0:
                    break
            inside.append(a)
            here = int(draws.to[a])
        tail, tail_word = whole(len(emitted), w + 1)
        arcs = np.concatenate([path.arcs[:t], np.array(inside, np.int64), tail])
        word = np.concatenate([path.word[:t], np.full(len(inside), w), tail_word])
        found = Sampled(arcs, draws.p[arcs], word)
        emitted.append((found, value))
        less = {**removed, t: [*removed.get(t, []), arc]}
        offer(path, at, less, float(leaving(path, at, less).sum()), value)
        offer(found, t + 1, {}, float(leaving(found, t + 1, {}).sum()), value)
    bar = -agenda[0][0] if agenda else -math.inf
    rows = []
    for found, g in emitted:
        log_p = float(np.log(found.q).sum())
        rows.append((found, log_p, g, 1.0 if bar == -math.inf else -math.expm1(-math.exp(min(700.0, log_p - bar)))))
    return rows


def sample_text(model: PieceModel, text: str | None, k: int, key: int) -> list[tuple[list[int], float, float, float]]:
    """One text's samples as (array of ids, log probability, perturbed value, inclusion probability)."""
    return next(iter(_samples(model, [text], [key], k)))


def _samples(model: PieceModel, texts: list[str | None], keys: list[int], k: int):
    words = [_words(model.library.normalize(t)) if t else [] for t in texts]
    draws = Draws(model, words, keys, k)
    for i, key in enumerate(keys):
        yield [(draws.ids_of(found.arcs), *rest) for found, *rest in top_k(draws, i, k, key)]


def piece_samples(docs: DataFrame, vocabulary: str, k: int = SAMPLES, theta: float = THETA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to ``k`` distinct segmentations of each row's whole text, one row each: sample (from 0, best first), n_pieces,
    ids, log_prob, gumbel, inclusion and round_trip (the ids decode to the text again).

    Narrow; random numbers depend on the row's id and ``seed`` alone, so partitioning, retries and repeated rows give
    the same samples. A null or empty text has one segmentation without pieces (log_prob 0, inclusion 1); a text with
    fewer than k segmentations gives them all. A word mark in a text decodes to a space, as in the library. An empty
    table gives no rows; other columns are ignored.
    """
    names = [id_col, "sample", "n_pieces", "ids", "log_prob", "gumbel", "inclusion", "round_trip"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.float64(), pa.bool_()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(vocabulary, theta)
        for batch in batches:
            for rows in _groups(batch):
                found = [(doc, s, text, *sample) for (doc, _, text), samples in zip(rows, _samples(model, [r[2] for r in rows], [r[1] & _MASK for r in rows], k), strict=True) for s, sample in enumerate(samples)]
                sizes = np.array([len(r[3]) for r in found], np.int64)
                ids = np.concatenate([r[3] for r in found])
                same = [got == (text or "").replace(MARK, " ").encode() for got, (_, _, text, *_) in zip(model.decoded(ids, sizes), found, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(ids))
                cells = [[r[0] for r in found], [r[1] for r in found], sizes, lists, *([r[i] for r in found] for i in (4, 5, 6)), same]
                yield pa.RecordBatch.from_arrays([c if c is lists else pa.array(c, t) for c, t in zip(cells, schema.types, strict=True)], schema=schema)

    keyed = docs.select(F.col(id_col).cast("long").alias(id_col), F.xxhash64(F.col(id_col), F.lit(seed)).alias("key"), F.col(text_col))
    return keyed.mapInArrow(run, f"{id_col} long, sample int, n_pieces int, ids array<int>, log_prob double, gumbel double, inclusion double, round_trip boolean")


def _groups(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    rows, size = [], 0
    for doc, key, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
        rows.append((doc.as_py(), key.as_py(), text.as_py()))
        size += len(rows[-1][2] or "")
        if size >= CHUNK_CHARS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def op2_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_samples(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


ORACLE: dict[str, str] = {}
