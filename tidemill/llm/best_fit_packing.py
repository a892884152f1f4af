"""Packing of token pieces into sequences: best fit on the length histogram, then swap-based local search.

Pieces of one length are alike for packing, so a plan is made for counts of lengths (at most ``capacity`` of them)
and sequences with the same contents are planned as one group with a multiplicity. The plan's size depends on
the capacity alone, never on the number of documents; a distributed rank inside each length then gives every
piece its place in the plan.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.runtime import durable, table
from tidemill.llm.token_counts import CACHE_WORDS, SPACE, WORD_CHARS, byte_letters, is_latin, latin_letters, newer_letters

CAPACITY = 2048
END_ID = 0
#: Rows ranked together inside one length and salt.
RANK_ROWS = 4_000
#: Texts of an input batch whose pieces are put out together.
OUT_ROWS = 4096


class TextIds(dict):
    """Ids of whole texts as little-endian 32-bit bytes, through a bounded cache of the words' ids."""

    def __init__(self, path: str):
        super().__init__()
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, added)) or r"(?!)")
        # the file's merges are in the order of its ids, so its ids serve as ranks for one word at a time
        value = {letter: b for b, letter in enumerate(byte_letters())}
        ranks = {bytes(map(value.__getitem__, t)): i for t, i in self.library.get_vocab(with_added_tokens=False).items()}
        self.one_word = Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        pattern = " ?[{0}]+| ?[{1}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{2}{0}{1}]+|[{2}]+(?![^{2}])|[{2}]+"
        self.words = regex.compile(pattern.format(r"\p{L}", r"\p{N}", SPACE)).findall
        self.latin_words = re.compile(pattern.format(latin_letters("L"), latin_letters("N"), SPACE)).findall

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.one_word(word), "<u4").tobytes()
        if len(word) <= WORD_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        latin = is_latin(text)
        if self.special.search(text) or not latin and newer_letters().search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, (self.latin_words if latin else self.words)(text)))


@lru_cache(maxsize=2)
def _ids(path: str) -> TextIds:
    return TextIds(path)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each row's ids and the end id; narrow, whole texts."""
    out = f"{id_col} long, piece int, start long, length long, ids_crc32 long"
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ids(vocabulary).encode
        for batch in batches:
            cells: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py()) + end)
                n = len(ids) // 4
                first = n % capacity or capacity
                edges = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for cell, x in zip(cells, (doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        cell.append(x)
                if len(cells[0]) >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, TYPES, strict=True)], names)
                    cells = [[], [], [], [], []]
            if cells[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, TYPES, strict=True)], names)

    names = [id_col, "piece", "start", "length", "ids_crc32"]
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).mapInArrow(cut, out)


TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

Bin = tuple[int, ...]


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Bin]:
    """Best fit in decreasing length on counts of lengths: contents (longest first) -> number of sequences."""
    open_bins: dict[int, Counter[Bin]] = defaultdict(Counter)  # by free space
    frees: list[int] = []

    def put(free: int, content: Bin, n: int) -> None:
        if not open_bins[free]:
            bisect.insort(frees, free)
        open_bins[free][content] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(frees, length)
            if at == len(frees):  # no open sequence has room: open new ones, filled as far as they go
                fit = min(left, capacity // length)
                n = left // fit
                put(capacity - fit * length, (length,) * fit, n)
                left -= n * fit
                continue
            free = frees[at]
            content, n = next(iter(open_bins[free].items()))
            fit = min(free // length, left)
            used = min(n, left // fit)
            del open_bins[free][content]
            if n > used:
                open_bins[free][content] = n - used
            if not open_bins[free]:
                frees.pop(at)
            put(free - fit * length, content + (length,) * fit, used)
            left -= used * fit
    total: Counter[Bin] = Counter()
    for bins in open_bins.values():
        total.update(bins)
    return total


def local_search(bins: Counter[Bin], capacity: int) -> Counter[Bin]:
    """Empties sequences by moves and exchanges between underfull ones, until nothing improves.

    A step moves a piece, exchanges one piece for one, or two for one, from a less full to a fuller sequence; sequences
    with the same contents take it together. Each step raises the sum of squared fills, so the search ends; a sequence
    that becomes empty is dropped. All underfull sequences take part. The search also ends when there are no more
    sequences than their total length needs, as none can be emptied then. A result is never worse than its input.
    """
    short = Counter({c: n for c, n in bins.items() if sum(c) < capacity})
    done = Counter({c: n for c, n in bins.items() if sum(c) >= capacity})
    spare = sum(n * (capacity - sum(c)) for c, n in short.items())
    changed = True
    while changed and spare >= capacity:
        changed = False
        for giver in sorted(short, key=lambda c: (sum(c), c)):
            while spare >= capacity and short[giver] and (found := _partner(giver, short, capacity)):
                taker, out, back = found
                n = min(short[giver], short[taker]) if taker != giver else short[giver] // 2
                less, more = (tuple(sorted((Counter(c) - Counter(a) + Counter(b)).elements(), reverse=True)) for c, a, b in ((giver, out, back), (taker, back, out)))
                for content, by in ((giver, -n), (taker, -n), (less, n), (more, n)):
                    (done if sum(content) >= capacity else short)[content] += by
                if not less:  # emptied
                    del short[less]
                    spare -= n * capacity
                changed, giver = True, less
        short = +short
    return short + done


def _partner(giver: Bin, short: Counter[Bin], capacity: int) -> tuple[Bin, list[int], list[int]] | None:
    """The fullest sequence that a step from ``giver`` fills further, and the step."""
    fill = sum(giver)
    for taker in sorted((c for c, n in short.items() if n > (c == giver) and sum(c) >= fill), key=lambda c: (-sum(c), c)):
        if step := _step(list(giver), list(taker), capacity - sum(taker)):
            return taker, *step
    return None


def _step(giver: list[int], taker: list[int], room: int) -> tuple[list[int], list[int]] | None:
    """Pieces to give and to get back, raising the taker's fill by the most, at most ``room``."""
    best, chosen = 0, None
    give, take = sorted(set(giver)), sorted(set(taker))
    i = bisect.bisect_right(give, room) - 1
    if i >= 0:
        best, chosen = give[i], ([give[i]], [])
    for x in give:  # one for one
        i = bisect.bisect_left(take, x - room)
        if i < len(take) and x - take[i] > best:
            best, chosen = x - take[i], ([x], [take[i]])
    if best < room:  # two for one
        count = Counter(giver)
        for k, x in enumerate(give):
            for y in give[k:]:
                if x == y and count[x] < 2:
                    continue
                i = bisect.bisect_left(take, x + y - room)
                if i < len(take) and x + y - take[i] > best:
                    best, chosen = x + y - take[i], ([x, y], [take[i]])
    return chosen


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), ordered: rank r of a length lies in the last row at or before it."""
    bins = local_search(best_fit(counts, capacity), capacity)
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for content, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length in content:
            rows.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def ranked(pieces: DataFrame, order: list[str], total: int) -> DataFrame:
    """``pieces`` (checkpointed) with ``rank``, from 0 without gaps inside each length.

    Ranks are counted inside (length, salt), with as many salts as the total asks for, so that one frequent
    length is spread; the start of each salt comes from its counts. The salt is of a row's place, so equal rows are spread.
    """
    salts = max(1, -(-total // RANK_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order))
    return salted.withColumn("own", own).join(starts, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("own") - 1).drop("salt", "first", "own")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a column length from 1 to capacity) with sequence_id and offset.

    Every piece gets a place; no sequence exceeds the capacity; offsets have no gaps. Only the histogram of
    lengths (at most ``capacity`` rows) reaches the driver. An empty table gives no rows.
    """
    pieces = durable(pieces)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = packing_plan(counts, capacity)
    order = [c for c in pieces.columns if c != "length"]
    names = [*pieces.columns, "sequence_id", "offset"]
    shift = 40
    keys = (plan[:, 0] << shift) + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            row = np.searchsorted(keys, (length << shift) + rank, side="right") - 1
            sequence = plan[row, 2] + rank - plan[row, 1]
            cells = [batch.column(batch.schema.get_field_index(n)) for n in names[:-2]]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(sequence), pa.array(plan[row, 3])], names)

    schema = ", ".join(f"`{n}` {t}" for n, t in [*pieces.dtypes, ("sequence_id", "long"), ("offset", "long")])
    return ranked(pieces, order, sum(counts.values())).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts as pieces of at most ``capacity`` ids, each with its place in a sequence.

    A row's ids end with the end id, so a null or empty text is one piece of one id. Only longer rows are cut, the
    first piece taking what does not fill a whole one. Repeated rows and ids are packed each; an empty table gives
    no rows; other columns are ignored.
    """
    return pack(token_pieces(docs, vocabulary, capacity, id_col=id_col, text_col=text_col), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


ORACLE: dict[str, str] = {}
