"""Near-duplicate detection with 64-bit SimHash fingerprints linked through Burkhard-Keller trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.graph import connected_components
from tidemill.llm.runtime import durable, keep_rows, maybe_member, table, text_key

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Shingle hashes whose bits are counted at once; bounds memory for very long texts.
CHUNK = 1 << 15
#: Pairs of a query and a tree node that are compared at once.
STEP = 1 << 20
#: Fingerprints of one block value in one tree; larger buckets are split into several trees.
SHARD = 4096

# Near copies: sets of five-word shingles of a Jaccard similarity of NEAR_LEAST and more. Candidates are found within NEAR_RADIUS
# of 256 SimHash bits in the Burkhard-Keller tree of a band of minimal hashes and, unless they are the tree's star, have parity
# maps that allow for the similarity and agree on NEAR_MARKS_LEAST of NEAR_MARKS minimal hashes; every link is then confirmed
# on the sets themselves.
NEAR_WORDS = 5
NEAR_LEAST = 0.8
NEAR_FIELDS = 4
#: A pair of similarity 0.8 shares none of 20 bands of 4 minimal hashes with probability (1 - 0.8**4)**20 = 0.00003.
NEAR_BANDS = 20
NEAR_ROWS = 4
#: At 0.8 a bit differs with probability 0.15 (39 of 256; up to 0.19 or 48 for sets of a few shingles, deviation 6).
NEAR_RADIUS = 80
#: A mark is a byte of a minimal hash. A pair of similarity 0.8 agrees on under 176 of 256 with probability 0.000007 (one of 0.6, by
#: chance, on 176 and more with 0.003).
NEAR_MARKS = 256
NEAR_MARKS_LEAST = 176
#: Bits of a parity map. Maps differ in at most as many bits as shingles are in one set only, so what they exclude is no link.
NEAR_ODD = 2048
#: Share of the sizes of two sets of similarity NEAR_LEAST that is in one of them only; a little more for rounding.
NEAR_APART, NEAR_ROUNDING = (1 - NEAR_LEAST) / (1 + NEAR_LEAST), 1e-3
#: Pairs whose marks or parity maps are compared at once.
MARK_STEP = 1 << 15
#: Nearest candidates of a text compared in the first round of a cell; each further round of it takes NEAR_GROWTH times as many.
NEAR_FIRST = 2
NEAR_GROWTH = 8
#: Texts whose shingle sets are made at once.
SET_TEXTS = 128
_factors = np.random.default_rng(SEED).integers(0, 1 << 63, NEAR_MARKS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if it is set in over half of the shingles' XXH64 values."""
    return simhash_fields(shingle_hashes(text, words), 1)[0]


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 values of a text's shingles with repeats, at most ``CHUNK`` at once; none for a text without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return
    if len(tokens) < words:
        shingles = iter([b" ".join(tokens)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
        n = len(tokens) - words + 1
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, CHUNK):
        size = min(CHUNK, n - start)
        yield np.fromiter((digest(next(shingles), SEED) for _ in range(size)), np.uint64, size)


def simhash_fields(hashes: Iterable[np.ndarray], fields: int) -> list[int]:
    """``fields`` unsigned 64-bit fingerprints; the first is ``simhash``, the others are of remixed hashes."""
    counts = np.zeros((fields, 64), np.int64)
    n = 0
    for h in hashes:
        n += len(h)
        for field in range(fields):
            if field:
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            counts[field] += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def _simhashes(words: int):
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, words) for t in texts], np.uint64).view(np.int64))

    return F.pandas_udf(run, "long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints whose last axis holds their fields."""
    bits = np.bitwise_count(a ^ b)
    return bits[..., 0] if bits.shape[-1] == 1 else bits.sum(axis=-1, dtype=np.int16)


class BkForest:
    """Burkhard-Keller trees over fingerprints (rows of 64-bit fields), one for each cell: children are keyed by their Hamming
    distance to the parent.

    All trees grow level by level at once: a cell's first member is its root; the others go to the child of their distance,
    and the first to come there is that child.
    """

    def __init__(self, values: np.ndarray, cells: np.ndarray):
        """``cells``: the cell of each value, ascending."""
        self.values, self.span = values, 64 * values.shape[-1] + 1
        fresh = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
        self.cells, self.roots = cells[fresh], fresh
        parent = np.repeat(fresh, np.diff(np.r_[fresh, len(cells)]))
        rest = np.setdiff1d(np.arange(len(cells)), fresh, assume_unique=True)
        parent = parent[rest]
        edges, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(rest):
            edge = parent * self.span + distance(values[rest], values[parent])
            known, first, where = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(known)
            children.append(rest[first])
            below = rest[first][where]
            deeper = below != rest
            rest, parent = rest[deeper], below[deeper]
        edge, child = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(edge)
        #: parent and distance as one number, and the child there
        self.edge, self.child = edge[order], child[order]

    def link(self, queries: np.ndarray, cells: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(tree position, query position) pairs within ``radius``; a query is asked in the tree of its cell (there is one)
        and follows only the edges whose key is within the radius of its distance to the parent."""
        todo = [(np.arange(len(queries)), self.roots[np.searchsorted(self.cells, cells)])]
        while todo:
            asked, node = todo.pop()
            if len(asked) > STEP:
                todo += [(asked[at : at + STEP], node[at : at + STEP]) for at in range(0, len(asked), STEP)]
                continue
            apart = distance(queries[asked], self.values[node]).astype(np.int64)
            near = apart <= radius
            yield node[near], asked[near]
            low = np.searchsorted(self.edge, node * self.span + np.maximum(apart - radius, 0))
            high = np.searchsorted(self.edge, node * self.span + np.minimum(apart + radius, self.span - 1), side="right")
            ways = high - low
            if ways.any():
                ends = np.cumsum(ways)
                at = np.arange(ends[-1]) + np.repeat(low - (ends - ways), ways)
                todo.append((np.repeat(asked, ways), self.child[at]))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of a[i] and b[i]."""
    a, b = label[a], label[b]
    differ = a != b
    if not differ.any():
        return label
    pairs = np.unique(np.stack([a[differ], b[differ]]), axis=1)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for x, y in pairs.T.tolist():
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    target = np.arange(len(label))
    for x in parent:
        target[x] = find(x)
    return target[label]


def _cell_links(nodes: np.ndarray, values: np.ndarray, in_tree: np.ndarray, start: np.ndarray, stop: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of cells as stars: (node, first node of its set inside the cell).

    Members outside a cell's tree ask it; where all are inside, they ask each other.
    """
    cell = np.repeat(np.arange(len(start)), stop - start)
    whole = np.logical_and.reduceat(in_tree, start)[cell]
    tree_at, asked_at = np.flatnonzero(in_tree), np.flatnonzero(whole | ~in_tree)
    forest = BkForest(values[tree_at], cell[tree_at])
    label = np.arange(len(values))
    for i, j in forest.link(values[asked_at], cell[asked_at], radius):
        label = _merge(label, tree_at[i], asked_at[j])
    moved = np.flatnonzero(label != np.arange(len(values)))
    return nodes[moved], nodes[label[moved]]


def _link_cells(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def rows(flush: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            data = np.concatenate(held, axis=1)
            if not data.shape[1]:
                return
            start = np.flatnonzero(np.r_[True, (np.diff(data[:3], axis=1) != 0).any(axis=0)])
            stop = np.r_[start[1:], data.shape[1]]
            held = [] if flush else [data[:, start[-1] :]]
            if not flush:
                start, stop = start[:-1], stop[:-1]
            nodes, in_tree = data[3], data[4] == 1
            values = np.ascontiguousarray(data[5:].T).view(np.uint64)
            if len(start):
                end = stop[-1]
                a, b = _cell_links(nodes[:end], values[:end], in_tree[:end], start, stop, radius)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if held[-1].shape[1] and (held[-1][:3, -1] != held[0][:3, 0]).any():
                yield from rows(False)
        yield from rows(True)

    return run


def block_keys(pieces: int) -> list[Column]:
    """Blocks of a 64-bit fingerprint. Fingerprints differing in fewer bits than there are blocks
    agree on one of them, so looking up by blocks misses no link."""
    cuts = [64 * i // pieces for i in range(pieces + 1)]
    return [F.shiftrightunsigned("w0", lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def fingerprint_links(prints: DataFrame, keys: list[Column], radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that connect the fingerprints within ``radius`` bits of each other that share one of ``keys``.

    A tree is built for each value of each key (and, where a value has more than ``shard`` fingerprints, for each
    part of it, which the other parts then ask as well). A tree holds ``shard`` fingerprints or so and travels with the
    shuffle to its queries. Links leave a tree as stars, never as all pairs. ``prints``: distinct fingerprints
    in longs w0, w1, ..., each with its own long ``node``.
    """
    fields = [c for c in prints.columns if c.startswith("w")]
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), v.cast("long").alias("value")) for i, v in enumerate(keys)])
    keyed = prints.select("node", *fields, F.inline(blocks))
    hot = keyed.groupBy("block", "value").count().filter(F.col("count") > shard)
    parts = F.coalesce(F.ceil(F.col("count") / shard), F.lit(1)).cast("int")
    placed = keyed.join(hot, ["block", "value"], "left").withColumn("parts", parts)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    # cell (i, j), i <= j: the tree of part i, asked by part j
    cells = placed.select(
        "node", *fields, "block", "value", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).select(
        (F.col("value") * len(keys) + F.col("block")).alias("key"),
        F.least("part", "other").cast("long").alias("i"),
        F.greatest("part", "other").cast("long").alias("j"),
        "node",
        (F.col("part") <= F.col("other")).cast("long").alias("in_tree"),
        *fields,
    )
    spread = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return spread.mapInArrow(_link_cells(radius), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: fingerprint (16 hex digits) and smallest id reachable over links.

    Words are maximal runs without ASCII white space, A-Z lower-cased; shingles are ``words`` words with repeats.
    Fewer words give one shingle; a null, empty or blank text has fingerprint zero and links like any other. No link
    within the radius is missed. Repeated rows and ids each get their row. component_id is null only if every id of
    the component is. An empty table gives no rows; other columns are ignored. ``chosen`` marks the rows of one
    (id, text) of each component.
    """
    base = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), _simhashes(words)(F.col(text_col)).alias("w0"))
    base = durable(base.select("id", "text_key", F.col("w0").alias("node"), "w0"))
    prints = durable(base.groupBy("node", "w0").agg(_best(), F.count(F.lit(1)).alias("n")))
    return _named(base, prints, connected_components(fingerprint_links(prints.select("node", "w0"), block_keys(radius + 1), radius)), ["w0"], id_col)


def _best() -> Column:
    """The (id, text) that stands for a group."""
    return F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("text_key").alias("text_key"))).alias("best")


def _named(base: DataFrame, prints: DataFrame, roots: DataFrame, fields: list[str], id_col: str) -> DataFrame:
    linked = prints.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    linked = linked.withColumn("root", F.coalesce("root", "node"))
    tops = linked.groupBy("root").agg(F.min("best").alias("top"), F.sum("n").alias("n")).filter("n > 1")
    named = linked.join(tops.select("root", "top"), "root").select(F.col("node").alias("named"), "top").distinct()
    joined = base.join(named, base["node"] == named["named"], "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.lower(F.concat(*[F.lpad(F.hex(n), 16, "0") for n in fields])).alias("fingerprint"),
        F.when(F.col("top").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("component_id"),
        (F.col("top").isNull() | (F.col("id").eqNullSafe(F.col("top.id")) & (F.col("text_key") == F.col("top.text_key")))).alias("chosen"),
        "text_key",
    )


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 values of a text's five-word shingles; one value for all texts without words."""
    found = list(shingle_hashes(text, NEAR_WORDS))
    return np.unique(np.concatenate(found)) if found else np.zeros(1, np.uint64)


def minimal_hashes(shingles: np.ndarray, count: int = NEAR_MARKS) -> np.ndarray:
    """``count`` minimal hashes: two sets agree on each with their Jaccard similarity."""
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), CHUNK >> 6):
        least = np.minimum(least, (shingles[None, start : start + (CHUNK >> 6)] * _factors[:count, None]).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """Hashes of the bands, each of NEAR_ROWS minimal hashes."""
    bands = least[: NEAR_BANDS * NEAR_ROWS].reshape(NEAR_BANDS, NEAR_ROWS)
    return [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(bands)]


def marks(least: np.ndarray) -> np.ndarray:
    """One byte of each minimal hash, eight in an unsigned long."""
    return (least & np.uint64(255)).astype(np.uint8).view(np.uint64)


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """A bit is set if an odd number of shingles falls on it; 64 bits in an unsigned long."""
    counts = np.bincount((shingles % np.uint64(NEAR_ODD)).astype(np.int64), minlength=NEAR_ODD)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets, marks and parity maps of (text, ...), a few texts at once: a set takes more memory than its text."""
    for batch in batches:
        for start in range(0, batch.num_rows, SET_TEXTS):
            part = batch.slice(start, SET_TEXTS)
            sets = [shingle_set(t) for t in part.column(0).to_pylist()]
            made = [sets, [marks(minimal_hashes(x)) for x in sets], [parity_map(x) for x in sets]]
            columns = [pa.array([x.view(np.int64) for x in column], pa.list_(pa.int64())) for column in made]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], [*part.schema.names[1:], "shingles", "marks", "odd"])


def _near_sketches(texts: pd.Series) -> pd.DataFrame:
    node, prints, bands = [], [], []
    for text in texts:
        shingles = shingle_set(text)
        node.append(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))
        prints.append(simhash_fields([shingles], NEAR_FIELDS))
        bands.append(band_keys(minimal_hashes(shingles, NEAR_BANDS * NEAR_ROWS)))
    signed = lambda x, *shape: np.array(x, np.uint64).reshape(len(texts), *shape).view(np.int64)
    prints = signed(prints, NEAR_FIELDS)
    columns = {f"w{i}": prints[:, i] for i in range(NEAR_FIELDS)}
    return pd.DataFrame({"node": signed(node), **columns, "bands": list(signed(bands, NEAR_BANDS))})


def _agreeing(marked: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """On how many marks the texts a[i] and b[i] agree."""
    found = [(marked[a[at : at + MARK_STEP]] == marked[b[at : at + MARK_STEP]]).sum(axis=1) for at in range(0, len(a), MARK_STEP)]
    return np.concatenate([np.zeros(0, np.int64), *found])


def _may_link(odd: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the texts a[i] and b[i] may have a similarity of NEAR_LEAST by their parity maps and sizes; never false for those that have."""
    least = [np.bitwise_count(odd[a[at : at + MARK_STEP]] ^ odd[b[at : at + MARK_STEP]]).sum(axis=1, dtype=np.int64) for at in range(0, len(a), MARK_STEP)]
    return np.concatenate([np.zeros(0, np.int64), *least]) <= (sizes[a] + sizes[b]) * NEAR_APART + NEAR_ROUNDING


def _nearest(
    nodes: np.ndarray, values: np.ndarray, marked: np.ndarray, label: np.ndarray, side: np.ndarray, k: int, odd: np.ndarray | None = None, sizes: np.ndarray | None = None
) -> tuple[list[np.ndarray], bool]:
    """Pairs of each text of a cell and its ``k`` nearest candidates of other labels, and whether any text has more.

    Candidates are what a text finds within NEAR_RADIUS in the Burkhard-Keller tree of the cell's fingerprints; those that the parity
    maps ``odd`` and the ``sizes`` of the sets exclude go first, as they can be no links.
    ``side``: 0 for texts asked about only, 1 for those compared with each other and with these. Texts of the label that most
    have do not ask: of two texts of different labels one at least does.
    """
    held = np.flatnonzero(side == 1)
    asked = held if len(held) == len(nodes) else np.flatnonzero(side == 0)
    _, where, held_by = np.unique(label, return_inverse=True, return_counts=True)
    asks = where != np.argmax(held_by)
    pairs, more = [], False
    # both directions: a text of either side has its own nearest ones
    for left, right in [(asked, held)] if asked is held else [(asked, held), (held, asked)]:
        left = left[asks[left]]
        if not len(left) or not len(right):
            continue
        forest = BkForest(values[right], np.zeros(len(right), np.int64))
        step = max(1, STEP // len(right))
        for start in range(0, len(left), step):
            part = left[start : start + step]
            found = list(forest.link(values[part], np.zeros(len(part), np.int64), NEAR_RADIUS))
            j, i = (np.concatenate(x) for x in zip(*found, strict=True))
            other = label[part[i]] != label[right[j]]
            i, j = i[other], j[other]
            if odd is not None:
                possible = _may_link(odd, sizes, part[i], right[j])
                i, j = i[possible], j[possible]
            apart = NEAR_MARKS - _agreeing(marked, part[i], right[j])
            close = apart <= NEAR_MARKS - NEAR_MARKS_LEAST
            i, j, apart = i[close], j[close], apart[close]
            # ties in an order of their own for each text, so that no text is the nearest of all
            order = np.lexsort(((nodes[part[i]] ^ nodes[right[j]]) & ((1 << 15) - 1), apart, i))
            i, j = i[order], j[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            more |= bool((rank >= k).any())
            a, b = nodes[part[i[rank < k]]], nodes[right[j[rank < k]]]
            pairs.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1))
    return pairs, more


def _near_pairs(k: int):
    """Candidate pairs (a, b) of the cells; a row without a names a cell (key, i, j) that has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def rows(flush: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            data = np.concatenate(held, axis=1) if held else np.zeros((0, 0))
            if not data.size:
                return
            start = np.flatnonzero(np.r_[True, (np.diff(data[:3], axis=1) != 0).any(axis=0)])
            stop = np.r_[start[1:], data.shape[1]]
            held = [] if flush else [data[:, start[-1] :]]
            if not flush:
                start, stop = start[:-1], stop[:-1]
            values = np.ascontiguousarray(data[6 : 6 + NEAR_FIELDS].T).view(np.uint64)
            marked, odd = (np.ascontiguousarray(x.T) for x in np.split(data[7 + NEAR_FIELDS :], [NEAR_MARKS // 8]))
            marked, odd, sizes = marked.view(np.uint8), odd.view(np.uint64), data[6 + NEAR_FIELDS]
            found, unfinished = [np.zeros((2, 0), np.int64)], []
            for s, e in zip(start.tolist(), stop.tolist(), strict=True):
                pairs, more = _nearest(data[3, s:e], values[s:e], marked[s:e], data[5, s:e], data[4, s:e], k, odd[s:e], sizes[s:e])
                found += pairs
                if more:
                    unfinished.append(s)
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            cells = data[:3, unfinished]
            none = lambda n: pa.nulls(n, pa.int64())
            for a, b, (key, i, j) in ((*map(pa.array, pairs), [none(pairs.shape[1])] * 3), (*[none(len(unfinished))] * 2, map(pa.array, cells))):
                yield pa.RecordBatch.from_arrays([a, b, key, i, j], ["a", "b", "key", "i", "j"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if held[-1].shape[1] and (held[-1][:3, -1] != held[0][:3, 0]).any():
                yield from rows(False)
        yield from rows(True)

    return run


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with ``label``, the component of their node."""
    found = members.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    return found.withColumn("label", F.coalesce("root", "node")).drop("root")


def _near_cells(keyed: DataFrame, roots: DataFrame, shard: int) -> DataFrame:
    """Cells (key, i, j) of texts that share a band and are of several components; a key of over ``shard`` texts is cut into parts,
    and each two parts meet in a cell."""
    shared = _labelled(keyed, roots).groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("label").alias("low"), F.max("label").alias("high"))
    shared = shared.filter("low < high").select("key", "count")
    placed = keyed.join(shared, "key").withColumn("parts", F.ceil(F.col("count") / shard).cast("int"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    return placed.select("key", "node", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "key", F.least("part", "other").cast("long").alias("i"), F.greatest("part", "other").cast("long").alias("j"), "node", (F.col("part") <= F.col("other")).cast("long").alias("side")
    )


def _sets(nodes: DataFrame, prints: DataFrame, fields: list[str], docs: DataFrame, text_col: str) -> DataFrame:
    """node, fingerprint, shingle set, marks and parity map of ``nodes`` (one column, distinct), made anew from the texts."""
    wanted = durable(nodes.join(prints.select("node", *fields, F.col("best.text_key").alias("text_key")), "node"))
    texts = docs.select(text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    texts = maybe_member(texts, wanted.select("text_key").distinct(), "text_key").filter("maybe_").join(wanted, "text_key").dropDuplicates(["node"])
    schema = ", ".join(f"{c} long" for c in ["node", *fields]) + ", shingles array<long>, marks array<long>, odd array<long>"
    return texts.select("text", "node", *fields).mapInArrow(_shingle_sets, schema)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have a similarity of NEAR_LEAST and more."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(shared / (F.size("of_a") + F.size("of_b") - shared) >= NEAR_LEAST).select("a", "b")


def _shared_bands(prints: DataFrame) -> DataFrame:
    """(key, node, hub, count) of the bands that several texts share; ``hub`` is the smallest text of the band."""
    keyed = prints.select("node", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count(F.lit(1)).alias("count"))
    return keyed.join(hubs.filter("hub < last").select("key", "hub", "count"), "key").select("key", "node", "hub", "count")


def _stars(shared: DataFrame, prints: DataFrame, fields: list[str], shard: int) -> DataFrame:
    """Candidate pairs (a, b) as stars of the Burkhard-Keller trees of the bands: each text and the first text of its band that links
    within NEAR_RADIUS lead to. At most NEAR_BANDS for a text, and in a large group mostly the same one in all bands.

    A band of over ``shard`` texts is cut into several trees, each with the smallest text of the band as its root.
    """
    parts = F.ceil(F.col("count") / shard)
    own = F.array(F.pmod(F.xxhash64("node", F.lit(1)), parts))
    placed = shared.select("key", "node", F.explode(F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(own)).alias("i"))
    cells = placed.join(prints.select("node", *fields), "node").select("key", "i", F.col("i").alias("j"), "node", F.lit(1).cast("long").alias("in_tree"), *fields)
    spread = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return spread.mapInArrow(_link_cells(NEAR_RADIUS), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, first: int = NEAR_FIRST) -> DataFrame:
    """Components of texts whose sets of five-word shingles have a similarity of 0.8 and more, in rows as of ``simhash_components``.

    Texts with equal sets are one node. All candidates come from Burkhard-Keller trees over the SimHash fingerprints of the texts
    of a band. A tree is first asked for stars, mostly each text and the smallest of its band, which joins most groups by as many
    comparisons as they have members. Only bands whose texts are then still of several components go on: their texts
    are compared with their ``first`` nearest candidates of other components, then with more, until every candidate
    pair is compared, inside a component or excluded by its parity maps. Sets, marks and parity maps are made once, of texts
    that share a band.
    """
    fields = [f"w{i}" for i in range(NEAR_FIELDS)]
    sketches = F.pandas_udf(_near_sketches, "node long, " + ", ".join(f"{w} long" for w in fields) + ", bands array<long>")
    sketch = [F.size("shingles").cast("long").alias("size")]
    sketch += [F.col(c)[i].alias(f"{c}{i}") for c, n in (("marks", NEAR_MARKS // 8), ("odd", NEAR_ODD // 64)) for i in range(n)]
    base = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), sketches(F.col(text_col)).alias("fp"))
    base = durable(base.select("id", "text_key", "fp.*"))
    prints = durable(base.groupBy("node").agg(_best(), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in [*fields, "bands"]]))
    keyed = durable(_shared_bands(prints))
    sets = durable(_sets(keyed.select("node").distinct(), prints, fields, docs, text_col))
    roots = connected_components(_confirmed(durable(_stars(keyed, prints, fields, shard)), sets))
    cells, k = durable(_near_cells(keyed.select("key", "node"), roots, shard)), first
    sketches = sets.select("node", *fields, *sketch)
    while not cells.isEmpty():
        members = _labelled(cells.join(sketches, "node"), roots).select("key", "i", "j", "node", "side", "label", *sketches.columns[1:])
        spread = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
        found = durable(spread.mapInArrow(_near_pairs(k), "a long, b long, key long, i long, j long"))
        fresh = _confirmed(durable(found.filter("a is not null").select("a", "b").distinct()), sets)
        roots = connected_components(roots.unionByName(fresh))
        unfinished = found.filter("a is null").select("key", "i", "j")
        cells = durable(cells.join(unfinished, ["key", "i", "j"], "left_semi"))
        k *= NEAR_GROWTH
    return _named(base, prints, roots, fields, id_col)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of near copies stays."""
    return keep_rows(docs, near_copies(docs, id_col, text_col), "chosen", id_col, text_col)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


ORACLE: dict[str, str] = {}
