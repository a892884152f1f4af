"""Toxicity scores by a factorization machine over hashed terms (Rendle, 2010)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.runtime import table, text_key, whole_rows

#: Hash buckets of terms, factors of a term, and labelled rows a model is fitted on at most.
BUCKETS = 1 << 16
FACTORS = 4
SAMPLE_ROWS = 12_000
#: Terms in fewer sampled texts are not used, nor are those with lower chi-squares: alone against the label, and in
#: every pair against what a model of the terms that tell alone leaves unexplained (there are many more pairs).
LEAST_TEXTS = 3
LEAST_CHI2 = 20.0
LEAST_PAIR_CHI2 = 60.0
FOLDS = 5
CACHE_TERMS = 1 << 19

_words = re.compile(r"[^\W\d_]+").findall


@dataclass
class FactorizationMachine:
    """logit = bias + sum of weights + half of (|sum of factors|^2 - sum of |factors|^2) over a text's terms."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    slot: np.ndarray
    #: term -> place in weight and factor, or -1
    known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def score(self, text: str | None) -> float:
        known, places = self.known, set()
        for term in set(_words((text or "").lower())):
            at = known.get(term)
            if at is None:
                if len(known) >= CACHE_TERMS:
                    known.clear()
                at = known[term] = int(self.slot[crc32(term.encode()) % BUCKETS])
            places.add(at)
        return self.probability(np.array(sorted(places), np.int64))

    def probability(self, at: np.ndarray) -> float:
        """Score of a text with these places; -1 stands for terms that are not used."""
        at = at[at >= 0]
        v = self.factor[at].astype(np.float64)
        z = self.bias + self.weight[at].sum(dtype=np.float64) + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def terms_of(text: str | None) -> list[int]:
    """Sorted distinct buckets of a whole text's terms (runs of letters, lower-cased)."""
    return sorted({crc32(t.encode()) % BUCKETS for t in set(_words((text or "").lower()))})


def telling(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets whose presence goes with the label 1 or 0, by a chi-square test."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    n, positive = max(len(y), 1), y.sum()
    texts = np.bincount(at, minlength=BUCKETS).astype(np.float64)
    hits = np.bincount(at, y[owner], minlength=BUCKETS)
    expected = texts * positive / n
    spread = np.maximum(expected * (1 - positive / n) * (1 - texts / n), 1e-9)
    return np.flatnonzero((texts >= LEAST_TEXTS) & ((hits - expected) ** 2 / spread >= LEAST_CHI2))


def telling_pairs(rows: list[np.ndarray], y: np.ndarray, predicted: np.ndarray) -> np.ndarray:
    """Buckets of the pairs whose presence in a text goes with the error of the prediction, by a score test of all pairs."""
    sizes = np.array([len(r) for r in rows], np.int64)
    error, spread = y - predicted, predicted * (1 - predicted)
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    texts = np.bincount(at, minlength=BUCKETS)
    # the chi-square of any set of a bucket's texts is at most the sum of those of the single texts (Cauchy-Schwarz)
    most = np.bincount(at, np.repeat(error**2 / spread, sizes), BUCKETS)
    common = np.flatnonzero((texts >= LEAST_TEXTS) & (most >= LEAST_PAIR_CHI2))
    place = np.full(BUCKETS, -1, np.int64)
    place[common] = np.arange(len(common))
    at = place[at]
    owner = np.repeat(np.arange(len(rows)), sizes)[at >= 0]
    at = at[at >= 0]
    first = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(rows)))]
    by_bucket = np.argsort(at, kind="stable")
    holders = owner[by_bucket]
    edge = np.r_[0, np.cumsum(np.bincount(at, minlength=len(common)))]
    use = np.zeros(len(common), bool)
    for a in range(len(common)):
        # a's texts in parts, so that memory is bounded
        told, expected = np.zeros(len(common)), np.zeros(len(common))
        held = holders[edge[a] : edge[a + 1]]
        for start in range(0, len(held), 1024):
            part = held[start : start + 1024]
            lengths = first[part + 1] - first[part]
            inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(first[part], lengths)
            told += np.bincount(at[inside], np.repeat(error[part], lengths), len(common))
            expected += np.bincount(at[inside], np.repeat(spread[part], lengths), len(common))
        found = told**2 >= LEAST_PAIR_CHI2 * np.maximum(expected, 1e-9)
        found[a] = False
        found &= told != 0
        if found.any():
            use[a] = True
            use |= found
    return common[use]


def fit(rows: list[np.ndarray], labels: np.ndarray, **steps) -> FactorizationMachine:
    """A model of the buckets that tell alone, then one of these and of the buckets that tell in pairs beyond it."""
    y = np.asarray(labels, np.float64)
    alone = telling(rows, y)
    model = fit_buckets(rows, y, alone, **steps)
    # held near the base rate, so that a text that happens to be sure does not outweigh the others
    predicted = np.clip(np.array([model.probability(model.slot[r]) for r in rows]), 0.02, 0.98)
    both = np.union1d(alone, telling_pairs(rows, y, predicted))
    return model if len(both) == len(alone) else fit_buckets(rows, y, both, **steps)


def fit_buckets(
    rows: list[np.ndarray], y: np.ndarray, use: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 0.03, decay: float = 0.001, seed: int = 7
) -> FactorizationMachine:
    """Adam on the log loss in mini-batches with decoupled weight decay; the same rows give the same model."""
    rng = np.random.default_rng(seed)
    slot = np.full(BUCKETS, -1, np.int64)
    slot[use] = np.arange(len(use))
    rows = [x[x >= 0] for x in (slot[r] for r in rows)]
    bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5)))
    # column 0 is the weight, the rest are the factors
    theta = np.zeros((len(use), 1 + FACTORS), np.float32)
    theta[:, 1:] = rng.normal(0, 0.01, (len(use), FACTORS))
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    step = 0
    for _ in range(epochs if len(use) else 0):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            part = order[start : start + batch]
            empty = [i for i in part if not len(rows[i])]
            bias -= rate * float((1 / (1 + np.exp(-bias)) - y[empty]).sum()) / len(part)
            part = [i for i in part if len(rows[i])]
            if not part:
                continue
            sizes = np.array([len(rows[i]) for i in part])
            at = np.concatenate([rows[i] for i in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            x = theta[at]
            edge = np.r_[0, np.cumsum(sizes)[:-1]]
            total = np.add.reduceat(x, edge, axis=0)
            square = np.add.reduceat(x[:, 1:] ** 2, edge, axis=0)
            z = bias + total[:, 0] + 0.5 * (total[:, 1:] ** 2 - square).sum(1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            slope = np.empty_like(x)
            slope[:, 0] = error[owner]
            slope[:, 1:] = error[owner, None] * (total[owner, 1:] - x[:, 1:])
            grad = np.stack([np.bincount(at, slope[:, c], len(use)) for c in range(1 + FACTORS)], 1).astype(np.float32)
            step += 1
            m += 0.1 * (grad - m)
            s += 0.001 * (grad * grad - s)
            theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6) + rate * decay * theta
            bias -= rate * float(error.sum())
    return FactorizationMachine(bias, theta[:, 0].copy(), theta[:, 1:].copy(), slot)


def fold(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_ROWS) -> FactorizationMachine:
    """A model of labels.toxic from labelled rows outside fold 0, at most ``sample`` of them.

    The sample is the rows with the smallest hashes of their ids (so it does not depend on partitioning); its ids
    are broadcast (at most ``sample`` rows). Rows with a null id or label are not used; of an id with several labels or
    texts the largest label and the text of the smallest hash count. Only the buckets of ``sample`` rows at most reach the driver.
    """
    chosen = (
        labels.select(F.col(id_col).alias("label_id"), F.col("toxic").cast("double").alias("toxic"))
        .filter("label_id is not null and toxic is not null")
        .filter(fold("label_id") != 0)
        .groupBy("label_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(sample)
    )
    buckets = F.pandas_udf(lambda s: s.map(terms_of, na_action=None), "array<int>")
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
        .select("label_id", F.struct(text_key("text").alias("key"), buckets("text").alias("terms"), "toxic").alias("row"))
        .groupBy("label_id")
        .agg(F.min("row").alias("row"))
        .select("label_id", "row.*")
        .toArrow()
        .sort_by("label_id")
    )
    # views of one buffer: no object for each term on the driver
    terms = rows["terms"].combine_chunks()
    flat, edge = terms.values.to_numpy(), terms.offsets.to_numpy()
    return fit([flat[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)], rows["toxic"].to_numpy().astype(np.float64))


def toxicity_scores(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of each row's whole text, one row per row; narrow.

    A null or empty text gets the score of a text without known terms. Repeated rows are scored each; a null id
    is in no fold (held_out false); an empty table gives no rows; other columns are ignored.
    """
    scored = docs.select(
        F.col(id_col), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), _score(model)(F.col(text_col)).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _score(model: FactorizationMachine):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(model.score, na_action=None).astype("float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows whose text is not predicted toxic, all columns as they were."""
    model = train(docs, labels, id_col, text_col)
    scored = whole_rows(docs).withColumn("score_", _score(model)(F.col(f"row_.`{text_col}`")))
    return scored.filter("score_ < 0.5").select("row_.*")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, train(docs, table(spark, sf_dir, "labels")))


ORACLE: dict[str, str] = {}
