"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made."""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.runtime import table

#: Words kept with their count; the memory of a worker is bounded by this and WORD_CHARS.
CACHE_WORDS = 1 << 19
WORD_CHARS = 48
#: Bits of a symbol's number and of a place in a word, where several numbers share an int.
BITS, PLACE = 20, 40
SYMBOLS, PLACES = (1 << BITS) - 1, (1 << PLACE) - 1
#: Unicode White_Space, as the vocabulary's own pattern understands it.
SPACE = r"\t-\r \x85\xa0  -     　"


def latin_letters(kind: str) -> str:
    """Characters below 256 of a Unicode category's first letter, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)


def is_latin(text: str) -> bool:
    """Whether all characters are below 256; the standard library then splits faster than Unicode properties do."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=1)
def newer_letters() -> re.Pattern:
    """Finds code points that this Python's Unicode does not assign. Libraries follow other versions of Unicode, so whether
    such a code point is a letter, and what its lower case is, is asked of the vocabulary's own library."""
    bare = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])
    edge = np.flatnonzero(np.diff(np.r_[False, bare, False]))
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in edge.reshape(-1, 2).tolist()) + "]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    spare = (b for b in range(256) if b not in letters)
    letters |= {b: chr(256 + i) for i, b in enumerate(spare)}
    return [letters[b] for b in range(256)]


class PairMerger:
    """Counts the symbols that are left of a word when no pair of the merge list remains."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str = ""):
        number: dict[str, int] = {}
        at = lambda s: number.setdefault(s, len(number))
        letters = byte_letters()
        self.inner = [at(x) for x in letters]
        self.final = [at(x + suffix) for x in letters]
        #: pair of symbols -> (rank + 1, symbol that replaces it), each packed into one int
        self.rule: dict[int, int] = {}
        for i, (x, y) in enumerate(merges):
            self.rule.setdefault(at(x) << BITS | at(y), (i + 1) << BITS | at(x + y))
        if len(number) >> BITS:
            raise ValueError("too many symbols")

    def count(self, word: bytes) -> int:
        n = len(word)
        if n < 2:
            return n
        rule = self.rule.get
        inner = self.inner
        symbol = [inner[b] for b in word]
        symbol[-1] = self.final[word[-1]]
        # the rule for the pair that starts at each symbol, 0 if there is none or the symbol is gone
        pair = [rule(a << BITS | b, 0) for a, b in zip(symbol, symbol[1:], strict=False)]
        heap = [r >> BITS << PLACE | i for i, r in enumerate(pair) if r]
        if not heap:
            return n
        heapq.heapify(heap)
        pair.append(0)
        after = [*range(1, n + 1)]
        before = [*range(-1, n - 1)]
        left = n
        while heap:
            top = heapq.heappop(heap)
            i = top & PLACES
            r = pair[i]
            if r >> BITS != top >> PLACE:
                continue  # one of the two has been merged meanwhile
            left -= 1
            j = after[i]
            symbol[i] = merged = r & SYMBOLS
            pair[j] = 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair[i] = r = rule(merged << BITS | symbol[k], 0)
                if r:
                    heapq.heappush(heap, r >> BITS << PLACE | i)
            else:
                pair[i] = 0
            h = before[i]
            if h >= 0:
                pair[h] = r = rule(symbol[h] << BITS | merged, 0)
                if r:
                    heapq.heappush(heap, r >> BITS << PLACE | h)
        return left


class TextCounter(dict):
    """Counts tokens of whole texts for a lower-casing byte-level vocabulary with word ends.

    A dict of words already counted; the words are those of the vocabulary file's own pattern.
    """

    def __init__(self, path: str):
        super().__init__()
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merger = PairMerger([tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or "")
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True))))
        pattern = "[{0}]+|'(?:s|t|re|ve|m|ll|d)|[{1}]|[^{2}{0}{1}]+"
        self.words = regex.compile(pattern.format(r"\p{L}", r"\p{N}", SPACE)).findall
        self.latin_words = re.compile(pattern.format(latin_letters("L"), latin_letters("N"), SPACE)).findall

    def __missing__(self, word: str) -> int:
        n = self.merger.count(word.encode())
        if len(word) <= WORD_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not is_latin(text) and newer_letters().search(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if self.special.search(text) is None:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        if not text.isascii():
            # single capitals are lowered without regard to their place in a word
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return sum(map(self.__getitem__, (self.latin_words if is_latin(text) else self.words)(text)))


@lru_cache(maxsize=2)
def _counter(path: str) -> TextCounter:
    return TextCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_bytes, n_tokens and over_limit of each row's whole text, one row per row in no set order.

    Strings of added tokens inside a text count as one token each. Texts with code points newer than this Python's Unicode
    are counted by the vocabulary's library. A null text counts as empty (0, 0, false);
    repeated rows are counted each; an empty table gives no rows; other columns are ignored. ``vocabulary``: path
    of the vocabulary file, readable on every executor. Narrow: no shuffle; words outside the bounded cache are
    merged in O(n log n), so a very long word costs no more than its share.
    """

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(_counter(vocabulary).count, na_action=None).astype("int64")

    n = docs.select(
        F.col(id_col), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), count(F.col(text_col)).alias("n_tokens")
    )
    return n.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


ORACLE: dict[str, str] = {}
