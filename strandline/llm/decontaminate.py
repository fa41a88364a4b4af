"""Benchmark decontamination: spaced-seed hashes find shared places, verified with substitutions allowed."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import table

#: Word positions that a hash samples (1) and ignores (0). With these, every item of 12 words or more that
#: keeps four fifths of its words is hit (checked over all choices of words for 12 to 15, 20 and 25 words).
MASKS = ("110111", "100001111")
#: Shortest matched passage, in words (or the whole item, if shorter), and least share of equal words in it.
LEAST, SIMILARITY = 13, 0.8
#: Items under this many words are hashed through masks of their own length instead (see short_masks).
SHORT = 12
#: Words of items that are broadcast together; further items take further passes over the documents.
BLOCK_WORDS = 2_000_000
#: A-Z to lower case, other ASCII bytes that are not 0-9 or a-z to spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words (runs of 0-9, a-z and non-ASCII characters) of a text; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def short_masks(n: int) -> set[tuple[int, ...]]:
    """Masks that hit every match of an item of ``n`` words: one for each choice of the words that may differ.

    No word of an item under five words may differ. Masks start at the first word they sample.
    """
    keep = math.ceil(round(SIMILARITY * n, 6))
    return {tuple(i - c[0] for i in c) for c in itertools.combinations(range(n), keep)}


class SeedIndex:
    """Spaced-seed hashes of some items: sorted hashes with their item and word position."""

    def __init__(self, items: list[tuple[int, str | None]], masks: tuple[str, ...] = MASKS):
        kept = [(item, w) for item, text in items if (w := words_of(text))]
        self.names = [item for item, _ in kept]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in kept for w in words))}
        self.items = [np.array([self.vocabulary[w] for w in words], dtype=np.int64) for _, words in kept]
        # fixed odd multipliers spread word numbers over 64 bits
        self.factors = (np.arange(1, 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        sizes = {len(ids) for ids in self.items}
        # (mask, length of the items it is for); none is a length of SHORT words or more
        self.masks = [([i for i, c in enumerate(m) if c == "1"], None) for m in masks if any(n >= SHORT for n in sizes)]
        self.masks += [(list(mask), n) for n in sorted(sizes) if n < SHORT for mask in sorted(short_masks(n))]
        found = []
        for n, ids in enumerate(self.items):
            for m, (mask, size) in enumerate(self.masks):
                if size == (len(ids) if len(ids) < SHORT else None):
                    at, hashes = self._hashes(ids, mask, m)
                    found += [(int(h), n, int(p)) for h, p in zip(hashes, at, strict=True)]
        found.sort()
        self.hashes = np.array([f[0] for f in found], dtype=np.uint64)
        self.at = [(f[1], f[2]) for f in found]

    def _hashes(self, ids: np.ndarray, mask: list[int], m: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions where all sampled words are known, and their hashes under mask number ``m``."""
        n = len(ids) - mask[-1]
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        known = ids >= 0
        good = known[:n].copy()
        for i in mask[1:]:
            good &= known[i : i + n]
        at = good.nonzero()[0]
        out = np.full(len(at), m + 1, dtype=np.uint64)
        for k, i in enumerate(mask):
            out = (out ^ (ids[at + i].astype(np.uint64) + np.uint64(1))) * self.factors[(k + 7 * m) % len(self.factors)]
            out ^= out >> np.uint64(29)
        return at, out

    def search(self, text: str | None) -> list[tuple]:
        """(item, places, first word, end word, item first word, equal words, similarity) of each item in a text."""
        words = words_of(text)
        if not words or not len(self.hashes):
            return []
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        diagonals = set()
        for m, (mask, _) in enumerate(self.masks):
            at, hashes = self._hashes(ids, mask, m)
            if not len(at):
                continue
            low = np.searchsorted(self.hashes, hashes)
            hit = (self.hashes[np.minimum(low, len(self.hashes) - 1)] == hashes).nonzero()[0]
            for j in hit.tolist():
                value, k, p = hashes[j], int(low[j]), int(at[j])
                while k < len(self.hashes) and self.hashes[k] == value:
                    item, q = self.at[k]
                    diagonals.add((item, p - q))
                    k += 1
        best: dict[int, list] = {}
        for item, shift in sorted(diagonals):
            if found := verify(ids, self.items[item], shift):
                equal, start, end = found
                row = best.setdefault(item, [0, -1])
                row[0] += 1
                if equal > row[1]:
                    row[1:] = [equal, start, end, start - shift]
        return [(self.names[item], r[0], r[2], r[3], r[4], r[1], r[1] / (r[3] - r[2])) for item, r in sorted(best.items())]


def verify(ids: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(equal words, start, end) of the longest passage on a diagonal with enough equal words, or None.

    ``shift`` is the document position of the item's first word. A passage counts if it has LEAST words (or the
    whole item, if that is shorter) and at least SIMILARITY of them are equal; it starts and ends at equal words.
    """
    lo, hi = max(0, shift), min(len(ids), shift + len(item))
    equal = ids[lo:hi] == item[lo - shift : hi - shift]
    if equal.sum() < SIMILARITY * min(LEAST, len(item)):
        return None
    # integer weights keep the comparison exact: a passage is good if its sum is not negative
    keep, miss = round((1 - SIMILARITY) * 100), round(SIMILARITY * 100)
    total = np.concatenate([[0], np.cumsum(np.where(equal, keep, -miss))])
    top = np.maximum.accumulate(total[::-1])[::-1]
    best, i, j, n = (0, 0), 0, 0, len(total)
    low = np.minimum.accumulate(total)
    while i < n and j < n:
        if top[j] >= low[i]:
            if j - i > best[1] - best[0]:
                best = (i, j)
            j += 1
        else:
            i += 1
    a, b = best
    if b - a < min(LEAST, len(item)):
        return None
    spots = equal[a:b].nonzero()[0]
    a, b = a + spots[0], a + spots[-1] + 1
    return int(equal[a:b].sum()), lo + int(a), lo + int(b)


SCHEMA = "item_id long, n_places long, first_word long, end_word long, item_word long, n_equal long, similarity double"


def find_passages(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds: ``key`` and the columns of SCHEMA.

    Words of both sides are hashed through MASKS, which ignore some positions; equal hashes give diagonals, on
    which the passage is verified with substitutions allowed. ``n_places`` counts verified diagonals; the span is
    that with the most equal words. The items are a stated query set: they are read in blocks of at most
    BLOCK_WORDS words, each broadcast and searched in all documents, so nothing broadcast grows with the documents.
    Items under five words match as whole sequences of words. Null and empty texts and items match nothing. Repeated rows each give rows;
    documents without a match give none.
    """
    spark = docs.sparkSession
    out = None
    for block in _blocks(items):
        index = spark.sparkContext.broadcast(SeedIndex(block))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(k, *hit) for k, t in zip(batch[key], batch[text], strict=True) for hit in index.value.search(t)]
                yield pd.DataFrame(rows, columns=[key, *(c.split()[0] for c in SCHEMA.split(", "))])

        found = docs.select(key, text).mapInPandas(search, f"{key} long, {SCHEMA}")
        out = found if out is None else out.union(found)
    return docs.select(key).limit(0).join(spark.createDataFrame([], SCHEMA)) if out is None else out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of bounded size, fetched one partition at a time."""
    block, words = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        words += len(words_of(row.text))
        if words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without those that hold a passage of an item (see find_passages), filtered where they lie, unshuffled."""
    for block in _blocks(items):
        docs = docs.where(_clean_test(docs.sparkSession.sparkContext.broadcast(SeedIndex(block)))(text))
    return docs


def _clean_test(index: Broadcast) -> Callable:
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not index.value.search(t) for t in texts], dtype=bool)

    return clean


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of ``benchmark`` items in all ``documents``."""
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES: dict[str, str] = {}
