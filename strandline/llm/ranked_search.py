"""Ranked lexical search: hybrid term-at-a-time and document-at-a-time evaluation over blocks of documents.

The words of the queries make a vocabulary. One pass over the texts writes, for each document, its length and the counts
of its vocabulary words, and beside them each task's statistics. The rows are then searched where they lie, in blocks:
the postings of a query's rare words are added up term by term into accumulators, which then count as one iterator with
one bound, beside those of its common words; documents are taken in order, stretch by stretch, and whatever cannot
reach the query's best ones by its bounds is skipped. Each task returns its best rows, which are ranked together.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import table, written
from strandline.llm.decontaminate import words_of

TOP = 50
#: Words of queries that are searched together; further queries take a further pass over the documents.
BLOCK_WORDS = 1_000_000
#: Documents, and postings, after which a task's block is searched; stretches in which bounds are held.
BLOCK_DOCS, BLOCK_POSTINGS, STRETCH = 32_768, 8_000_000, 2_048
#: A list is short, and summed term by term, up to this share of the block's documents.
SHORT = 1 / 32
#: Rows of a query that one task ranks before the last ranking.
SHARES = 64
INDEX = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("stat", pa.bool_())])
FOUND = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


class Queries:
    """Some queries as term numbers: ``names`` (their ids), ``terms`` (distinct numbers of each), ``vocabulary``."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.terms = [sorted({self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)}) for _, text in items]


def _indexer(queries: object) -> Callable:
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents with a word, in INDEX; then one row of the task: its words in ``n``, how many of its documents hold each term, and, under term -1, how many have a word."""
        known = queries.value.vocabulary
        held, words_seen, with_words = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            ids, sizes, terms, counts, ends = [], [], [], [], [0]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                if words:
                    seen = Counter(words)
                    mine = sorted((known[w], seen[w]) for w in known.keys() & seen.keys())
                    ids.append(key)
                    sizes.append(len(words))
                    terms.extend(t for t, _ in mine)
                    counts.extend(c for _, c in mine)
                    ends.append(len(terms))
            words_seen += sum(sizes)
            with_words += len(ids)
            held += np.bincount(np.array(terms, np.int64), minlength=len(known)) if terms else 0
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t)) for v, t in ((terms, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists, pa.array([False] * len(ids))], schema=INDEX)
        found = held.nonzero()[0]
        yield pa.RecordBatch.from_pylist([{"doc_id": None, "n": words_seen, "terms": [-1, *found.tolist()], "counts": [with_words, *held[found].tolist()], "stat": True}], schema=INDEX)

    return index


class Block:
    """Postings of some documents, inverted: of term t, ``docs[at[t]:at[t + 1]]`` (ascending) and their ``gains``."""

    def __init__(self, sizes: np.ndarray, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, n_docs: int, n_words: int):
        self.size = len(sizes)
        lengths = 100 - 50 + (50 * sizes * n_docs) // n_words
        doc = np.repeat(np.arange(self.size, dtype=np.int64), np.diff(starts))
        order = np.argsort(terms, kind="stable")
        terms, self.docs, counts = terms[order], doc[order], counts[order]
        self.gains = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * lengths[self.docs]))
        self.at = np.searchsorted(terms, np.arange(len(weights) + 1))


class Best:
    """The best rows of one query so far; ``least`` is the score that a further row must at least have."""

    def __init__(self, top: int):
        self.top, self.least = top, 1
        self.scores, self.keys = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """Keep the best of these and those; equal scores by key, the largest number standing for null."""
        self.scores, self.keys = np.concatenate([self.scores, scores]), np.concatenate([self.keys, keys])
        if len(self.scores) > self.top:
            kept = np.lexsort((self.keys, -self.scores))[: self.top]
            self.scores, self.keys = self.scores[kept], self.keys[kept]
        if len(self.scores) == self.top:
            self.least = max(1, int(self.scores.min()))


class Cursor:
    """One iterator over documents with gains, and its greatest gain in each stretch of documents."""

    def __init__(self, docs: np.ndarray, gains: np.ndarray, edges: np.ndarray):
        self.docs, self.gains = docs, gains
        self.cuts = np.searchsorted(docs, edges)
        self.bounds = np.zeros(len(edges) - 1, np.int64)
        full = np.diff(self.cuts) > 0
        if full.any():
            self.bounds[full] = np.maximum.reduceat(gains, self.cuts[:-1][full])

    def within(self, stretch: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.cuts[stretch], self.cuts[stretch + 1]
        return self.docs[a:b], self.gains[a:b]


def search_block(block: Block, terms: list[int], best: Best, keys: np.ndarray, short: float = SHORT, stretch: int = STRETCH) -> int:
    """Add the block's best documents for one query to ``best``; returns how many documents were scored.

    Lists of at most ``short`` of the block's documents are summed into accumulators (term at a time). These and the
    longer lists are iterators; in each stretch of documents, those of least bounds that together stay below the score
    to reach propose no documents: they are looked up only for documents that the others propose and that their bounds
    could still bring there.
    """
    edges = np.append(np.arange(0, block.size, stretch), block.size)
    spans = [(block.at[t], block.at[t + 1]) for t in terms if block.at[t + 1] > block.at[t]]
    rare = [s for s in spans if s[1] - s[0] <= short * block.size]
    cursors = [Cursor(block.docs[a:b], block.gains[a:b], edges) for a, b in spans if b - a > short * block.size]
    if rare:
        docs = np.concatenate([block.docs[a:b] for a, b in rare])
        gains = np.concatenate([block.gains[a:b] for a, b in rare])
        order = np.argsort(docs, kind="stable")
        docs, gains = docs[order], gains[order]
        first = np.append(True, docs[1:] != docs[:-1]).nonzero()[0]
        cursors.append(Cursor(docs[first], np.add.reduceat(gains, first), edges))
    if not cursors:
        return 0
    bounds = np.array([c.bounds for c in cursors])
    scored = 0
    # stretches that promise most come first, so that the score to reach rises early
    totals = bounds.sum(axis=0)
    for s in np.argsort(-totals, kind="stable"):
        if totals[s] < best.least:
            break
        order = np.argsort(bounds[:, s], kind="stable")
        sums = bounds[order, s].cumsum()
        passive = int(np.searchsorted(sums, best.least))
        parts = [cursors[i].within(s) for i in order[passive:]]
        docs = np.concatenate([d for d, _ in parts]) - edges[s]
        got = np.zeros(edges[s + 1] - edges[s], np.int64)
        for d, g in parts:
            got[d - edges[s]] += g
        seen = np.zeros(len(got), bool)
        seen[docs] = True
        docs = seen.nonzero()[0]
        scores = got[docs]
        scored += len(docs)
        for k in range(passive - 1, -1, -1):
            live = scores + sums[k] >= best.least
            docs, scores = docs[live], scores[live]
            if not len(docs):
                break
            d, g = cursors[order[k]].within(s)
            if len(d):
                place = np.minimum(np.searchsorted(d, docs + edges[s]), len(d) - 1)
                scores = scores + np.where(d[place] == docs + edges[s], g[place], 0)
        good = scores >= best.least
        if good.any():
            best.add(scores[good], keys[docs[good] + edges[s]])
    return scored


NO_KEY = np.iinfo(np.int64).max


def _searcher(queries: object, weights: object, n_docs: int, n_words: int, top: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value.terms
        best = [Best(top) for _ in asked]

        def settle(rows: list[pa.RecordBatch]) -> None:
            held = pa.Table.from_batches(rows).combine_chunks()
            terms = held.column("terms").combine_chunks()
            starts = np.concatenate([[0], np.cumsum(held.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (terms, held.column("counts").combine_chunks())]
            keys = held.column("doc_id").fill_null(NO_KEY).to_numpy()
            block = Block(held.column("n").to_numpy(), starts, flat[0], flat[1].astype(np.int64), weights.value, n_docs, n_words)
            for mine, terms in zip(best, asked, strict=True):
                search_block(block, terms, mine, keys)

        rows, docs, postings = [], 0, 0
        for batch in batches:
            rows.append(batch)
            docs += batch.num_rows
            postings += len(batch.column(2).flatten())
            if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                settle(rows)
                rows, docs, postings = [], 0, 0
        if docs:
            settle(rows)
        for q, mine in enumerate(best):
            if len(mine.scores):
                keys = pa.array(mine.keys, mask=mine.keys == NO_KEY)
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(mine.scores), pa.int32()), keys, pa.array(mine.scores)], schema=FOUND)

    return search


def _blocks(items: DataFrame) -> Iterator[Queries]:
    """The queries in blocks of bounded size, fetched one partition at a time."""
    block, words = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        words += len(words_of(row.text)) + 1
        if words >= BLOCK_WORDS:
            yield Queries(block)
            block, words = [], 0
    if block:
        yield Queries(block)


def weigh(n_docs: int, held: dict[int, int], size: int) -> np.ndarray:
    """Weight of each of ``size`` terms: floor(1000 ln((2N + 2) / (2 df + 1)))."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(t, 0) + 1))) for t in range(size)], np.int64)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``top`` best rows of ``docs`` for each row of ``items`` (item_id, text).

    Terms are runs of 0-9, letters and non-ASCII characters, A-Z lower-cased; null has none. Scores are whole numbers and
    exact: bounds only skip what cannot be among the best. Equal scores rank by key, null last; repeated rows rank
    each; items that are repeated, or share an id, are ranked each. An item without terms, or whose terms no document
    has, gives no rows; empty tables give none.

    The items are a stated query set, broadcast in blocks of at most BLOCK_WORDS words (and one item), each of which takes
    one pass over the texts. What is broadcast beside them is one weight for each of their words.
    """
    spark = docs.sparkSession
    out = None
    for block in _blocks(items):
        queries = spark.sparkContext.broadcast(block)
        index = written(docs.select(F.col(key).cast("long"), text).mapInArrow(_indexer(queries), "doc_id long, n long, terms array<int>, counts array<long>, stat boolean"))
        stats = index.where("stat")
        n_words = stats.agg(F.sum("n")).first()[0] or 0
        pairs = stats.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts"))
        held = dict(tuple(r) for r in pairs.collect())  # one row for each word of the block's queries
        n_docs = held.pop(-1, 0)
        weights = spark.sparkContext.broadcast(weigh(n_docs, held, len(block.vocabulary)))
        best = index.where("not stat").drop("stat").mapInArrow(_searcher(queries, weights, n_docs, max(n_words, 1), top), "query int, doc_id long, score long")
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        # as many rows as there are tasks times top are ranked in shares first
        dealt = best.withColumn("_share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)))
        first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("query", "_share").orderBy(*order))).where(F.col("rank") <= top)
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(block.names)), "query int, item_id long")
        found = ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows of ``documents`` for each ``benchmark`` item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY doc_id),
a AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS nw FROM s),
p AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, a GROUP BY term, nd),
g AS (SELECT p.doc_id, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nd) // nw)))) AS gain FROM p JOIN w USING (term) JOIN s USING (doc_id), a),
r AS (SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM q JOIN g USING (term) GROUP BY item_id, doc_id HAVING sum(gain) > 0),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r)
SELECT * FROM k WHERE rank <= 50
"""
QUERIES = {"op12_ranked_search": op12_ranked_search}
ORACLES = {"op12_ranked_search": OP12_SQL}
