"""Mixing, ranked search and the Merkle manifest: brute force, bounds, and odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import common, merkle, mixing, ranked_search

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").collect()


def _targets(sizes, weights=(5, 2, 1), share=1.5, limit=2):
    """Reshare round by round, as the contract puts it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, list(names), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * unit >= limit * sizes[s]]
        if not over:
            return out | {s: weight[s] * unit for s in open_}
        out |= {s: float(limit * sizes[s]) for s in over}
        left -= sum(limit * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def test_mixing_targets_and_words(spark, rows):
    out = {r.doc_id: r for r in mixing.op11_mixing(spark, DATA).collect()}
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    total = collections.Counter()
    for r in rows:
        total[r.source] += sizes[r.doc_id]
    targets = _targets(total)
    taken, spread = collections.Counter(), collections.Counter()
    for r in rows:
        x = out[r.doc_id]
        assert (x.size, x.source_size) == (sizes[r.doc_id], total[r.source]) and x.target == pytest.approx(targets[r.source])
        assert x.taken <= 2 * x.size and x.taken % max(x.size, 1) == 0
        rate = x.target / x.source_size if x.source_size else 0
        assert math.floor(rate) * x.size <= x.taken
        taken[r.source] += x.taken
        spread[r.source] += x.size**2 * (rate % 1) * (1 - rate % 1)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - targets[s]) <= 4 * math.sqrt(spread[s]) + 1e-6 for s in targets)
    assert [tuple(r) for r in mixing.op11_mixing(spark, DATA).orderBy("doc_id").collect()] == sorted(map(tuple, out.values()))


def test_mixing_rounds_of_resharing(spark):
    random.seed(4)
    for _ in range(4):
        sizes = {random.choice(["a", "Z", "é", "", "zz", "q1", "q2", None, "\U0001f600"]): random.choice([0, 1, 3, 50, 400]) for _ in range(7)}
        frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = mixing.source_targets(frame.select(mixing.key_of(F.col("source")).alias("source_key"), "size"))
        found = {None if r.source_key == "1" else r.source_key[1:]: r.target for r in got.collect()}
        assert found == pytest.approx(_targets(sizes))


def test_mix_emits_copies_alike_on_either_way(spark, rows):
    docs = spark.createDataFrame(rows)
    plan = {r.doc_id: r.copies for r in mixing.repetitions(docs).collect()}
    assert {r.doc_id: r.copies for r in mixing.repetitions(docs.repartition(7, "text"), few=0).collect()} == plan
    assert collections.Counter(r.doc_id for r in mixing.mixed(docs).collect()) == collections.Counter(plan)
    assert {r.doc_id: r.copies for r in mixing.repetitions(docs, seed=7).collect()} != plan


def test_mixing_draws_are_even(spark):
    u = np.array([r[0] for r in spark.range(20_000).select(mixing.draw(F.col("id"), F.lit(""), 42)).collect()])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and abs((u < 0.3).mean() - 0.3) < 0.012


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])])


def _rise(digests):
    """Levels of one tree, and for each leaf the (left, right) of each level."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    steps = []
    for i in range(len(digests)):
        own = []
        for level in levels[:-1]:
            start = i // 16 * 16
            own.append(("".join(level[start:i]), "".join(level[i + 1 : start + 16])))
            i //= 16
        steps.append(own)
    return levels[-1][0], steps


def _manifest(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r)))
        trees[s] = (own, *_rise([_leaf(r) for r in own]))
    root, upper = _rise([trees[s][1] for s in names])
    out = []
    for s, up in zip(names, upper, strict=True):
        own, subroot, steps = trees[s]
        for r, mine in zip(own, steps, strict=True):
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            low = dict(r) | {"text": r["text"] and re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])}
            cur = _leaf(low if changed else r)
            for a, b in mine + up:
                cur = _h(a, cur, b)
            out.append((r["doc_id"], _leaf(r), subroot, root, _h(*[a + b for a, b in mine + up]), cur, cur == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_merkle_equals_trees_built_in_memory(spark, rows):
    got = [tuple(r) for r in merkle.op13_merkle(spark, DATA).select(*COLUMNS).collect()]
    assert sorted(got) == sorted(_manifest([r.asDict() for r in rows]))
    assert {r[-1] for r in got} == {True, False}


def test_merkle_of_uneven_and_odd_rows(spark, tmp_path):
    """Trees of 1, 2, 16, 17, 256, 257 and 300 leaves, null and empty sources, nulls, ties and repeated rows."""
    data = [(i, f"Text {i} É", "en", s, i) for s, n in (("a", 1), ("b", 2), ("c", 16), ("d", 17), ("é", 256), ("", 257), (None, 300)) for i in range(n)]
    data += [(5, "Same", None, "tie", 1), (5, "Other", "fr", "tie", None), (5, "Same", None, "tie", 1), (None, None, None, "tie", None), (None, "", "en", None, 0)]
    docs = spark.createDataFrame(data, DOCS).selectExpr("*", "1 as lo", "2 as tree", "3 as digest", "4 as n").repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in merkle.op13_merkle(spark, str(tmp_path)).select(*COLUMNS).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in data]), key=key)
    few = merkle.manifest(docs, few=0).select("doc_id", "leaf", "subroot", "root").collect()
    assert sorted(map(tuple, few), key=key) == sorted((r[:4] for r in got), key=key)


def _ranked(docs, items, top=50):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    held = [(key, c) for key, t in docs if (c := collections.Counter(words(t)))]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        asked = set(words(text)) & df.keys()
        scores = []
        for key, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in asked if w in c)
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, key, -s) for i, (s, _, _, key) in enumerate(sorted(scores)[:top])]
    return out


def _order(r):
    return (r[0] is None, r[0] or 0, r[1:2], r[3], r[2] is None, r[2] or 0)


def test_ranked_search_equals_scoring_every_row(spark, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = [tuple(r) for r in ranked_search.op12_ranked_search(spark, DATA).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got) == sorted(_ranked([(r.doc_id, r.text) for r in rows], items))


@pytest.mark.parametrize("top,block", [(3, 4), (50, 32_768)])
def test_ranked_search_of_odd_rows(spark, monkeypatch, top, block):
    """Ties, repeated rows and items, nulls, empty and long texts, clashing columns; small blocks too."""
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block)
    docs = [(i, f"common {'rare ' * (i % 3)}word{i % 7} É {'filler ' * (i % 11)}") for i in range(60)]
    docs += [(7, "common rare"), (7, "common rare"), (None, "common rare"), (80, None), (81, ""), (82, "..."), (83, "common " * 50_000), (84, "COMMON Rare word3")]
    items = [(1, "common rare"), (1, "common rare"), (2, "Word3 é"), (None, "rare"), (3, None), (4, ""), (5, "absent"), (6, "common common filler")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as rank", "3 as terms", "4 as n")
    got = ranked_search.search(frame.repartition(3), spark.createDataFrame(items, "item_id long, text string"), top)
    assert sorted(map(tuple, got.collect()), key=_order) == sorted(_ranked(docs, items, top), key=_order)


def test_ranked_search_in_blocks_of_queries(spark, rows, monkeypatch):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").limit(12)
    docs = spark.createDataFrame(rows)
    whole = sorted(map(tuple, ranked_search.search(docs, items).collect()))
    monkeypatch.setattr(ranked_search, "BLOCK_WORDS", 100)
    assert sorted(map(tuple, ranked_search.search(docs, items).collect())) == whole


def test_search_block_skips_and_loses_nothing():
    rng = np.random.default_rng(3)
    n, words = 20_000, 40
    shares = np.array([0.8, 0.5, 0.3, *[0.1] * 7, *[0.01] * 15, *[0.001] * 15])
    held = [np.flatnonzero(rng.random(n) < s) for s in shares]
    doc = np.concatenate(held)
    term = np.repeat(np.arange(words, dtype=np.int32), [len(h) for h in held])
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    counts = rng.geometric(0.6, len(doc)).astype(np.int64)
    starts = np.searchsorted(doc, np.arange(n + 1))
    sizes = np.bincount(doc, weights=counts, minlength=n).astype(np.int64) + 50
    weights = ranked_search.weigh(n, {t: len(h) for t, h in enumerate(held)}, words)
    block = ranked_search.Block(sizes, starts, term, counts, weights, n, int(sizes.sum()))
    keys = np.arange(n, dtype=np.int64)
    proposed = 0
    for _ in range(20):
        terms = sorted(rng.choice(words, 12, replace=False).tolist())
        scores = np.zeros(n, np.int64)
        for t in terms:
            scores[block.docs[block.at[t] : block.at[t + 1]]] += block.gains[block.at[t] : block.at[t + 1]]
        want = np.lexsort((keys, -scores))[:50]
        best = ranked_search.Best(50)
        proposed += ranked_search.search_block(block, terms, best, keys)
        assert sorted(best.keys.tolist()) == sorted(want.tolist())
        best = ranked_search.Best(50)
        ranked_search.search_block(block, terms, best, keys, short=0.0, stretch=512)
        assert sorted(best.keys.tolist()) == sorted(want.tolist())
    assert proposed < 20 * n / 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert mixing.repetitions(none).count() == 0 and mixing.mixed(none).count() == 0
    assert merkle.manifest(none).count() == 0
    assert ranked_search.search(none, some).count() == 0 and ranked_search.search(none, items).count() == 0


def test_odd_documents(spark, docs):
    out = mixing.repetitions(docs.selectExpr("*", "1 as size", "2 as target", "3 as copies", "4 as rows")).collect()
    assert len(out) == docs.count() and all(0 <= r.copies <= 2 and r.rows == 4 for r in out)
    assert {r.size for r in out if not (r.text or "").strip()} == {0}
    assert len({r.copies for r in out if r.doc_id == 1}) == 1
    assert merkle.manifest(docs).count() == docs.count()


def test_attach_deals_a_common_key_in_shares(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"))
    values = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first"))
    for limit in (0, 10_000):
        got = common.attach(rows, values, "key", F.col("id"), most=100, limit=limit)
        assert got.count() == 3000 and got.where("first > id").count() == 0 and "_share" not in got.columns
