"""Removal of long repeated byte strings by suffix arrays over aligned candidates.

A string of WIDTH bytes is a window. Each window has an anchor, chosen from its content alone, so equal windows have
anchors at equal places. Consecutive windows of one anchor whose distances from it are in one of a few fixed ranges
form a run. The core of a run is the bytes that all windows of its range share, its region what its own windows cover.
Windows of two runs can be equal only if the cores are, so runs whose core occurs once are done. The distinct regions of
every other core are aligned, and a suffix array over their distinct pieces decides which of their windows occur twice;
a region's windows are then those of all runs that have it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from strandline.llm.common import cut, forget, spread_join, table, written
from strandline.llm.suffix_sort import common_prefixes, suffix_array

#: Bytes of a repeated string, and bytes of the grams that anchors start.
WIDTH, GRAM = 400, 8
#: Runs of one core that one task aligns; a core with more is split by halving its runs.
MEMBERS = 1_500
#: Shares into which the runs of one core are dealt where they are joined.
SHARES = 16
#: A passage has PASSAGE words (50, less one at either end that may stick to other text); PHRASE words of it are compared.
PASSAGE, PHRASE = 48, 32
#: Windows of a text that are looked at together.
STRETCH = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def runs_of(data: bytes, width: int = WIDTH) -> list[tuple[int, int, int, int]]:
    """(base, side, first, last) of each run of a text; together they are all its windows.

    Windows are numbered from ``base``, the first that the run's range has room for, so they are 0 to ``side`` at most.
    A window's anchor is the first of its grams with the least hash. Least hashes of all windows come from minima over
    spans that double in length. Long texts go in stretches of STRETCH windows; a run then ends where a stretch does.
    """
    n = len(data) - width + 1
    grams = width - GRAM + 1
    near = grams // 3
    out = []
    for start in range(0, max(n, 0), STRETCH):
        stop = min(n, start + STRETCH)
        a = np.frombuffer(data, np.uint8, stop - start + width - 1, start).astype(np.uint64)
        a = a[:-1] | a[1:] << np.uint64(8)
        a = a[:-2] | a[2:] << np.uint64(16)
        a = a[:-4] | a[4:] << np.uint64(32)
        # the hash above, the place below: the least of them is the first least hash
        least = (a * _MIX) >> np.uint64(32) << np.uint64(32) | np.arange(len(a), dtype=np.uint64)
        size = 1
        while size < grams:
            step = min(size, grams - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64) + start
        edges = np.flatnonzero(np.diff(anchor)) + 1
        starts = np.concatenate([[0], edges])
        ends = np.concatenate([edges, [len(anchor)]]) - 1
        for lo, hi, place in zip((starts + start).tolist(), (ends + start).tolist(), anchor[starts].tolist(), strict=True):
            if hi > place - near:
                base = place - near + 1
                out.append((base, near - 1, max(lo, base) - base, hi - base))
            if lo <= place - near:
                base = place - grams + 1
                out.append((base, grams - near - 1, lo - base, min(hi, place - near) - base))
    return out


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


@F.pandas_udf(BinaryType())
def squeezed(texts: pd.Series) -> pd.Series:
    """UTF-8 bytes of texts, compressed one by one, for a shuffle that moves them all; null is empty."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return pd.Series([squeeze((t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype=object)


def loosened(data: bytes) -> bytes:
    """The bytes of a squeezed text."""
    return zstandard.ZstdDecompressor().decompress(data)


RUN = "core long, region long, doc_id long, k int, place long"
#: Bits of each of a run's side, first and last window in its ``place``; above them is its base, plus _BELOW, as the
#: base can lie before the text.
_FIELD, _BELOW = 9, 512


def _unpack(place: int) -> tuple[int, int, int, int]:
    """(base, side, first, last) of a run's place."""
    low = (1 << _FIELD) - 1
    return (place >> 3 * _FIELD) - _BELOW, place >> 2 * _FIELD & low, place >> _FIELD & low, place & low


def runs(docs: DataFrame, width: int) -> DataFrame:
    """All runs (RUN) of ``docs`` (``doc_id, k, text``)."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            cores, regions, owners, places = [], [], [], []
            for doc, k, text in zip(batch["doc_id"].tolist(), batch["k"].tolist(), batch["text"].tolist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                found = runs_of(data, width)
                cores += [digest(data[base + side : base + width], side) for base, side, _, _ in found]
                regions += [digest(data[base + first : base + last + width], 1) for base, _, first, last in found]
                owners += [(doc, k)] * len(found)
                places += [((b + _BELOW << _FIELD | s) << _FIELD | x) << _FIELD | y for b, s, x, y in found]
            owner = np.array(owners, np.int64).reshape(-1, 2)
            yield pd.DataFrame(
                {
                    "core": np.array(cores, np.uint64).astype(np.int64),
                    "region": np.array(regions, np.uint64).astype(np.int64),
                    "doc_id": owner[:, 0],
                    "k": owner[:, 1].astype(np.int32),
                    "place": np.array(places, np.int64),
                }
            )

    return docs.mapInPandas(find, RUN)


def shared_windows(rows: list[tuple[bytes, bytes, int]], side: int) -> list[list[tuple[int, int]]]:
    """For each run of one core, the (first, last) ranges of its windows that another run, or a copy, has too.

    ``rows`` has the bytes before and after the core, as far as the run's windows go, and how often the run occurs
    (2 stands for more). Window ``t`` is ``side - t`` bytes before the core, the core, and ``t`` bytes after it.
    """
    # a run can share a window only if what it shares with any one on the left and on the right adds up to enough
    left, right = _reach([r[0][::-1] for r in rows], [r[2] for r in rows]), _reach([r[1] for r in rows], [r[2] for r in rows])
    alive = [i for i in range(len(rows)) if left[i] + right[i] >= side]
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    if not alive:
        return out
    # what a run shares with no other cannot matter, so it is left out
    forms: dict[tuple, list[int]] = {}
    for i in alive:
        forms.setdefault((rows[i][0][len(rows[i][0]) - left[i] :], rows[i][1][: right[i]]), []).append(i)
    keys = list(forms)
    columns = np.empty((len(keys), 2 * side), dtype=np.int32)
    for c, (before, after) in enumerate(keys):
        columns[c] = 256 + c
        columns[c, side - len(before) : side] = np.frombuffer(before, np.uint8)
        columns[c, side : side + len(after)] = np.frombuffer(after, np.uint8)
    # columns that divide the runs alike become one piece, named by its place and the first run that has it
    names = _first_alike(columns)
    change = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1
    ends = [x for before, after in keys for x in (side - len(before), side + len(after))]
    cuts = sorted({0, side, 2 * side, *ends, *change.tolist()})
    before = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b <= side]
    after = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a >= side]
    width = len(keys) + 1
    core = len(before) * width
    text: list[int] = []
    origin: list[tuple[int, int]] = []
    stop = (len(before) + len(after) + 1) * width
    for c, key in enumerate(keys):
        row = names[c].tolist()
        lo, hi = side - len(key[0]), side + len(key[1])
        pieces = [(p, p * width + row[a]) for p, (a, _) in enumerate(before) if a >= lo]
        pieces.append((len(before), core))
        pieces += [(p, p * width + row[a]) for p, (a, b) in enumerate(after, len(before) + 1) if b <= hi]
        many = len(forms[key]) > 1 or any(rows[i][2] > 1 for i in forms[key])
        for _ in range(1 + many):
            origin += [(c, p) for p, _ in pieces]
            text += [x for _, x in pieces]
            origin.append((c, -1))
            text.append(stop)
            stop += 1
    order = suffix_array(text)
    common = common_prefixes(text, order)
    best: dict[tuple[int, int], int] = {}
    for k, i in enumerate(order):
        own = max(common[k], common[k + 1] if k + 1 < len(order) else 0)
        if own > best.get(origin[i], 0):
            best[origin[i]] = own
    for c, key in enumerate(keys):
        ranges = []
        for p, (a, b) in enumerate([*before, (side, side + 1)]):
            matched = best.get((c, p), 0)
            beyond = matched - (len(before) - p) - 1
            if beyond < 0:
                continue
            # the match holds the core and this many bytes after it, so later windows of this piece reach too far
            reach = after[beyond - 1][1] - side if beyond else 0
            if a <= min(b - 1, reach):
                ranges.append((a, min(b - 1, reach)))
        for i in forms[key]:
            out[i] = ranges
    return out


def _first_alike(columns: np.ndarray) -> np.ndarray:
    """For each cell, the number of the first row with the same value in its column."""
    order = np.argsort(columns, axis=0, kind="stable")
    value = np.take_along_axis(columns, order, axis=0)
    new = np.ones(columns.shape, dtype=bool)
    new[1:] = value[1:] != value[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(columns))[:, None], 0), axis=0)
    out = np.empty(columns.shape, dtype=np.int64)
    np.put_along_axis(out, order, np.take_along_axis(order, start, axis=0), axis=0)
    return out


def _reach(parts: list[bytes], counts: list[int]) -> list[int]:
    """Longest prefix of each part that another one, or a copy, starts with too."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [len(p) if c > 1 else 0 for p, c in zip(parts, counts, strict=True)]
    for x, y in zip(order, order[1:], strict=False):
        a, b = parts[x], parts[y]
        if a == b:
            same = len(a)
        else:
            lo, hi = 0, min(len(a), len(b))
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if a[:mid] == b[:mid]:
                    lo = mid
                else:
                    hi = mid - 1
            same = lo
        out[x], out[y] = max(out[x], same), max(out[y], same)
    return out


#: Distinct regions to decide: the names of the core, the run's own core and region, the place of its first window among
#: the region's, the number of windows in the range less one, how often the region occurs, and the bytes around the core.
OPEN = "core long, core2 long, home long, region long, at int, side int, copies int, before binary, after binary"
#: Windows of a region, numbered from its first, that occur twice.
DECIDED = "core long, region long, lo int, hi int"
NAMES, DECIDED_NAMES = ([c.split()[0] for c in x.split(", ")] for x in (OPEN, DECIDED))


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeated windows (DECIDED) of regions sorted by core."""
    rest: list[tuple] = []

    def solve(rows: list[tuple]) -> list[tuple]:
        found = shared_windows([(r[7], r[8], r[6]) for r in rows], rows[0][5])
        # windows are numbered in the range; the region's first is ``side`` less the bytes before the core
        return [(r[2], r[3], r[4] + a - r[5] + len(r[7]), r[4] + b - r[5] + len(r[7])) for r, ranges in zip(rows, found, strict=True) for a, b in ranges]

    for batch in batches:
        rows = rest + list(batch.itertuples(index=False, name=None))
        groups = [list(g) for _, g in groupby(rows, key=lambda r: (r[0], r[1]))]
        rest = groups.pop() if groups else []
        yield pd.DataFrame([s for g in groups for s in solve(g)], columns=DECIDED_NAMES)
    if rest:
        yield pd.DataFrame(solve(rest), columns=DECIDED_NAMES)


def _halve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each open region as its lower and upper half of windows, with the larger cores these have."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        out = []
        for core, core2, home, region, at, side, copies, before, after in batch.itertuples(index=False, name=None):
            h = (side + 1) // 2
            name = core.to_bytes(8, "little", signed=True) + core2.to_bytes(8, "little", signed=True)
            first = side - len(before)
            halves = []
            if h and first < h:
                inner = h - 1 - first
                halves.append((b"<", at, h - 1, before[inner:], before[:inner], after[: h - 1]))
            if len(after) >= h:
                halves.append((b">", at + max(0, h - first), side - h, after[:h], before[max(0, len(before) - (side - h)) :], after[h:]))
            for kind, start, size, more, b, a in halves:
                out.append((_signed(digest(kind + name + more, 3)), _signed(digest(kind + name + more, 4)), home, region, start, size, copies, b, a))
        yield pd.DataFrame(out, columns=NAMES)


def repeated_windows(docs: DataFrame, regions: DataFrame, width: int = WIDTH, members: int = MEMBERS) -> DataFrame:
    """Windows (DECIDED) that occur twice, of ``regions`` (``core, region, copies`` and a run ``doc_id, k, place``)."""
    shared = regions.withColumn("share", F.pmod(F.xxhash64("region"), F.lit(SHARES)))
    sized = spread_join(shared, regions.groupBy("core").agg(F.count(F.lit(1)).cast("int").alias("forms")), ["core"])
    wanted = sized.groupBy("doc_id", "k").agg(F.collect_list(F.struct("core", "region", "place", "copies", "forms")).alias("runs"))
    texts = docs.select("doc_id", "k", squeezed("text").alias("squeezed")).dropDuplicates(["doc_id", "k"])
    # what is wanted grows with the documents, so it is never a small side
    with_text = texts.join(wanted.hint("merge"), ["doc_id", "k"]).select("squeezed", "runs")

    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, listed in zip(batch["squeezed"], batch["runs"], strict=True):
                data = loosened(text)
                for r in listed:
                    base, side, first, last = _unpack(r["place"])
                    inner, outer = base + side, base + width
                    second = _signed(xxhash.xxh3_64_intdigest(data[inner:outer], 5))
                    before, after = data[base + first : inner], data[outer : base + last + width]
                    out.append((r["core"], second, r["core"], r["region"], 0, side, r["copies"], before, after, r["forms"]))
            yield pd.DataFrame(out, columns=[*NAMES, "forms"])

    # most cores go straight to their suffix arrays; only those with too many forms are split first
    every = written(with_text.mapInPandas(sides, f"{OPEN}, forms int"))
    decided = _aligned(every.where(F.col("forms") <= members).select(*NAMES))
    todo = every.where(F.col("forms") > members).select(*NAMES)
    if todo.isEmpty():
        return decided
    while True:
        sizes = todo.groupBy("core", "core2").agg(F.count(F.lit(1)).alias("_forms"), F.max("copies").alias("_most"))
        shared = todo.withColumn("share", F.pmod(F.xxhash64("home", "region", "at"), F.lit(SHARES)))
        sized = spread_join(shared, sizes.where("_forms > 1 or _most > 1"), ["core", "core2"])
        fits = _aligned(sized.where(F.col("_forms") <= members).select(*NAMES))
        decided = decided.union(fits)
        halves = cut(sized.where(F.col("_forms") > members).select(*NAMES).mapInPandas(_halve, OPEN))
        if halves.isEmpty():
            return decided
        # halves that are equal as a whole are done; one of them stays as a partner for the others
        key = ["core", "core2", "before", "after"]
        alike = halves.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("copies").alias("_copies"), F.min(F.struct("home", "region", "at", "side")).alias("_at"))
        many = (F.col("_n") > 1) | (F.col("_copies") > 1)
        same = spread_join(halves.withColumn("share", F.pmod(F.xxhash64("home", "region", "at"), F.lit(SHARES))), alike.where(many).select(key), key)
        windows = F.length("before") + F.length("after") - F.col("side")
        decided = decided.union(same.select(F.col("home").alias("core"), "region", F.col("at").alias("lo"), (F.col("at") + windows).alias("hi")))
        todo = cut(alike.select("core", "core2", "_at.*", F.when(many, 2).otherwise(1).alias("copies"), "before", "after").select(*NAMES))


def _aligned(todo: DataFrame) -> DataFrame:
    return todo.repartition("core", "core2").sortWithinPartitions("core", "core2").mapInPandas(_align, DECIDED)


def repeated_spans(docs: DataFrame, width: int = WIDTH, members: int = MEMBERS) -> DataFrame:
    """Byte spans ``doc_id, k, lo, hi`` (end exclusive, overlapping) that repeated strings of ``width`` bytes cover in ``docs``.

    ``docs`` has ``doc_id`` (not null), ``k`` (a hash of the text) and ``text``.
    """
    held = written(runs(docs, width))
    found = held.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
    often = found.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = often.select("core", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    # such cores are a share of all, so they are never a small side
    live = written(found.join(often.hint("merge"), ["core", "share"]))
    forget(held)
    per_region = live.groupBy("core", "region").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "k", "place")).alias("run"))
    regions = written(per_region.select("core", "region", F.least("copies", F.lit(2)).cast("int").alias("copies"), "run.*"))
    decided = spread_join(live, repeated_windows(docs, regions, width, members), ["core", "region"])
    begin = F.shiftright("place", 3 * _FIELD) - _BELOW + F.shiftright("place", _FIELD).bitwiseAND(F.lit((1 << _FIELD) - 1))
    return decided.select("doc_id", "k", (begin + F.col("lo")).cast("int").alias("lo"), (begin + F.col("hi") + width).cast("int").alias("hi"))


def phrases_of(text: str | None, passage: int = PASSAGE, phrase: int = PHRASE) -> np.ndarray:
    """Distinct hashes of some runs of ``phrase`` words, at least one from every ``passage`` words in a row.

    Of the phrases in each passage the one of least hash is taken, so equal passages yield the same. Words are what
    white space separates.
    """
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words) - passage + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    # a phrase's hash is a polynomial in _MIX, by Horner's rule on spans that double; arithmetic is modulo 2**64
    size, power = 1, _MIX
    with np.errstate(over="ignore"):
        while size < phrase:
            hashed = hashed[:-size] * power + hashed[size:]
            size, power = 2 * size, power * power
        least = (hashed ^ hashed >> np.uint64(29)) * _MIX
    spread = passage - phrase + 1
    size = 1
    while size < spread:
        step = min(size, spread - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    return np.unique(least).astype(np.int64)


def shared_phrases(docs: DataFrame, passage: int = PASSAGE, phrase: int = PHRASE) -> DataFrame:
    """``doc_id, k, n_shared_phrases`` of the documents that have phrases of other rows' (see phrases_of).

    It is positive wherever a passage of ``passage`` words stands in another row too, and zero (no row here) where not
    even ``phrase`` words (a power of 2) in a row do. Repeats inside one text do not count.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [phrases_of(t, passage, phrase) for t in batch["text"]]
            size = [len(x) for x in found]
            yield pd.DataFrame({"phrase": np.concatenate([np.zeros(0, np.int64), *found]), "doc_id": np.repeat(batch["doc_id"].to_numpy(np.int64), size), "k": np.repeat(batch["k"].to_numpy(np.int32), size)})

    found = written(docs.mapInPandas(find, "phrase long, doc_id long, k int"))
    often = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("phrase")
    shared = found.join(often.hint("merge"), "phrase")
    # of repeated rows, all count alike
    counts = written(shared.groupBy("doc_id", "k").agg(F.count_distinct("phrase").alias("n_shared_phrases")))
    forget(found)
    return counts


def remove_repeats(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_phrases, kept_text``.

    Texts are UTF-8 bytes. Every byte that lies in a string of ``width`` bytes which also starts anywhere else,
    in the same text (overlapping or not) or another, is removed; strings are judged on the input and never cross
    texts. ``kept_sha256`` is the hash of the remaining bytes, ``kept_text`` these bytes. ``n_shared_phrases`` tells of
    passages that other texts have too, which may be shorter than ``width`` (see shared_phrases); it removes
    nothing. Null and empty texts keep nothing and lose nothing; repeated rows are copies of each other; other
    columns are not read.
    """
    named = docs.select(F.col(key).alias("own_id"), F.coalesce(F.col(key), F.lit(-1)).cast("long").alias("doc_id"), F.hash(F.col(text)).alias("k"), F.col(text).alias("text"))
    own = named.select("doc_id", "k", "text")
    spans = repeated_spans(own, width).select("doc_id", "k", F.struct("lo", "hi").alias("span"), F.lit(None).cast("long").alias("n_shared_phrases"))
    phrases = shared_phrases(own).select("doc_id", "k", F.lit(None).cast("struct<lo int, hi int>").alias("span"), "n_shared_phrases")
    listed = spans.union(phrases).groupBy("doc_id", "k").agg(F.collect_set("span").alias("spans"), F.max("n_shared_phrases").alias("n_shared_phrases"))
    texts = named.select("own_id", "doc_id", "k", squeezed("text").alias("squeezed"))
    joined = texts.join(listed.hint("merge"), ["doc_id", "k"], "left").select("own_id", "squeezed", "spans", F.coalesce("n_shared_phrases", F.lit(0)).cast("long").alias("n_shared_phrases"))

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, value, found, phrases in zip(batch["own_id"], batch["squeezed"], batch["spans"], batch["n_shared_phrases"], strict=True):
                data = loosened(value)
                merged: list[list[int]] = []
                for lo, hi in sorted((s["lo"], s["hi"]) for s in found) if found is not None else ():
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                at, kept = 0, []
                for lo, hi in merged:
                    kept.append(data[at:lo])
                    at = hi
                rest = b"".join([*kept, data[at:]])
                rows.append((doc, len(data), len(data) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), phrases, rest))
            frame = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_phrases", "kept_text"])
            yield frame.astype({"doc_id": "Int64"})

    return joined.mapInPandas(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_phrases long, kept_text binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 400 bytes removed from all ``documents``, and how many phrases each shares with others."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES: dict[str, str] = {}
