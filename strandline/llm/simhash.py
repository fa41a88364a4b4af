"""SimHash near-duplicates: 64-bit fingerprints, bit-sliced comparison, connected components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import connected_components, cut, spread_join, table

BITS = 64
#: Members of a bucket that one task compares with each other; larger buckets are dealt out as pairs of chunks.
CHUNK = 4096
#: Shares into which the rows of one fingerprint are dealt when their component is looked up.
SHARES = 64


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of a text: bit i is set if it is set in over half of the XXH64 hashes (seed 42) of its shingles.

    Words are runs of non-white ASCII after A-Z are lower-cased; shingles are ``size`` words joined by a space,
    repeats included; fewer words make one shingle; none make fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = [digest(join(s), 42) for s in zip(*(words[i:] for i in range(size)), strict=False)]
    return majority(np.array(hashes, dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, counted 65,535 rows at a time."""
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 65_535):
        block = hashes[i : i + 65_535]
        counts += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    packed = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int.from_bytes(packed.tobytes(), "little")


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of uint64 values: plane b holds bit b of 64 values in each of its words."""
    pad = np.zeros(-len(values) % 64, dtype=np.uint64)
    bits = np.unpackbits(np.concatenate([values, pad]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(planes: np.ndarray, queries: np.ndarray, radius: int, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query rows, value columns) of pairs at most ``radius`` bits apart, for radius 0 to 3.

    Distances of 64 values grow together: each plane, flipped where the query's bit is set, is added to two
    carry-save counter words and a sticky overflow word. A block of 64 values is dropped for a query once all of
    them have overflowed the radius. ``known`` lists planes that are equal by construction and need no look.
    """
    todo = [b for b in range(BITS) if b not in set(known.tolist())]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    words = planes.shape[1]
    step = max(1, (1 << 20) // max(words, 1))
    for start in range(0, len(queries), step):
        block = queries[start : start + step]
        row = np.repeat(np.arange(start, start + len(block)), words)
        word = np.tile(np.arange(words), len(block))
        value = queries[row]
        ones = np.zeros(len(row), dtype=np.uint64)
        twos, over = ones.copy(), ones.copy()
        for n, b in enumerate(todo):
            diff = planes[b][word] ^ ((value >> np.uint64(b) & np.uint64(1)) * full)
            carry = ones & diff
            ones ^= diff
            over |= twos & carry
            twos ^= carry
            if n % 8 == 7:
                live = (_beyond(ones, twos, over, radius) != full).nonzero()[0]
                if len(live) < 0.75 * len(row):
                    row, word, value, ones, twos, over = (x[live] for x in (row, word, value, ones, twos, over))
                if not len(row):
                    break
        if len(row):
            near = ~_beyond(ones, twos, over, radius)
            hit = near.nonzero()[0]
            bits = np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, bit = bits.nonzero()
            yield row[hit[at]], word[hit[at]] * 64 + bit


def _beyond(ones: np.ndarray, twos: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """Bits of values whose distance is over the radius."""
    if radius == 0:
        return over | ones | twos
    if radius == 1:
        return over | twos
    return over | (ones & twos) if radius == 2 else over


def spanning_links(left: np.ndarray, right: np.ndarray, radius: int, known: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what pairs (left, right) within the radius join: at most one a value, not one a pair."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    values = right.tolist()
    queries = left.tolist()
    for rows, columns in within(planes_of(right), left, radius, known):
        real = columns < len(values)
        for i, j in zip(rows[real].tolist(), columns[real].tolist(), strict=True):
            a, b = queries[i], values[j]
            if a != b:
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in parent if root(x) != x]


def block_masks(radius: int, blocks: int) -> list[tuple[int, ...]]:
    """Choices of ``blocks - radius`` blocks; of any pair within the radius, at least one choice is equal."""
    return list(itertools.combinations(range(blocks), blocks - radius))


def link_fingerprints(prints: DataFrame, radius: int = 2, blocks: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``, long) whose graph joins all within the radius.

    The 64 bits form ``blocks`` blocks; every choice of blocks less the radius is a bucket key, so each near pair
    shares a bucket. A bucket's members are dealt into chunks by hash, and pairs of chunks are compared bit-sliced;
    a bucket of any size is so spread over tasks of at most ``2 * chunk`` values (in the mean). Each comparison
    returns a spanning forest.
    """
    edges = np.linspace(0, BITS, blocks + 1).astype(int)
    masks = block_masks(radius, blocks)
    bit_lists = [np.concatenate([np.arange(edges[k], edges[k + 1]) for k in choice]) for choice in masks]
    long_masks = [sum(1 << int(b) for b in bits) for bits in bit_lists]
    signed = [m - (1 << 64) if m >> 63 else m for m in long_masks]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    member = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    sizes = member.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = member.join(sizes, ["t", "key"])
    parts = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    # a member of chunk c meets chunks 0..c as the larger and c..parts-1 as the smaller
    dealt = (
        member.withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("fp", "t", "key", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )
    dealt = dealt.withColumn("bin", F.xxhash64("t", "key", "lo", "hi"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["bin", "t", "key", "lo", "hi"]):
            t, lo, hi = int(group["t"].iat[0]), group["lo"].iat[0], group["hi"].iat[0]
            values = group["fp"].to_numpy().astype(np.uint64)
            own_ = group["own"].to_numpy()
            left, right = (values, values) if lo == hi else (values[own_ == lo], values[own_ == hi])
            if len(values) > 1:
                found = spanning_links(left, right, radius, bit_lists[t])
                if found:
                    a, b = np.array(found, dtype=np.uint64).T
                    yield pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64)})

    ordered = dealt.repartition("bin").sortWithinPartitions("bin", "t", "key", "lo", "hi")
    return ordered.mapInPandas(compare, "a long, b long")


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole key groups of a sorted partition, whose batches may break groups anywhere."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(change)
        if rest and (rest[-1][keys].iloc[-1] == batch[keys].iloc[0]).all():
            starts = starts[1:]
        begin = 0
        for s in starts:
            if s > begin:
                rest.append(batch.iloc[begin:s])
            if rest:
                yield rest[0] if len(rest) == 1 else pd.concat(rest)
            rest, begin = [], s
        rest.append(batch.iloc[begin:])
    if rest:
        yield rest[0] if len(rest) == 1 else pd.concat(rest)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, size: int = 3) -> DataFrame:
    """``key, fingerprint, component_id`` of every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest key whose fingerprint can be
    reached by steps of at most ``radius`` differing bits, the own key included. Null and empty texts have
    fingerprint 0 and link like any other. Copies share one fingerprint and are compared once; repeated rows are
    kept. ``key`` may be of any type that has an order. An empty table gives an empty result; other columns are not read.
    """

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).astype(np.int64))

    rows = cut(docs.select(F.col(key).alias("k"), prints(text).alias("fp"), F.pmod(F.spark_partition_id(), F.lit(SHARES)).alias("share")))
    classes = cut(rows.groupBy("fp").agg(F.min("k").alias("first")))
    joined = connected_components(cut(link_fingerprints(classes.select("fp"), radius)))
    member = classes.join(joined.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    of_print = member.join(lowest, "component").select("fp", "component_id")
    return spread_join(rows, of_print, ["fp"]).select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op10_simhash": op10_simhash}
ORACLES: dict[str, str] = {}
