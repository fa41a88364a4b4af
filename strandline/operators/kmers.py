"""K-mer tables: counting, edges, screens, colors, features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import sequence as S
from strandline.operators.lineage import cut

#: Coverages stop here.
SATURATED = 65_535
#: Longest k-mer that fits into a long at two bits a base, windows that are looked at together, and most k-mers of a bait
#: that is broadcast (eight bytes each).
PACKED, STEP, BAIT = 31, 1 << 20, 4_000_000
#: Most rows of k-mers that a task holds to sum them up.
HELD = 5_000_000
#: Longest read whose k-mers are looked at together, and most keys that are broadcast.
LONG, FEW = 1 << 22, 100_000
#: Most k-mers that are broadcast with what is known of each.
TOLD = 500_000
#: Two bits of each base; 4 is what stands between sequences.
_CODE = np.full(256, 4, dtype=np.int8)
_CODE[[65, 67, 71, 84]] = range(4)


def _packed(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mers, their other strands, whether they lie in one sequence) of an array of base codes.

    Longer words are put together from two halves; numbers are in order of the texts.
    """
    base = np.where(code < 4, code, 0).astype(np.int64)
    ahead, behind, size = base, 3 - base, 1
    for bit in bin(k)[3:]:
        ahead, behind = ahead[:-size] << 2 * size | ahead[size:], behind[size:] << 2 * size | behind[:-size]
        size *= 2
        if bit == "1":
            ahead = ahead[:-1] << 2 | base[size:]
            behind = (3 - base[size:]) << 2 * size | behind[:-1]
            size += 1
    gaps = np.concatenate([[0], np.cumsum(code == 4)])
    return ahead, behind, gaps[k:] == gaps[:-k]


def _slices(seqs: list[str], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, base codes) of stretches of the joined sequences, each with a base before and k after its windows."""
    code = np.concatenate([[4], _CODE[np.frombuffer("-".join(seqs).encode(), np.uint8)], [4]]).astype(np.int8)
    for a in range(1, len(code) - k, STEP):
        yield a - 1, code[a - 1 : a + STEP + k]


def _stretches(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, place in its sequence, k-mer, other strand, base before, base after) of all windows, by stretches of sequences.

    Sequences hold bases only. Few of them are joined at once, and a long one takes several stretches, so memory is bounded.
    """
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    blocks = np.cumsum(sizes) // STEP
    for rows in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(blocks)) + 1):
        if not len(rows):
            continue
        starts = np.concatenate([[0], np.cumsum(sizes[rows] + 1)])
        for first, code in _slices([x or "" for x in texts.slice(rows[0], len(rows)).to_pylist()], k):
            ahead, behind, inside = _packed(code[1:-1], k)
            at = np.flatnonzero(inside)
            if len(at):
                row = np.searchsorted(starts, at + first, side="right") - 1
                yield rows[row], at + first - starts[row], ahead[at], behind[at], code[at].astype(np.int64), code[at + k + 1].astype(np.int64)


def _folded(tables: list[tuple[np.ndarray, ...]], folds: tuple[np.ufunc, ...]) -> tuple[np.ndarray, ...]:
    """One table of k-mers, in order, of several; the other columns of equal k-mers are folded."""
    kmer, *columns = (np.concatenate(c) for c in zip(*tables, strict=True))
    order = np.argsort(kmer, kind="stable")
    kmer = kmer[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(kmer), 1), bool), kmer[1:] != kmer[:-1]]))
    return kmer[first], *(f.reduceat(c[order], first) if len(first) else c for f, c in zip(folds, columns, strict=True))


def _held(tables: Iterator[tuple[tuple, tuple[np.ndarray, ...]]], folds: tuple[np.ufunc, ...]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(keys of each row, columns) of a task's tables of k-mers, folded by key before they leave it.

    A task holds at most HELD rows: beyond that they are folded, and if over half remain they are handed on.
    """
    held: dict[tuple, list] = {}
    size = 0

    def out() -> tuple[list, list[np.ndarray]]:
        names = [key for key, (table,) in held.items() for _ in range(len(table[0]))] if any(held) else [()] * sum(len(t[0][0]) for t in held.values())
        return names, [np.concatenate(c) for c in zip(*(t[0] for t in held.values()), strict=True)]

    for key, table in tables:
        held.setdefault(key, []).append(table)
        size += len(table[0])
        if size > HELD:
            held = {x: [_folded(t, folds)] for x, t in held.items()}
            size = sum(len(t[0][0]) for t in held.values())
            if size > HELD // 2:
                yield out()
                held, size = {}, 0
    held = {x: [_folded(t, folds)] for x, t in held.items()}
    if held:
        yield out()


def _count_tables(batches: Iterator[pa.RecordBatch], k: int, n_keys: int) -> Iterator[tuple[tuple, tuple[np.ndarray, ...]]]:
    """(key, its k-mers with how often they stand there, how often as written, and their edges) of stretches of reads."""
    for batch in batches:
        rows: dict[tuple, list[int]] = {}
        if n_keys:
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(n_keys)), strict=True)):
                rows.setdefault(key, []).append(i)
        texts = batch.column(n_keys)
        for key, own in rows.items() if n_keys else [((), None)]:
            for _, _, ahead, behind, before, after in _stretches(texts if own is None else texts.take(pa.array(own)), k):
                forward = ahead < behind
                # in-edges are the low four bits, out-edges the next; a side without a base has none
                left = np.where(before < 4, np.where(forward, 1 << before, 128 >> before), 0)
                right = np.where(after < 4, np.where(forward, 16 << after, 8 >> after), 0)
                kmer = np.where(forward, ahead, behind)
                yield key, _folded([(kmer, np.ones(len(kmer), np.int64), forward.astype(np.int64), (left | right).astype(np.uint8))], _COUNT)


#: How columns of equal k-mers go together: occurrences, those as written, edges.
_COUNT = (np.add, np.add, np.bitwise_or)


def _batch_counts(frame: pd.DataFrame, k: int, keys: list[str], seq: str) -> Iterator[pd.DataFrame]:
    """The tables of one batch of reads as frames."""
    for key, (kmer, n, fw, edges) in _count_tables(iter([pa.RecordBatch.from_pandas(frame[[*keys, seq]], preserve_index=False)]), k, len(keys)):
        yield pd.DataFrame({**dict(zip(keys, key, strict=True)), "kmer": kmer, "n": n, "fw": fw, "edges": edges.astype(np.int32)})


def unpacked(kmer: Column | str, k: int) -> Column:
    """Text of a packed k-mer."""
    return F.translate(F.lpad(F.conv(S.col(kmer).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def windows_of(seqs: DataFrame, k: int, keys: list[str], seq: str = "seq", piece: int = 64) -> DataFrame:
    """``keys, n, pos, kmer, rc, before, after``: every k-mer of every sequence, its place, other strand, and neighbours.

    ``n`` is the sequence's length. A substring costs its distance from the start of the text, so sequences are first cut
    into overlapping pieces, and k-mers of both strands out of these; rows carry pieces, not whole sequences.
    """
    n = F.length(seq)
    starts = F.when(n >= k, F.sequence(F.lit(0), n - k, F.lit(piece))).otherwise(F.array().cast("array<int>"))
    rows = seqs.select(*keys, F.col(seq).alias("_s"), n.alias("n"), F.explode(starts).alias("_a"))
    lead = F.when(F.col("_a") > 0, 1).otherwise(0)
    rows = rows.select(*keys, "n", "_a", lead.alias("_o"), F.substring("_s", F.col("_a") + 1 - lead, F.lit(piece + k) + lead).alias("_p")).withColumn("_r", S.reverse_complement("_p"))
    rows = rows.select(*keys, "n", "_a", "_o", "_p", "_r", F.explode(F.sequence(F.lit(0), F.least(F.lit(piece - 1), F.col("n") - k - F.col("_a")))).alias("_j"))
    at = F.col("_o") + F.col("_j")
    return rows.select(
        *keys, "n", (F.col("_a") + F.col("_j")).alias("pos"), F.substring("_p", at + 1, F.lit(k)).alias("kmer"), F.substring("_r", F.length("_r") - at - k + 1, F.lit(k)).alias("rc"),
        F.when(at > 0, F.substring("_p", at, F.lit(1))).otherwise("").alias("before"), F.substring("_p", at + k + 1, F.lit(1)).alias("after"),
    )


def occurrences(reads: DataFrame, k: int, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row per k-mer of each valid read: ``keys, pos, kmer, cn_kmer, is_fw, before, after``.

    Reads with any letter that is not a base, or not longer than ``k``, give none.
    """
    rows = windows_of(reads.where(S.valid_for_graph(seq, k)), k, keys, seq)
    return rows.select(*keys, "pos", "kmer", F.least("kmer", "rc").alias("cn_kmer"), (F.col("kmer") < F.col("rc")).alias("is_fw"), "before", "after")


def met(reads: DataFrame, words: DataFrame, k: int, by: list[str], seq: str = "seq") -> DataFrame:
    """``by, pos`` and all columns of ``words`` (``kmer``, as written and each once): where these stand in valid reads.

    At most TOLD words of PACKED bases or fewer are broadcast with their columns and met where the reads lie, so only places
    found leave a task; more or longer ones are joined.
    """
    known = words.limit(TOLD + 1).toArrow() if k <= PACKED else None
    if known is None or known.num_rows > TOLD:
        return occurrences(reads, k, by, seq).select(*by, "pos", "kmer").join(words, "kmer").select(*by, "pos", *words.columns)
    texts = known["kmer"].combine_chunks()
    numbers = np.concatenate([np.zeros(0, np.int64), *(ahead for _, _, ahead, *_ in _stretches(texts, k))])
    order = np.argsort(numbers)
    held = reads.sparkSession.sparkContext.broadcast((numbers[order], known.take(pa.array(order)).combine_chunks()))
    good, names = reads.where(S.valid_for_graph(seq, k)).select(*by, seq), [*by, "pos", *words.columns]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, told = held.value
        for batch in batches:
            for row, pos, ahead, *_ in _stretches(batch.column(len(by)), k) if len(wanted) else ():
                spot = np.minimum(np.searchsorted(wanted, ahead), len(wanted) - 1)
                hit = np.flatnonzero(wanted[spot] == ahead)
                own, theirs = pa.array(row[hit]), told.take(pa.array(spot[hit]))
                columns = [*(batch.column(c).take(own) for c in range(len(by))), pa.array(pos[hit].astype(np.int32)), *(c.combine_chunks() for c in theirs.columns)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return good.mapInArrow(find, T.StructType([*(good.schema[c] for c in by), T.StructField("pos", T.IntegerType()), *words.schema]))


def count_kmers(reads: DataFrame, k: int, keys: tuple[str, ...] = (), seq: str = "seq", score: bool = False) -> DataFrame:
    """The k-mer table ``keys, cn_kmer, cov, cov_fw, cov_rc, edges`` of reads; coverages stop at SATURATED.

    Up to PACKED bases, k-mers are numbers: each task packs and counts those of all its reads (see _held), so what is shuffled
    is one row of numbers for each k-mer of a task, and texts are made of the sums. Longer ones stay texts.
    """
    top = lambda c: F.least(c, F.lit(SATURATED)).cast("int")
    if k <= PACKED:
        good = reads.where(S.valid_for_graph(seq, k)).select(*keys, seq)
        more = [T.StructField("kmer", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fw", T.LongType()), T.StructField("edges", T.IntegerType())]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds: list[pa.DataType] = []

            def noted() -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    kinds[:] = batch.schema.types[: len(keys)]
                    yield batch

            for names, (kmer, n, fw, edges) in _held(_count_tables(noted(), k, len(keys)), _COUNT):
                for a in range(0, len(kmer), STEP):
                    part = slice(a, a + STEP)
                    own = [pa.array(c, t) for c, t in zip(zip(*names[part], strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (kmer[part], n[part], fw[part], edges[part].astype(np.int32)))], [*keys, *(f.name for f in more)])

        rows = good.mapInArrow(count, T.StructType([*(good.schema[c] for c in keys), *more]))
        sums = rows.groupBy(*keys, "kmer").agg(F.sum("n").alias("n"), F.sum("fw").alias("fw"), F.bit_or("edges").cast("int").alias("edges"))
        out = sums.select(*keys, unpacked("kmer", k).alias("cn_kmer"), top(F.col("n")).alias("cov"), top(F.col("fw")).alias("cov_fw"), top(F.col("n") - F.col("fw")).alias("cov_rc"), "edges")
    else:
        rows = occurrences(reads, k, list(keys), seq)
        bits = S.edge_bits(F.col("before"), F.col("after"), F.col("is_fw"))
        forward = F.count_if("is_fw")
        out = rows.groupBy(*keys, "cn_kmer").agg(
            top(F.count(F.lit(1))).alias("cov"), top(forward).alias("cov_fw"), top(F.count(F.lit(1)) - forward).alias("cov_rc"), F.bit_or(bits).cast("int").alias("edges")
        )
    return out.withColumn("score", F.lit(1.0)) if score else out


def infer_edges(kmers: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``kmers`` with ``edges`` recomputed: an edge is there if the neighbour is a k-mer of the table."""
    k = F.col("cn_kmer")
    tail, head = F.substring(k, F.lit(2), F.length(k)), F.substring(k, F.lit(1), F.length(k) - 1)
    steps = [F.struct(F.lit(S.OUT_BITS[b]).alias("bit"), S.canonical(F.concat(tail, F.lit(b))).alias("near")) for b in S.BASES]
    steps += [F.struct(F.lit(S.IN_BITS[b]).alias("bit"), S.canonical(F.concat(F.lit(b), head)).alias("near")) for b in S.BASES]
    wanted = kmers.select(*keys, "cn_kmer", F.explode(F.array(*steps)).alias("e")).select(*keys, "cn_kmer", "e.bit", F.col("e.near").alias("near"))
    present = kmers.select(*keys, F.col("cn_kmer").alias("near"))
    found = wanted.join(present, [*keys, "near"], "left_semi").groupBy(*keys, "cn_kmer").agg(F.bit_or("bit").cast("int").alias("edges"))
    return kmers.drop("edges").join(found, [*keys, "cn_kmer"], "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def repeated_within(reads: DataFrame, k: int, key: str, seq: str = "seq") -> DataFrame:
    """``key, cn_kmer, n`` of k-mers that occur more than once in one read."""
    return occurrences(reads, k, [key], seq).groupBy(key, "cn_kmer").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def noise_kmers(reads: DataFrame, k: int, key: str, seq: str = "seq") -> DataFrame:
    """``cn_kmer``: distinct k-mers that any read has more than once.

    Reads of at most LONG bases that alone have their key are looked at where they lie, and a task hands on each k-mer once;
    rows that share a key are one read, so they are counted by repeated_within, as are longer ones and longer k-mers.
    """
    if 2 * k + 21 > 62:
        return repeated_within(reads, k, key, seq).select("cn_kmer").distinct()
    alone, shared = single_rows(reads, key)
    fits = F.length(seq) <= LONG

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables() -> Iterator[tuple[tuple, tuple[np.ndarray, ...]]]:
            for batch in batches:
                for row, _, ahead, behind, _, _ in _whole_reads(batch.column(0), k):
                    both = np.sort((row - row[0]) << 2 * k | np.minimum(ahead, behind))
                    yield (), _folded([(both[1:][both[1:] == both[:-1]] & ((1 << 2 * k) - 1),)], ())

        for _, (kmer,) in _held(tables(), ()):
            yield from (pa.RecordBatch.from_arrays([pa.array(kmer[a : a + STEP])], ["kmer"]) for a in range(0, len(kmer), STEP))

    near = alone.where(fits & S.valid_for_graph(seq, k)).select(seq).mapInArrow(find, "kmer long").distinct().select(unpacked("kmer", k).alias("cn_kmer"))
    far = shared.unionByName(alone.where(~fits))
    return near.union(repeated_within(far, k, key, seq).select("cn_kmer")).distinct()


def _whole_reads(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """What _stretches gives, with all windows of a read in one stretch."""
    kept: list[tuple[np.ndarray, ...]] = []
    for part in _stretches(texts, k):
        if kept and kept[-1][0][-1] != part[0][0]:
            yield tuple(np.concatenate(c) for c in zip(*kept, strict=True))
            kept = []
        kept.append(part)
    if kept:
        yield tuple(np.concatenate(c) for c in zip(*kept, strict=True))


def single_rows(reads: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(reads whose key no other row has, all others): few keys that several rows have are broadcast, more are joined."""
    many = reads.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | F.col("_k").isNull()).select("_k")
    if many.limit(FEW + 1).count() <= FEW:
        many = F.broadcast(many)
    same = F.col(key).eqNullSafe(F.col("_k"))
    return reads.join(many, same, "left_anti"), reads.join(many, same, "left_semi")


def without(kmers: DataFrame, noise: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """K-mers that are not noise."""
    return kmers.join(noise, [*keys, "cn_kmer"], "left_anti")


def unique_kmers(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """``kmer`` that occur exactly once, as written, in all sequences together."""
    return windows_of(seqs, k, [], seq).groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("kmer")


def compressed_kmers(seqs: DataFrame, k: int, keys: tuple[str, ...] = (), seq: str = "seq") -> DataFrame:
    """``keys, length, cn_kmer``: canonical k-mers of the homopolymer-compressed sequences, one row an occurrence."""
    short = seqs.select(*keys, S.homopolymer_compressed(seq).alias("hp"))
    return windows_of(short, k, list(keys), "hp").select(*keys, F.col("n").alias("length"), F.least("kmer", "rc").alias("cn_kmer"))


def _batch_hits(frame: pd.DataFrame, k: int, key: str, bait: np.ndarray) -> Iterator[pd.DataFrame]:
    """Places in each sequence (``hp``) that hold a k-mer of a sorted bait; a sequence may come in several rows."""
    size = frame["hp"].str.len().to_numpy()
    ends = np.cumsum(size + 1)
    for start, code in _slices(frame["hp"].tolist(), k):
        ahead, behind, inside = _packed(code[1:-1], k)
        at = np.flatnonzero(inside)
        kmer = np.minimum(ahead[at], behind[at])
        spot = np.searchsorted(bait, kmer)
        hit = at[bait[np.minimum(spot, len(bait) - 1)] == kmer] + start
        row, n = np.unique(np.searchsorted(ends, hit, side="right"), return_counts=True)
        yield pd.DataFrame({key: frame[key].to_numpy()[row], "hits": n, "length": size[row]})


def screen(reads: DataFrame, bait: DataFrame, k: int, percent: float, key: str, seq: str = "seq", keep: Column | None = None) -> DataFrame:
    """``key, hits, length`` of reads whose bait k-mers, over the compressed read's length, exceed ``percent``.

    Occurrences count. The bait is a set; one of at most BAIT k-mers of PACKED bases or fewer is broadcast as numbers and
    met where the reads lie, another one is joined. ``keep`` is a further predicate on ``hits``, ``length`` and the columns
    of ``reads``. A read of length 0 has no k-mers and is out.
    """
    wanted = compressed_kmers(bait, k, (), "seq").select("cn_kmer").distinct()
    kind = dict(reads.dtypes)[key]
    known: list | None = None
    if k <= PACKED:
        plain = wanted.where(~F.col("cn_kmer").rlike("[^ACGT]"))
        # one row more than may be broadcast tells that it may not
        known = plain.select(F.conv(F.translate("cn_kmer", "ACGT", "0123"), 4, 10).cast("long").alias("n")).limit(BAIT + 1).toPandas()["n"].to_numpy(np.int64)
    if known is None or len(known) > BAIT:
        odd, hits = reads, None
    else:
        odd = reads.where(F.col(seq).rlike("[^ACGT]"))
        short = reads.where(~F.col(seq).rlike("[^ACGT]")).select(key, S.homopolymer_compressed(seq).alias("hp")).where(F.length("hp") >= k)
        sorted_ = reads.sparkSession.sparkContext.broadcast(np.sort(known))
        find = lambda batches: (part for b in batches if len(b) and len(sorted_.value) for part in _batch_hits(b, k, key, sorted_.value))
        hits = short.mapInPandas(find, f"`{key}` {kind}, hits long, length int")
    rest = compressed_kmers(odd, k, (key,), seq).join(wanted, "cn_kmer", "left_semi").select(key, F.lit(1).cast("long").alias("hits"), "length")
    hits = rest if hits is None else hits.union(rest)
    sums = hits.groupBy(key).agg(F.sum("hits").alias("hits"), F.max("length").alias("length"))
    out = sums.where(F.col("hits") / F.col("length") > percent / 100.0)
    return out if keep is None else out.join(reads.drop("hits", "length"), key).where(keep).select(key, "hits", "length")


def recruit_distinct(short: DataFrame, long_: DataFrame, k: int, key: str, window: tuple[str, ...] = (), seq: str = "seq", whole: bool = False) -> DataFrame:
    """``window, key, shared, total``: short reads of which over half of the distinct k-mers are in a window's long reads.

    With ``whole``, found reads have their ``seq`` too, handed on from where they lie rather than joined again.

    Where the windows' k-mers number at most BAIT in all, they are broadcast as numbers, and reads that alone have their
    key are compared with them where they lie; what leaves a task is a row for each read and window found.
    """
    theirs = count_kmers(long_, k, tuple(window), seq).select(*window, "cn_kmer")
    pairs = names = None
    if 2 * k + 21 <= 62:
        theirs = cut(theirs)
        if theirs.limit(BAIT + 1).count() <= BAIT:
            names = theirs.select(*window).distinct() if window else theirs.limit(1).select()
            names = cut(names.repartition(1).withColumn("_w", F.monotonically_increasing_id()))
            same = F.lit(True)
            for c in window:
                same = same & theirs[c].eqNullSafe(names[c])
            pairs = theirs.join(names, same).select("_w", F.conv(F.translate("cn_kmer", "ACGT", "0123"), 4, 10).cast("long").alias("n")).toPandas()
    if pairs is None:
        return _recruited(short, theirs, k, key, window, seq, whole)
    alone, shared = single_rows(short, key)
    fits = F.length(seq) <= LONG
    kmers, spot = np.unique(pairs["n"].to_numpy(np.int64), return_inverse=True)
    order = np.argsort(spot, kind="stable")
    first = np.searchsorted(spot[order], np.arange(len(kmers) + 1))
    held = short.sparkSession.sparkContext.broadcast((kmers, first, pairs["_w"].to_numpy(np.int64)[order]))
    given = ["_w", key, "shared", "total", *([seq] if whole else [])]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kmers, first, windows = held.value
        n_windows = int(windows.max(initial=0)) + 1
        for batch in batches:
            for row, _, ahead, behind, _, _ in _whole_reads(batch.column(1), k) if len(kmers) else ():
                both = np.unique((row - row[0]) << 2 * k | np.minimum(ahead, behind))
                own, kmer = both >> 2 * k, both & ((1 << 2 * k) - 1)
                total = np.bincount(own)
                at = np.minimum(np.searchsorted(kmers, kmer), len(kmers) - 1)
                own, at = own[kmers[at] == kmer], at[kmers[at] == kmer]
                # reads by windows, so many reads and so many of their k-mers' windows at once that memory is bounded
                many, size = first[at + 1] - first[at], max(4 * STEP // n_windows, 1)
                for low in range(0, len(total), size):
                    block = np.arange(*np.searchsorted(own, [low, low + size]))
                    sums = np.zeros((min(size, len(total) - low), n_windows), np.int64)
                    for part in np.split(block, np.flatnonzero(np.diff(np.cumsum(many[block]) // STEP)) + 1):
                        n = many[part]
                        which = windows[np.repeat(first[at[part]] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())]
                        sums += np.bincount(np.repeat(own[part] - low, n) * n_windows + which, minlength=sums.size).reshape(sums.shape)
                    r, w = np.nonzero(sums > total[low : low + size, None] // 2)
                    rows = pa.array(r + low + row[0])
                    columns = [pa.array(w.astype(np.int64)), batch.column(0).take(rows), pa.array(sums[r, w]), pa.array(total[r + low].astype(np.int64)), batch.column(1).take(rows)]
                    yield pa.RecordBatch.from_arrays(columns[: len(given)], given)

    near = alone.where(fits & S.valid_for_graph(seq, k)).select(key, seq)
    shape = T.StructType([T.StructField("_w", T.LongType()), near.schema[key], T.StructField("shared", T.LongType()), T.StructField("total", T.LongType()), *([near.schema[seq]] if whole else [])])
    found = near.mapInArrow(find, shape).join(F.broadcast(names), "_w").select(*window, *given[1:])
    return found.union(_recruited(shared.unionByName(alone.where(~fits)), theirs, k, key, window, seq, whole))


def _recruited(short: DataFrame, theirs: DataFrame, k: int, key: str, window: tuple[str, ...], seq: str, whole: bool = False) -> DataFrame:
    """recruit_distinct by joins, for the distinct k-mers ``window, cn_kmer``."""
    mine = occurrences(short, k, [key], seq).select(key, "cn_kmer").distinct()
    total = mine.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    shared = mine.join(theirs, "cn_kmer").groupBy(*window, key).agg(F.count(F.lit(1)).alias("shared"))
    found = shared.join(total, key).where(F.col("shared") > F.floor(F.col("total") * 0.5)).select(*window, key, "shared", "total")
    return found.join(short.select(key, seq), key).select(*found.columns, seq) if whole else found


def collapse_colors(kmers: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per k-mer over all colors: coverage sums (long), edges joined, ``sources`` sorted."""
    return kmers.groupBy(*keys, "cn_kmer").agg(
        F.sum(F.col("cov").cast("long")).alias("cov"),
        F.sum(F.col("cov_fw").cast("long")).alias("cov_fw"),
        F.sum(F.col("cov_rc").cast("long")).alias("cov_rc"),
        F.bit_or("edges").alias("edges"),
        F.array_sort(F.collect_set("color")).alias("sources"),
    )


def color_table(kmers: DataFrame, colors: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, cn_kmer`` and, for each color, its total and forward coverage; 0 where the color lacks the k-mer."""
    aggs = []
    for c in colors:
        aggs += [F.sum(F.when(F.col("color") == c, F.col("cov")).otherwise(0)).alias(f"{c}_cov"), F.sum(F.when(F.col("color") == c, F.col("cov_fw")).otherwise(0)).alias(f"{c}_fw")]
    return kmers.groupBy(*keys, "cn_kmer").agg(*aggs)


def features(table: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The six features of a color table with long, short and truth, and ``label``: whether the truth has the k-mer."""
    fw, cov = F.col("short_fw"), F.col("short_cov")
    k = F.col("cn_kmer")
    return table.select(
        *keys,
        "cn_kmer",
        (F.col("long_cov") > 0).cast("double").alias("in_long"),
        cov.cast("double").alias("short_cov"),
        F.when(cov > 0, fw / cov).otherwise(0.5).alias("strand_ratio"),
        (F.length(k) - F.length(S.homopolymer_compressed(k))).cast("double").alias("hp_loss"),
        S.shannon_entropy(k).alias("entropy"),
        S.gc_content(k).alias("gc"),
        (F.col("truth_cov") > 0).cast("double").alias("label"),
    )


def union_bag(tables: list[DataFrame]) -> DataFrame:
    """All keys of several k-mer tables; a k-mer in several tables counts as often."""
    out = tables[0].select("cn_kmer")
    for t in tables[1:]:
        out = out.union(t.select("cn_kmer"))
    return out


def union_set(tables: list[DataFrame]) -> DataFrame:
    """Distinct keys of several k-mer tables."""
    return union_bag(tables).distinct()


def end_distance(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """``cn_kmer, distance``: the least distance of a k-mer to an end of a sequence that has it."""
    odd = F.lit(True) if k > PACKED else F.col(seq).rlike("[^ACGT]")
    rows = windows_of(seqs.where(odd), k, [], seq)
    near = F.least(F.col("pos"), F.col("n") - F.col("pos") - k)
    found = rows.select(F.least("kmer", "rc").alias("cn_kmer"), near.alias("distance"))
    if k <= PACKED:
        # sequences of bases alone: each task hands on the least distance of each of its k-mers

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def tables() -> Iterator[tuple[tuple, tuple[np.ndarray, ...]]]:
                for batch in batches:
                    size = np.asarray(pc.binary_length(batch.column(0)), dtype=np.int64)
                    for row, pos, ahead, behind, _, _ in _stretches(batch.column(0), k):
                        yield (), _folded([(np.minimum(ahead, behind), np.minimum(pos, size[row] - pos - k))], (np.minimum,))

            for _, (kmer, least) in _held(tables(), (np.minimum,)):
                yield from (pa.RecordBatch.from_arrays([pa.array(kmer[a : a + STEP]), pa.array(least[a : a + STEP].astype(np.int32))], ["kmer", "distance"]) for a in range(0, len(kmer), STEP))

        sums = seqs.where(~odd & (F.length(seq) >= k)).select(seq).mapInArrow(find, "kmer long, distance int").groupBy("kmer").agg(F.min("distance").alias("distance"))
        found = found.union(sums.select(unpacked("kmer", k), "distance"))
    return found.groupBy("cn_kmer").agg(F.min("distance").alias("distance"))


def shared_in_pairs(kmers: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """``a, b, shared`` for given pairs of reads: the number of distinct k-mers in both."""
    d = kmers.select(key, "cn_kmer").distinct()
    left = pairs.join(d.withColumnRenamed(key, "a"), "a")
    both = left.join(d.withColumnRenamed(key, "b"), ["b", "cn_kmer"], "left_semi")
    counts = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.join(counts, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def dust_spans(seq: str, window: int = 64, limit: float = 2.0) -> list[tuple[int, int]]:
    """(start, stop) of the perfect low-complexity stretches of a sequence (symmetric DUST; Morgulis et al., 2006).

    A stretch of l triplets scores the sum of c(c-1)/2 over its triplets' counts c, over l - 1. It is perfect if that is
    over ``limit`` and no stretch inside scores more; stretches have at most ``window`` bases. All starts are looked at
    together, length by length: a longer stretch adds how often its last triplet stood before.
    """
    code = _CODE[np.frombuffer(seq.encode(), np.uint8)].astype(np.int64)
    n = len(code) - 2
    if n < 2:
        return []
    triplet = code[:-2] * 25 + code[1:-1] * 5 + code[2:]
    sums = np.zeros(n)
    before = np.zeros(n)
    best = np.zeros(n)
    out = []
    for size in range(2, min(window - 2, n) + 1):
        d = size - 1
        # how often the triplet at a place stands among the d before it
        before[d:] += triplet[d:] == triplet[:-d]
        m = n - size + 1
        sums[:m] += before[d:]
        score = sums[:m] / d
        inside = np.maximum(best[:m], best[1 : m + 1])
        good = np.flatnonzero((score > limit) & (score >= inside))
        out += [(int(i), int(i) + size + 2) for i in good]
        best[:m] = np.maximum(score, inside)
    return out


def low_complexity(seqs: DataFrame, key: str, window: int = 64, limit: float = 2.0, seq: str = "seq", piece: int = 1 << 16) -> DataFrame:
    """``key, start, stop``: merged low-complexity stretches (see dust_spans) of each sequence.

    Sequences are searched in pieces that overlap by a window, so one of any length spreads over tasks.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.length(seq) - 1, F.lit(0)), F.lit(piece))
    rows = seqs.where(F.length(seq) > 0).select(key, F.col(seq).alias("_s"), F.explode(starts).alias("_a"))
    pieces = rows.select(key, "_a", F.upper(F.substring("_s", F.col("_a") + 1, F.lit(piece + window))).alias("_p"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, a + x, a + y) for k, a, p in zip(batch[key], batch["_a"], batch["_p"], strict=True) for x, y in dust_spans(p, window, limit)]
            yield pd.DataFrame(found, columns=[key, "start", "stop"])

    hot = pieces.mapInPandas(find, f"`{key}` {dict(seqs.dtypes)[key]}, start int, stop int").distinct()
    w = Window.partitionBy(key).orderBy("start", "stop")
    marked = hot.withColumn("far", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    grouped = marked.withColumn("island", F.sum(F.when(F.col("far") >= F.col("start"), 0).otherwise(1)).over(w))
    return grouped.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def links(reads: DataFrame, kmers: DataFrame, k: int, key: str, seq: str = "seq") -> DataFrame:
    """``anchor_kmer, is_forward, junctions, n``: junction choices that reads make ahead of each anchor.

    Both strands of each read are walked. Where a k-mer's side ahead has several edges, the base that follows is a
    junction choice. A k-mer at index 1 or later with several edges behind it makes the last such k-mer before it,
    stepping one back, the anchor of all choices from there on.
    """
    ok = reads.where(S.valid_for_graph(seq, k))
    both = ok.select(key, F.explode(F.array(F.struct(F.lit(True).alias("fw"), F.col(seq).alias("s")), F.struct(F.lit(False).alias("fw"), S.reverse_complement(seq).alias("s")))).alias("x")).select(key, "x.fw", "x.s")
    rows = windows_of(both, k, [key, "fw"], "s").select(key, "fw", F.col("pos").alias("i"), "kmer", F.col("after").alias("next"))
    rows = rows.withColumn("cn_kmer", S.canonical("kmer")).join(kmers.select("cn_kmer", "edges"), "cn_kmer")
    straight = F.col("kmer") == F.col("cn_kmer")
    ahead = F.when(straight, S.out_degree("edges")).otherwise(S.in_degree("edges"))
    behind = F.when(straight, S.in_degree("edges")).otherwise(S.out_degree("edges"))
    flagged = rows.select(key, "fw", "i", "kmer", "next", (ahead > 1).alias("chooses"), (behind > 1).alias("joins"))
    w = Window.partitionBy(key, "fw").orderBy("i")
    flagged = flagged.withColumn("back", F.lag("kmer").over(w))
    anchors = flagged.where("joins and i > 0").select(key, "fw", (F.col("i") - 1).alias("from"), F.col("back").alias("anchor"))
    choices = flagged.where("chooses and next <> ''").select(key, "fw", "i", "next")
    # each read's choices from an anchor on: an ordered string of them all, cut at the anchor
    per_read = choices.groupBy(key, "fw").agg(F.array_sort(F.collect_list(F.struct("i", "next"))).alias("all"))
    tail = F.filter("all", lambda x: x["i"] >= F.col("from"))
    found = anchors.join(per_read, [key, "fw"]).withColumn("junctions", F.array_join(F.transform(tail, lambda x: x["next"]), "")).where("junctions <> ''")
    oriented = found.select(S.canonical("anchor").alias("anchor_kmer"), (F.col("anchor") == S.canonical("anchor")).alias("is_forward"), "junctions")
    return oriented.groupBy("anchor_kmer", "is_forward", "junctions").agg(F.count(F.lit(1)).alias("n"))
