"""Token packing: best-fit decreasing per partition, certified by dual-feasible bounds, repacked where there are gaps."""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import cut, table

CAPACITY = 4096
#: Pieces that one task packs (in the mean), and bytes of words and ids that a tokenizer cache generation holds.
GROUP, CACHE = 50_000, 48_000_000
#: The id that ends a document.
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Marks that the tokenizer never joins with a letter before them.
MARKS = b".,;:!?*#$%&()[]{}<>=+-_/@~^|"


def tokenizer_file(name: str = VOCABULARY) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _ends_in_letter(word: bytes) -> bool:
    """Whether a word still ends in a letter once it is normalised as the tokenizer does it.

    Some letters turn into a letter and a combining mark, which the tokenizer joins to the marks that follow.
    """
    last = word[-1:]
    if last < b"\x80":
        return last.isalpha()
    return unicodedata.normalize("NFC", word.decode("utf-8", "replace")).lower()[-1].isalpha()


class CachedTokenizer:
    """Ids of texts as little-endian uint32 bytes.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its chunks
    between ASCII white space. Nor does it join letters and marks: a chunk of a word that ends in a letter and marks after
    it has the ids of both. Chunks, words and marks are remembered in two generations of bounded size.
    """

    def __init__(self, path: str, limit: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.limit, self.held = limit, 0

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text; null is empty."""
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            # the tokenizer lower-cases, but knows its special tokens only as they are written
            chunks = (raw if b"<|" in raw else raw.lower()).split()
            young = self.young
            new = {c for c in chunks if c not in young}
            if new:
                self._learn(new)
            yield b"".join(map(young.__getitem__, chunks))
            if self.held > self.limit:
                self.young, self.old, self.held = {}, young, 0

    def _learn(self, chunks: set[bytes]) -> None:
        """Enter chunks that the young generation lacks."""
        young, old = self.young, self.old
        pairs, missing = [], set()
        for chunk in chunks:
            if (known := old.get(chunk)) is not None:
                young[chunk] = known
                continue
            word = chunk.rstrip(MARKS)
            if word and len(word) < len(chunk) and b"<|" not in chunk and _ends_in_letter(word):
                pairs.append((chunk, word, marks := chunk[len(word) :]))
                for part in (word, marks):
                    if part not in young:
                        if (known := old.get(part)) is not None:
                            young[part] = known
                        else:
                            missing.add(part)
            else:
                missing.add(chunk)
        if missing:
            missing = list(missing)
            found = self.encode([c.decode("utf-8", "replace") for c in missing], add_special_tokens=False)
            young.update((c, np.array(e.ids, dtype="<u4").tobytes()) for c, e in zip(missing, found, strict=True))
        young.update((chunk, young[word] + young[marks]) for chunk, word, marks in pairs)
        self.held += sum(len(c) + len(young[c]) for c in chunks)


def bounds(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Sums of dual-feasible functions of the sizes, in bins; each is a lower bound on the bins needed.

    The functions are the identity, the step functions u_k for k = 1..20, and the cut-offs that count sizes over
    ``capacity - e`` as whole bins and drop those under ``e``. Sums over parts add up to those of the whole.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    out = [sizes.sum() / capacity]
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        out.append(np.where(scaled % capacity == 0, sizes / capacity, (scaled // capacity) / k).sum())
    for e in np.unique(np.linspace(1, capacity // 2, 24).astype(int)):
        out.append(np.where(sizes > capacity - e, 1.0, np.where(sizes < e, 0.0, sizes / capacity)).sum())
    return np.array(out)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each size in the given order, and the free space of each bin.

    The open bin with the least sufficient space is the lowest set bit of a mask of free spaces.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free: list[int] = []
    bins, offsets, mask = [], [], 0
    for size in sizes:
        fitting = mask >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[space].pop()
            if not open_bins[space]:
                mask ^= 1 << space
        else:
            space, b = capacity, len(free)
            free.append(capacity)
        bins.append(b)
        offsets.append(capacity - space)
        free[b] = rest = space - size
        if rest:
            open_bins[rest].append(b)
            mask |= 1 << rest
    return bins, offsets, free


@functools.lru_cache(maxsize=2)
def tokenizer_of(path: str) -> CachedTokenizer:
    """The tokenizer of this Python worker, kept with its cache from task to task."""
    return CachedTokenizer(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document (see PIECES): its ids, then END, cut after every ``capacity`` ids."""
    path = vocabulary or tokenizer_file()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = tokenizer_of(path)
        end, step = END.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            rows = []
            for doc, ids in zip(batch[key].tolist(), tokens.ids(batch[text].tolist()), strict=True):
                ids += end
                rows += [(doc, n, a // 4, len(part := ids[a : a + step]) // 4, zlib.crc32(part)) for n, a in enumerate(range(0, len(ids), step))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text).mapInPandas(pieces, PIECES)


NAMES = [c.split()[0] for c in PIECES.split(", ")]


def released(free: np.ndarray, excess: int, capacity: int) -> np.ndarray:
    """Which bins of a partition go into the exchange, from their free space and how many bins exceed the bound.

    The emptiest ones, until their free space adds up to ``excess`` bins and one more: fewer could not save as many.
    """
    order = np.argsort(-free, kind="stable")
    room = np.cumsum(free[order])
    out = np.zeros(len(free), dtype=bool)
    out[order[: int(np.searchsorted(room, (excess + 1) * capacity)) + 1]] = True
    return out & (free > 0)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = 12) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless sequences of at most ``capacity`` tokens.

    Pieces are dealt by hash to partitions of about ``group`` pieces, each packed best-fit decreasing. Dual-feasible
    sums of a partition's own sizes bound the bins that it needs: one that meets its bound is certified and settles all
    bins but its emptiest; one with a gap settles its fuller bins. What is not settled is exchanged, that is dealt
    anew over as many partitions as its number asks for, and packed again. This ends when all bins together
    meet the bound of all pieces, when one partition held the exchange, or when a round saves nothing; a round that
    would cost bins is undone. A certified partition wastes less than one bin against its unrounded bound, so at the
    usual ``group`` the whole is within about a ten-thousandth of the bound. An empty table gives an empty result.
    """
    packed_type = f"{PIECES}, salt long, part long, bin long, offset long, open boolean, bins long"
    pool = cut(pieces.withColumn("salt", F.xxhash64("doc_id", "piece", "ids_crc32")))
    count = pool.count()
    total_bound = _bound_of(pool, capacity)
    done: DataFrame | None = None
    settled, before, earlier = 0, None, None

    for turn in range(rounds):
        parts = max(1, -(-count // group))

        def fit(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
            sizes = frame["length"].to_numpy()
            bins, offsets, free = best_fit(sizes.tolist(), capacity)
            least = int(np.ceil(bounds(sizes, capacity).max() - 1e-6))
            loose = released(np.array(free), len(free) - least, capacity)
            return frame.assign(bin=bins, offset=offsets, open=loose[bins], bins=len(free))

        dealt = pool.withColumn("part", F.pmod(F.xxhash64("salt", F.lit(turn)), F.lit(parts)))
        packed = cut(dealt.groupBy("part").applyInPandas(fit, packed_type))
        packed = packed.withColumn("sequence_id", (F.col("part") * F.lit(rounds) + F.lit(turn)) * F.lit(1 << 32) + F.col("bin"))
        used = packed.groupBy("part").agg(F.first("bins").alias("bins")).agg(F.sum("bins")).first()[0] or 0
        if before is not None and used > before:
            packed, used = earlier, before
        last = settled + used <= total_bound or parts == 1 or (before is not None and used >= before) or turn == rounds - 1
        keep = (packed if last else packed.where("not open")).select(*NAMES, "sequence_id", "offset")
        done = keep if done is None else done.union(keep)
        if last:
            break
        earlier = packed.where("open")
        pool = cut(earlier.select(*NAMES, "salt"))
        count = pool.count()
        before = earlier.select("part", "bin").distinct().count()
        settled += used - before
    return done


def _bound_of(pieces: DataFrame, capacity: int) -> int:
    """The best lower bound on the bins of all pieces, from sums per length."""
    sums = pieces.groupBy("length").count().mapInPandas(
        lambda batches: (pd.DataFrame([bounds(np.array([n]), capacity) * c for n, c in zip(b["length"], b["count"], strict=True)]) for b in batches if len(b)),
        ", ".join(f"f{i} double" for i in range(len(bounds(np.zeros(0), capacity)))),
    )
    row = sums.agg(*[F.sum(c) for c in sums.columns]).first()
    return max((int(np.ceil(x - 1e-6)) for x in row if x is not None), default=0)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """All ``docs`` (``doc_id, text``) cut into pieces and packed.

    Null and empty texts are the single id END. Repeated rows are packed one by one. Texts of any length are
    whole; only those over ``capacity`` tokens are cut.
    """
    return pack(cut_pieces(docs, vocabulary, capacity), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
