"""Mixing sources to target weights, with DataFrame functions only.

Words are added up for each source, targets follow from weights and limits, and a source's rate is its target over
its size. Each document is emitted floor(rate) times, and once more if a hash of its id, read as a number from 0 to 1,
lies under the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import attach, cut, numbered, table

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeated; words of the mix over words of the corpus; most repeats of a source.
WEIGHTS, SHARE, LIMIT = (5, 2, 1), 1.5, 2
#: Digits of the MD5 that make the draw: 52 bits, which a double holds exactly.
DIGITS = 13


def size_of(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(source: Column) -> Column:
    """The source as text that is never null and orders like it, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def draw(key: Column, text: Column, seed: int) -> Column:
    """A number from 0 to under 1 that depends on the seed and the document's id (its text where the id is null)."""
    named = F.coalesce(key.cast("string"), F.concat(F.lit("text:"), F.md5(text.cast("binary"))), F.lit("none"))
    digits = F.substring(F.md5(F.concat(F.lit(f"mix:{seed}:"), named).cast("binary")), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**DIGITS))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """``source_key, rows, source_size, target`` of every source, from rows ``source_key, size``.

    The sources, by code point of the key, take the weights in turn. Targets add up to ``share`` of all sizes (or to the
    limits of all sources, if that is less), stop at ``limit`` times the source's size, and what lies above is shared
    anew by weight among the others until none is above: rounds of one aggregate over the sources, of which one row
    reaches the driver. A source at its limit stays there, as each round only raises the share of a unit of weight.
    """
    added = sizes.groupBy("source_key").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    ranked = numbered(cut(added).repartitionByRange("source_key").sortWithinPartitions("source_key"), "_rank")
    turn = F.array(*[F.lit(w) for w in weights])
    weighed = cut(ranked.select("source_key", "rows", "source_size", F.get(turn, F.pmod("_rank", F.lit(len(weights))).cast("int")).alias("_weight"), (F.lit(limit) * F.col("source_size")).alias("_cap")))
    total, weight = weighed.agg(F.sum("source_size"), F.sum("_weight")).first()
    left, rest, held = share * (total or 0), weight or 0, 0
    while rest:
        above = F.col("_cap") * F.lit(rest) <= F.col("_weight") * F.lit(left)
        n, caps, taken = weighed.agg(F.count_if(above), F.sum(F.when(above, F.col("_cap"))), F.sum(F.when(above, F.col("_weight")))).first()
        if n == held:
            break
        left, rest, held = share * total - caps, weight - taken, n
    even = F.col("_weight") * F.lit(float(left)) / F.lit(float(rest)) if rest else F.col("_cap")
    return weighed.select("source_key", "rows", "source_size", F.least(F.col("_cap").cast("double"), even.cast("double")).alias("target"))


def repetitions(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, key: str = "doc_id", source: str = "source", text: str = "text", few: int | None = None) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (0 or more, long), replacing such columns.

    Null texts have size 0; null is a source of its own, the last. A source without words has target 0 and no copies.
    Equal seeds give equal copies, in whatever order rows come and however often they are computed. Rows that share an
    id share the draw, and so do rows without id of one text. No row is dropped; an empty table gives none.
    ``few`` lowers the number of sources up to which their targets are broadcast (for tests).
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    sized = docs.select(*kept, size_of(F.col(text)).alias("size"), key_of(F.col(source)).alias("source_key"))
    targets = cut(source_targets(sized.select("source_key", "size"), weights, share, limit))
    sized = sized.withColumn("_draw", draw(F.col(key), F.col(text), seed))
    joined = attach(sized, targets, "source_key", F.xxhash64("_draw"), **({} if few is None else {"limit": few}))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    copies = whole + (F.col("_draw") < rate - whole).cast("long")
    return joined.select(*kept, "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``repetitions`` says, with ``copy`` from 1 in place of such a column."""
    kept = [c for c in docs.columns if c != "copy"]
    return repetitions(docs, **options).where("copies > 0").select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every row of ``documents``."""
    out = repetitions(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


# the closed form of the rounds: in order of limit over weight, a source is at its limit if the share of a unit of
# weight, once all before it are at theirs, reaches it
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, {LIMIT} * source_size AS cap FROM s),
c AS (SELECT *, {SHARE} * CAST(sum(source_size) OVER () AS DOUBLE) AS total,
    coalesce(sum(cap) OVER (ORDER BY cap * 1.0 / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    sum(weight) OVER (ORDER BY cap * 1.0 / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
f AS (SELECT *, cap * rest <= weight * (total - CAST(caps AS DOUBLE)) AS held FROM c),
e AS (SELECT CAST(any_value(total) - coalesce(sum(cap) FILTER (held), 0) AS DOUBLE) AS share, CAST(coalesce(sum(weight) FILTER (NOT held), 0) AS DOUBLE) AS rest FROM f),
t AS (SELECT k, source_size, CASE WHEN held THEN CAST(cap AS DOUBLE) ELSE weight * e.share / e.rest END AS target FROM f, e),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST('0x' || substr(md5('mix:42:' || doc_id), 1, {DIGITS}) AS BIGINT) / CAST({16**DIGITS} AS DOUBLE) AS u FROM d JOIN t USING (k))
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
QUERIES = {"op11_mixing": op11_mixing}
ORACLES = {"op11_mixing": OP11_SQL}
