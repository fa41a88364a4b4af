"""A Merkle manifest of a table: digests of rows, of runs of them within each source, and of the sources.

Rows are numbered once in order of source and id, and every node of every tree is labelled by the interval of row
numbers it covers. A level's nodes meet their parents by bucket (their place divided by the fan), an interval inside its
parent's; what the parent's interval holds beside the node's own are the siblings, of which the proof is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import attach, cut, numbered, table, written

#: Consecutive nodes that become one.
FAN = 16
#: The columns of ``documents`` that a leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A step of a proof: the digests of the siblings before and after the node, concatenated; both empty for an only child.
STEP = "struct<left:string,right:string>"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """Digest of some values: each is its length in UTF-8 bytes, a colon and its text, or ``-`` if null."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return digest(F.concat(*parts))


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its proof (array of STEP, from the leaf up) lead to."""
    return F.aggregate(steps, start, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The nodes of each level, from the given ones up, until every tree has one; ``most`` is the largest tree's size.

    Nodes are ``tree, place, lo, hi, n, digest``: their tree, place in its level, interval, and the level's size in that
    tree. Parents have ``kids`` too, at most FAN structs ``lo, hi, digest``. Each level above the first is written once.
    """
    out = [nodes]
    while most > 1:
        runs = out[-1].where("n > 1").groupBy("tree", F.expr(f"place div {FAN}").alias("place"))
        kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids")
        above = runs.agg(kids, F.first("n").alias("n"))
        bounds = [F.col("kids")[0]["lo"].alias("lo"), F.array_max("kids.hi").alias("hi"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n")]
        out.append(written(above.select("tree", "place", *bounds, digest(F.array_join("kids.digest", "")).alias("digest"), "kids")))
        most = -(-most // FAN)
    return out


def _tops(levels: list[DataFrame]) -> DataFrame:
    """``tree, lo, hi, digest`` of the one node that each tree ends in."""
    out = None
    for level in levels:
        one = level.where("n = 1").select("tree", "lo", "hi", "digest")
        out = one if out is None else out.union(one)
    return out


def _descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The nodes of the lowest level with ``steps`` (up to where the tree's top leads) and ``above``.

    ``tops`` holds ``tree, steps, above`` of the trees' tops. From the top level down, each node takes its siblings from
    the parent whose interval contains its own, before the parent's own steps.
    """
    parents = None
    for level in reversed(levels):
        known = level.where("n = 1").join(tops, "tree")
        if parents is not None:
            up = parents.select(F.col("tree").alias("up_tree"), F.col("place").alias("bucket"), F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"), F.col("kids").alias("up_kids"), F.col("steps").alias("up_steps"), "above")
            inside = (F.col("tree") == F.col("up_tree")) & (F.expr(f"place div {FAN}") == F.col("bucket")) & (F.col("up_lo") <= F.col("lo")) & (F.col("hi") <= F.col("up_hi"))
            before = F.filter("up_kids", lambda k: k["hi"] <= F.col("lo"))
            after = F.filter("up_kids", lambda k: k["lo"] >= F.col("hi"))
            side = [F.array_join(F.transform(x, lambda k: k["digest"]), "").alias(name) for name, x in (("left", before), ("right", after))]
            met = level.where("n > 1").join(up, inside)
            known = known.unionByName(met.select(*level.columns, F.concat(F.array(F.struct(*side)), "up_steps").alias("steps"), "above"))
        parents = known
    return parents


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", source: str = "source", also: dict[str, Column] | None = None, few: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``key``, the columns ``also``, ``leaf``, ``subroot``, ``root`` and ``steps`` (array of STEP, from the leaf up to the root).

    Leaves ascend by key within each source (nulls first; rows of one key by leaf, which makes the digests definite), and
    every FAN consecutive nodes of a level become one, until one is left; so do the sources' subroots, by source, null
    first. A lone node of a level has no siblings and gives no step only where its tree ends; a last run of one has an
    empty step. Equal rows are leaves of their own. An empty table gives no rows. ``few`` lowers the number of
    sources up to which their labels are broadcast (for tests).

    The table is read once; what is kept are digests. A source may hold most rows: ranges split it by key.
    """
    more = also or {}
    read = docs.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("_source"), leaf(*[F.col(c) for c in fields]).alias("digest"), *[c.alias(f"_also_{n}") for n, c in more.items()])
    # kept first, so that rows equal in all of these can be told apart by where they lie
    kept = cut(read).withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    order = [F.col("_source").asc_nulls_first(), F.col("_key").asc_nulls_first(), F.col("digest"), F.col("_tie")]
    ranked = numbered(kept.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie"), "lo")
    named = ranked.withColumn("_name", F.coalesce(F.concat(F.lit("1"), "_source"), F.lit("0"))).drop("_source")
    found = named.groupBy("_name").agg(F.min("lo").alias("first"), F.count(F.lit(1)).alias("rows"))
    trees = cut(numbered(cut(found).repartitionByRange("_name").sortWithinPartitions("_name"), "tree"))
    n_trees, most = trees.agg(F.count(F.lit(1)), F.max("rows")).first()

    labelled = attach(named, trees.withColumn("n", F.col("rows")), "_name", F.col("lo"), **({} if few is None else {"limit": few}))
    leaves = written(labelled.select("tree", (F.col("lo") - F.col("first")).alias("place"), "lo", (F.col("lo") + 1).alias("hi"), "n", "digest", "_key", *[f"_also_{n}" for n in more]))
    low = _levels(leaves, most or 0)
    subroots = cut(_tops(low))
    high = _levels(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "lo", "hi", F.lit(n_trees).cast("long").alias("n"), "digest"), n_trees)
    top = _tops(high).first()
    # the upper tree's nodes carry the intervals of whole sources; its leaves hand their steps down to the sources' tops
    root = F.lit(top["digest"] if top else None).cast("string")
    start = trees.limit(0).select(F.col("tree"), F.array().cast(f"array<{STEP}>").alias("steps"), F.lit(None).cast("string").alias("above"))
    if top:
        start = docs.sparkSession.createDataFrame([(0, [], None)], f"tree long, steps array<{STEP}>, above string")
    handed = cut(_descend(high, start).select(F.col("place").alias("tree"), "steps", F.col("digest").alias("above")))
    out = _descend(low, handed)
    return out.select(F.col("_key").alias(key), *[F.col(f"_also_{n}").alias(n) for n in more], F.col("digest").alias("leaf"), F.col("above").alias("subroot"), root.alias("root"), "steps")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and a tamper test of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(changed, leaf(*[F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]))
    found = manifest(docs, also={"tampered": tampered})
    proof = digest(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""))
    folded = fold(F.coalesce("tampered", "leaf"), F.col("steps"))
    out = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the SQL spells out: up to 16 ** LEVELS rows a source, and as many sources.
LEVELS = 6


def _sql() -> str:
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
    joined = " || ".join(field.format(c) for c in FIELDS)
    low = " || ".join(field.format(c if c != "text" else f"translate(text, '{UPPER}', '{LOWER}')") for c in FIELDS)
    # bit by bit: a byte is mixed in at every eighth step; the polynomial is fixed by CRC-32
    step = "xor(xor(a, b) >> 1, 3988292384::BIGINT * (xor(a, b) & 1))"
    byte = "CASE WHEN i % 8 = 0 THEN ascii(d[CAST(i // 8 + 1 AS INT)])::BIGINT ELSE 0::BIGINT END"
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * len(d)), lambda i: {byte})), lambda a, b: {step})"
    parts = [
        f"d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS d, coalesce('1' || source, '0') AS s, sha256({joined}) AS leaf, sha256({low}) AS low FROM documents)",
        f"l AS (SELECT *, CASE WHEN xor({crc}, 4294967295::BIGINT) % 5 = 0 THEN low ELSE leaf END AS seen, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d)",
    ]

    def rise(name: str, base: str) -> None:
        parts.append(f"{name}0 AS ({base})")
        for i in range(LEVELS):
            run = "PARTITION BY s, p // 16 ORDER BY p ROWS BETWEEN"
            parts.append(
                f"""{name}s{i} AS (SELECT s, p, n, h, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lt,
    coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rt FROM {name}{i})"""
            )
            parts.append(f"{name}{i + 1} AS (SELECT s, p // 16 AS p, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h FROM {name}{i} GROUP BY s, p // 16)")

    rise("a", "SELECT s, p, count(*) OVER (PARTITION BY s) AS n, leaf AS h FROM l")
    rise("b", f"SELECT 0 AS s, row_number() OVER (ORDER BY s) - 1 AS p, count(*) OVER () AS n, h, s AS name FROM a{LEVELS}")
    parts.append("f0 AS (SELECT l.doc_id, l.s, l.p, l.leaf, l.seen AS cur, '' AS proof FROM l)")
    for i in range(LEVELS):
        parts.append(f"f{i + 1} AS (SELECT doc_id, f.s, f.p, leaf, CASE WHEN x.n = 1 THEN cur ELSE sha256(x.lt || cur || x.rt) END AS cur, proof || CASE WHEN x.n = 1 THEN '' ELSE x.lt || x.rt END AS proof FROM f{i} f JOIN as{i} x ON f.s = x.s AND f.p // {16**i} = x.p)")
    parts.append(f"g0 AS (SELECT doc_id, b0.p, leaf, cur, proof, b0.h AS subroot FROM f{LEVELS} f JOIN b0 ON f.s = b0.name)")
    for i in range(LEVELS):
        parts.append(f"g{i + 1} AS (SELECT doc_id, g.p, leaf, subroot, CASE WHEN x.n = 1 THEN cur ELSE sha256(x.lt || cur || x.rt) END AS cur, proof || CASE WHEN x.n = 1 THEN '' ELSE x.lt || x.rt END AS proof FROM g{i} g JOIN bs{i} x ON g.p // {16**i} = x.p)")
    body = ",\n".join(parts)
    return f"WITH {body}\nSELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = r.h AS verified FROM g{LEVELS}, b{LEVELS} r"


QUERIES = {"op13_merkle": op13_merkle}
ORACLES = {"op13_merkle": _sql()}
