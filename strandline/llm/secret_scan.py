"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every row of the input is a version of a path (its id). Texts are content-addressed: a blob is scanned once for each
rule version, however many paths and versions hold it. What was scanned is appended to the ledger, a Parquet table,
and findings are read back from it and joined to all paths.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import shared_folder, table


class Rule(NamedTuple):
    """A kind of secret: its pattern, and the least length of one of the pattern's groups (0: the whole match)."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = False
    version: int = 1

    @property
    def key(self) -> str:
        """Name of the rule in the ledger; a changed rule takes a new version and is scanned for anew."""
        return f"{self.kind}@{self.version}"


#: In the order in which spans of one start are listed. For ``access`` and ``hex`` the length is in the pattern, which
#: finds the same spans: a run starts at its first possible place, so shorter matches never hide longer ones.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN\x20[A-Z\x20]{0,30}PRIVATE\x20KEY-----", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
)
SPAN = "struct<start:bigint,ord:int,end:bigint,kind:string>"
#: A match: the rule's place in the list, its number, the code points before it and in it, and whether it is long enough.
MATCH = "struct<ord:int,i:int,gap:bigint,len:bigint,good:boolean>"
#: A stretch that findings cover.
MASK = "struct<start:bigint,end:bigint>"
#: Code points of the pieces into which a text is cut once before stretches are taken out of it.
PIECE = 4096
#: Columns of the ledger: a blob, the rule versions it was scanned for in one run, and what they found.
LEDGER = f"blob string, rules array<string>, spans array<{SPAN}>"
#: Shares into which the paths of one blob are dealt when findings are joined to them.
SHARES = 16


def find_matches(text: Column, rule: Rule, order: int) -> Column:
    """Array of MATCH of a rule's leftmost non-overlapping matches, in order.

    The pieces between matches and the matches themselves, laid one after the other, are the text, so their lengths
    tell the places.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    parts = F.slice(F.arrays_zip(matches.alias("m"), F.split(text, rule.pattern, -1).alias("gap"), judged.alias("g")), 1, F.size(matches))
    length = lambda c: F.length(c).cast("long")
    row = lambda p, i: F.struct(F.lit(order).alias("ord"), i.alias("i"), length(p["gap"]).alias("gap"), length(p["m"]).alias("len"), (F.length(p["g"]) >= rule.least).alias("good"))
    return F.when(text.rlike(rule.pattern), F.transform(parts, row)).otherwise(F.array().cast(f"array<{MATCH}>"))


def with_blobs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``blob``, the SHA-256 of the text (null: empty)."""
    return docs.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def scan_blobs(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Ledger rows ``blob, rules, spans`` that ``docs`` (with ``blob``) call for and ``ledger`` lacks.

    Each distinct blob is scanned once for each rule version that the ledger has not seen with it; copies are
    merged before the shuffle, so a blob with many copies is one row a task. ``rules`` lists the keys scanned for.
    """
    blobs = docs.groupBy("blob").agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("_seen"))
    due = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(keys, F.coalesce("_seen", F.array().cast("array<string>"))))
    due = due.where(F.size("rules") > 0)
    none = F.array().cast(f"array<{MATCH}>")
    found = F.concat(*[F.when(F.array_contains("rules", r.key), find_matches(F.col("_text"), r, i)).otherwise(none) for i, r in enumerate(rules)])
    # one row a match, so that places are running sums: linear in the matches of a text; blobs stay where they are
    each = due.select("blob", "rules", F.explode_outer(found).alias("m")).select("blob", "rules", "m.*")
    before = Window.partitionBy("blob", "ord").orderBy("i")
    end = F.sum(F.col("gap") + F.col("len")).over(before)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    span = F.struct((F.col("end") - F.col("len")).alias("start"), "ord", "end", F.get(kinds, F.col("ord")).alias("kind"))
    placed = each.withColumn("end", end).groupBy("blob").agg(F.first("rules").alias("rules"), F.collect_list(F.when(F.col("good"), span)).alias("spans"))
    return placed.select("blob", "rules", F.array_sort("spans").alias("spans"))


def open_ledger(spark: SparkSession, path: str | None = None) -> tuple[DataFrame, str]:
    """(rows, path) of the ledger at ``path``, which is made if there is none; a new one in the shared folder by default."""
    path = path or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    columns = [F.lit(None).cast(kind).alias(name) for name, kind in (part.split(" ", 1) for part in LEDGER.split(", "))]
    spark.range(0).select(*columns).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path), path


def update_ledger(versions: DataFrame, path: str | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Scan the unseen pairs of ``versions`` (with ``blob``), append them to the ledger at ``path`` and return all its rows.

    An append that is lost with its job leaves the ledger as it was; one that is repeated adds rows that say the same.
    """
    known, path = open_ledger(versions.sparkSession, path)
    scan_blobs(versions, known, rules, text).write.mode("append").parquet(path)
    return versions.sparkSession.read.schema(LEDGER).parquet(path)


def findings_of(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, spans, masks`` of the ledger's blobs with a finding of the current rule versions.

    ``masks`` (array of MASK, sorted) are the stretches that spans cover, those that overlap joined.
    """
    keys = {r.kind: r.key for r in rules}
    named = F.create_map(*[F.lit(x) for kv in keys.items() for x in kv])
    current = F.filter("spans", lambda s: F.array_contains(F.col("rules"), F.element_at(named, s["kind"])))
    each = ledger.select("blob", F.explode(current).alias("span")).distinct()
    order = Window.partitionBy("blob").orderBy("span.start", "span.ord", "span.end")
    reach = F.max("span.end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = each.withColumn("_new", F.coalesce((F.col("span.start") >= reach).cast("int"), F.lit(1)))
    parts = fresh.withColumn("_part", F.sum("_new").over(order)).groupBy("blob", "_part").agg(F.min("span.start").alias("start"), F.max("span.end").alias("end"), F.collect_list("span").alias("spans"))
    both = parts.groupBy("blob").agg(F.collect_list("spans").alias("spans"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("masks"))
    return both.select("blob", F.array_sort(F.flatten("spans")).alias("spans"), "masks")


def scan_secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``blob``, ``secret_spans`` (array of SPAN, sorted) and ``secret_masks`` (array of MASK: what spans cover), replacing such columns.

    ``ledger`` is the path of earlier scans (by default a new one): pairs of blob and rule version that it lacks are
    scanned and appended, and findings of the current rule versions are read back and joined to every row of the blob.
    Null texts are empty; neither array is ever null. Repeated rows are kept. A blob's rows are joined in SHARES
    shares, so that one text on very many paths spreads over tasks.
    """
    versions = with_blobs(docs.drop("secret_spans", "secret_masks"), text)
    found = findings_of(update_ledger(versions, ledger, rules, text), rules)
    shares = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))
    dealt = found.select(F.col("blob"), F.col("spans").alias("_found"), F.col("masks").alias("_masks"), shares.alias("_share"))
    joined = versions.withColumn("_share", F.pmod(F.spark_partition_id(), F.lit(SHARES))).join(dealt, ["blob", "_share"], "left")
    spans, masks = F.coalesce("_found", F.array().cast(f"array<{SPAN}>")), F.coalesce("_masks", F.array().cast(f"array<{MASK}>"))
    return joined.withColumn("secret_spans", spans).withColumn("secret_masks", masks).drop("_found", "_masks", "_share").select(*versions.columns, "secret_spans", "secret_masks")


def digest(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, masks: Column, mark: str = "[secret]") -> Column:
    """The text with ``mark`` for every stretch of ``masks`` (sorted, none within another).

    The text is cut into pieces once; what lies between two stretches is taken from the few pieces that hold it, so
    the cost is linear in the text and in the stretches.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def kept(cut: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE)
        held = F.slice(cut, (first + 1).cast("int"), (F.ceil(b / PIECE) - first).cast("int"))
        return F.when(a < b, F.substring(F.array_join(held, ""), (a - first * PIECE + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    def whole(cut: Column) -> Column:
        before = lambda m, i: kept(cut, F.coalesce(F.get(masks, i - 1)["end"], F.lit(0).cast("long")), m["start"])
        tail = kept(cut, F.element_at(masks, -1)["end"], F.length(text).cast("long"))
        return F.concat(F.array_join(F.transform(masks, before), mark), F.lit(mark), tail)

    # a lambda over one value, so that the text is cut once and not for every stretch
    return F.when(F.size(masks) > 0, F.element_at(F.transform(F.array(pieces), whole), 1)).otherwise(text)


def _of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of ``documents``, through a ledger of its own that is written and read back."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in RULES if r.base]
    spans = F.col("secret_spans")
    counts = [F.size(_of_kinds(spans, [k])).cast("long").alias(f"n_{k}") for k in base]
    kept = _of_kinds(spans, base)
    return found.select("doc_id", *counts, F.sha2(digest(kept), 256).alias("base_sha256"), digest(spans).alias("spans"))


def _sql_spans(rule: Rule, order: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {order} AS ord, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i:
      {{'s': coalesce(list_sum(list_transform(gap[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'g': length(g[i])}})) AS x
  FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS m, string_split_regex(t, '{p}') AS gap, regexp_extract_all(t, '{p}', {rule.group}) AS g FROM d WHERE regexp_matches(t, '{p}'))"""


OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(_sql_spans(r, i) for i, r in enumerate(RULES))}),
least(kind, n) AS (VALUES {", ".join(f"('{r.kind}', {r.least})" for r in RULES)}),
s AS (SELECT doc_id, raw.kind, ord, CAST(x.s AS BIGINT) AS b, CAST(x.s + x.n AS BIGINT) AS e FROM raw JOIN least ON raw.kind = least.kind WHERE x.g >= least.n),
a AS (
  SELECT doc_id,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) FILTER (ord < 3) AS base,
    string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""
QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLES = {"op9_secret_scan": OP9_SQL}
