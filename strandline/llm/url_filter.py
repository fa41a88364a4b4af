"""URL allow and block rules: a trie over reversed host labels, then path characters, walked by longest match."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import table

#: (verdict, host, path): the production rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: More rules than this are joined instead of broadcast as a trie.
MAX_TRIE_RULES = 1_000_000
_END = "//"


def split_url(url):
    """Columns ``host`` and ``path`` of a url column; both are empty for null and for urls without ``://``.

    The host lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the
    path goes on to the next ``?``, ``#`` or the end.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    bare = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^?#]*", 0)
    slash = F.instr(bare, "/")
    host = F.when(slash > 0, F.substring(bare, F.lit(1), slash - 1)).otherwise(bare)
    path = F.when(slash > 0, F.substring(bare, slash, F.length(bare))).otherwise(F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nested dicts: host labels from the last to the first, then whole path segments, then a list of open ends.

    A rule's path is a plain prefix, so its last segment may stop inside a url's segment: it is kept under the
    end mark of its parent node, longest first. Of several rules with one host and path the block rule stays.
    """
    root: dict = {}
    for verdict, host, path in sorted(rules, key=lambda r: r[0] == "block"):
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.setdefault(label, {})
        node = node.setdefault("/", {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        ends = node.setdefault(_END, {})
        ends[last] = (verdict, f"{host}{path}")
    _order(root)
    return root


def _order(node: dict) -> None:
    for key, child in node.items():
        if key == _END:
            node[key] = sorted(child.items(), key=lambda e: -len(e[0]))
        else:
            _order(child)


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(verdict, rule) of the rule with the most host labels, and among them the longest path, or None."""
    hosts, node = [trie], trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        hosts.append(node)
    segments = path.split("/")
    for node in reversed(hosts):
        node, found = node.get("/"), None
        for segment in segments:
            if node is None:
                break
            found = next((hit for end, hit in node.get(_END, ()) if segment.startswith(end)), found)
            node = node.get(segment)
        if found:
            return found
    return None


def judge_urls(urls: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """``urls`` with ``host, path, rule, verdict`` added (replacing columns of these names).

    A rule fits its host and all subdomains if the path starts with the rule's path; the most host labels win,
    then the longest path, then block over allow. ``rule`` is host plus path of the winner, else null, and
    ``verdict`` is then ``default``. Null and malformed urls have an empty host and path. Repeated rows are
    judged one by one and an empty table gives an empty result. Rule lists up to MAX_TRIE_RULES are broadcast
    as a trie; longer ones are joined on every suffix of the host.
    """
    rules = [tuple(r) for r in rules]
    host, path = split_url(F.col(url))
    out = urls.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    if len(rules) > MAX_TRIE_RULES:
        return _joined(out, rules, default)
    trie = urls.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("struct<verdict string, rule string>")
    def walk(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            hits = [longest_match(trie.value, h, p) or (default, None) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(hits, columns=["verdict", "rule"])

    out = out.withColumn("_hit", walk("host", "path"))
    return out.select("*", "_hit.rule", "_hit.verdict").drop("_hit")


def _joined(urls: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """The same by joins: each distinct (host, path) meets the rules of all suffixes of its host."""
    spark = urls.sparkSession
    table_ = spark.createDataFrame(rules, "r_verdict string, r_host string, r_path string")
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = (
        pairs.withColumn("r_host", F.explode(F.array_union(suffixes, F.array(F.lit("")))))
        .join(table_, "r_host")
        .where(F.col("path").startswith(F.col("r_path")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.when(F.col("r_host") == "", 0).otherwise(F.size(F.split("r_host", r"\."))).alias("d"), F.length("r_path").alias("n"), F.col("r_verdict").alias("v"), F.concat("r_host", "r_path").alias("rule"))).alias("hit"))
    )
    joined = urls.join(hits, ["host", "path"], "left")
    return joined.select(*urls.columns, F.col("hit.rule").alias("rule"), F.coalesce("hit.v", F.lit(default)).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` judged by RULES."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_BARE = "regexp_extract(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end, '(?s)^[^?#]*', 0)"
OP8_SQL = f"""
WITH b AS (SELECT page_id, coalesce({_BARE}, '') AS bare FROM pages),
u AS (
  SELECT page_id,
    translate(CASE WHEN strpos(bare, '/') > 0 THEN substr(bare, 1, strpos(bare, '/') - 1) ELSE bare END,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(bare, '/') > 0 THEN substr(bare, strpos(bare, '/')) ELSE '' END AS path
  FROM b),
r(verdict, rhost, rpath) AS (VALUES {', '.join(str(r) for r in RULES)}),
m AS (
  SELECT page_id, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS rn
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.rn = 1
"""
QUERIES = {"op8_url_filter": op8_url_filter}
ORACLES = {"op8_url_filter": OP8_SQL}
