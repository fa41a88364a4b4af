"""Main text of web pages: structure marks the article, and differencing with the nearest URL removes templates."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import cut, numbered, table
from strandline.llm.url_filter import split_url

#: Elements whose content is never text of the page; of the first ones, the page's end is the end if no end tag follows.
_RAW_TEXT = frozenset("script style iframe textarea title".split())
_RAW = _RAW_TEXT | frozenset("noscript template svg select object canvas math".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in _RAW}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*+)(?P<attrs2>[^>]*+)>|<[!?][^>]*+>",
    re.I | re.S,
)
_ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tags may be left out; they mark no article.
_LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup colgroup rp rt".split())
#: Elements that start a block of their own, and so end an open paragraph and a raw element without an end tag.
_BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search "
    "section summary table ul body".split()
)
_BREAK = re.compile(rf"</?(?:{'|'.join(sorted(_BLOCKS | {'tr', 'td', 'th', 'html'}))})(?=[\s/>])", re.I)
_CELLS, _TABLE = frozenset("td th caption".split()), frozenset(["table"])
_PARTS = frozenset("tbody thead tfoot colgroup".split())
_ITEM = _BLOCKS - {"li", "dt", "dd", "address", "div", "p"} | _CELLS
#: What an element's start ends, if its end tag was left out, and the elements beyond which it ends nothing.
_ENDS = dict.fromkeys(_BLOCKS, (frozenset(["p"]), _BLOCKS - {"p"} | _CELLS | {"button"}))
_ENDS |= {"li": (frozenset(["li", "p"]), _ITEM)} | dict.fromkeys(("dt", "dd"), (frozenset(["dt", "dd", "p"]), _ITEM))
_ENDS |= dict.fromkeys(("td", "th"), (_CELLS, _TABLE | {"tr"})) | {"tr": (_CELLS | {"tr", "colgroup"}, _TABLE)}
_ENDS |= dict.fromkeys(("tbody", "thead", "tfoot"), (_CELLS | _PARTS | {"tr"}, _TABLE)) | dict.fromkeys(("rp", "rt"), (frozenset(["rp", "rt"]), frozenset(["ruby"])))
#: Elements beyond which an end tag ends nothing: those of tables pass cells, others do not.
_LIMITS = {"table": frozenset()} | dict.fromkeys(_CELLS | _PARTS | {"tr"}, _TABLE) | {"li": frozenset("ul ol menu dir table".split()) | _CELLS}
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CHROME = frozenset("nav footer aside form button dialog menu".split())
#: Words of a class or id that mark what is not the article.
_CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus reply replies respond share sharing social "
    "related recommended recommendations newsletter subscribe subscription signup login search widget pagination pager toolbar alert toast paywall".split()
)
#: Words that make a class or id a layout name instead (as in "has-sidebar").
_LAYOUT_WORDS = frozenset("has with no without layout page wrapper wrap container body".split())
#: Words that may stand beside those in a name that rules out a part of an article or main element.
_SHAPE_WORDS = frozenset("area bar block box button buttons col form group inner item items left link links list outer panel right section slot top bottom unit post posts articles stories".split())
_CONTENT_WORDS = frozenset("content article post entry story articlebody main".split())


class Block(NamedTuple):
    """A text block, whether structure rules it out, and how strongly the page marks it as article (0 to 3).

    ``region`` is the outermost element around it that says it is an article or main one: its number from 1 (0: none)
    and its own mark.
    """

    text: str
    chrome: bool
    mark: int
    region: tuple[int, int] = (0, 0)


def _judge(name: str, attrs: str, inside: bool) -> tuple[bool, int]:
    """(rules out, mark) of an element. ``inside``: within an article or main element, whose own header is part of it.

    There a class or id rules out only if one of its names has no words but those of chrome and of shape: "related-posts"
    does, "related-work" and "share-of-market" do not.
    """
    mark = 3 if name == "article" else 2 if name == "main" else 0
    chrome = name in _CHROME or (name == "header" and not inside)
    if attrs and name not in ("html", "body"):
        words: set[str] = set()
        plain = False
        for key, a, b, c in _ATTR.findall(attrs):
            value = (a or b or c).lower()
            key = key.lower()
            if key == "role":
                chrome |= value in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form")
                mark = max(mark, 2 * (value == "main"))
            elif key == "itemprop":
                mark = max(mark, 3 * (value == "articlebody"))
            elif key == "aria-hidden":
                chrome |= value == "true" and name not in _INLINE
            elif key in ("class", "id"):
                for one in value.split():
                    own = {w for w in re.split(r"[^a-z0-9]+", one) if w}
                    plain |= bool(own & _CHROME_WORDS) and all(w in _CHROME_WORDS or w in _SHAPE_WORDS or w.isdigit() for w in own)
                    words |= own
        if words & _CHROME_WORDS and not words & _LAYOUT_WORDS and (plain or not inside):
            chrome = True
        elif not chrome and name in ("div", "section", "td") and words & _CONTENT_WORDS:
            mark = max(mark, 1)
    return chrome, 0 if chrome else mark


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page in order: references decoded, white space inside made one space, none empty."""
    page = page or ""
    out: list[Block] = []
    parts: list[str] = []
    none = (False, 0, (0, 0))
    stack: list[tuple[str, bool, int, tuple[int, int]]] = []
    state = none
    regions = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, *state))
            parts.clear()

    def close(names: frozenset[str], limit: frozenset[str], first: bool) -> None:
        """End the innermost or outermost open element of ``names`` that lies inside all of ``limit``, with all in it."""
        nonlocal state
        last = None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                last = i
                if first:
                    break
            elif stack[i][0] in limit:
                break
        if last is not None:
            if stack[-1][1:] != (stack[last - 1][1:] if last else none):
                flush()
            del stack[last:]
            state = stack[-1][1:] if stack else none

    at = 0
    endless: set[str] = set()
    while token := _TOKEN.search(page, at):
        if token.start() > at:
            parts.append(page[at : token.start()])
        at = token.end()
        name = (token["name"] or token["name2"] or "").lower()
        if not name:
            continue
        ending = token["end"] or token["end2"]
        attrs = token["attrs"] or token["attrs2"] or ""
        if name in _RAW:
            if name not in ("svg", "math"):
                flush()
            elif attrs.endswith("/"):
                continue
            if not ending:
                tail = None if name in endless else _RAW_END[name].search(page, at)
                if tail:
                    at = tail.end()
                else:
                    endless.add(name)
                    halt = None if name in _RAW_TEXT else _BREAK.search(page, at)
                    at = halt.start() if halt else len(page)
            continue
        block = name not in _INLINE
        if block:
            flush()
        elif name in ("br", "wbr"):
            parts.append(" " if name == "br" else "")
        if ending:
            close(frozenset([name]), _LIMITS.get(name, _CELLS | _TABLE), True)
            continue
        if name in _ENDS:
            close(*_ENDS[name], False)
        if name not in _VOID:
            chrome, mark = _judge(name, attrs, state[1] > 1)
            mark = 0 if name in _LOOSE else mark
            region = state[2]
            if mark > 1 and not region[0]:
                region = (regions + 1, mark)
            new = (state[0] or chrome, max(state[1], mark), region)
            if new != state:
                flush()
            if attrs.endswith("/") and name not in ("div", "span", "p", "a"):
                continue
            regions = max(regions, region[0])
            stack.append((name, *new))
            state = new
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def settle(blocks: list[Block], shared: set[int]) -> str:
    """The main text: of the blocks that structure allows, those of the marked elements that no near page shares.

    ``shared`` has numbers among the blocks that structure allows. Main elements with all in them, or the articles
    outside of them, are taken, whichever have more text (equal: main elements); on pages with neither, the blocks of
    content divisions, else all. An article guards its blocks: they stay, shared or not, as articles quote each other.
    Elsewhere template lines may stand, so there shared blocks are deleted.
    """
    open_ = [b for b in blocks if not b.chrome]
    if any(b.region[0] for b in open_):
        size = {kind: sum(len(b.text) for b in open_ if b.region[0] and (b.region[1] == 3) == kind) for kind in (True, False)}
        outside = size[True] > size[False]
        taken = [bool(b.region[0]) and (b.region[1] == 3) == outside for b in open_]
    else:
        top = max((b.mark for b in open_), default=0)
        taken = [b.mark == top for b in open_]
    return "\n".join(b.text for i, (b, use) in enumerate(zip(open_, taken, strict=True)) if use and (b.mark == 3 or i not in shared))


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places of ``a`` in one longest common subsequence with ``b``.

    Divides ``a`` in halves and splits ``b`` where the halves' best lengths, from bit-parallel rows, add up to most:
    time is the product of the sizes over the word size, and memory is linear.
    """
    found: set[int] = set()
    jobs = [(0, len(a), 0, len(b))]
    while jobs:
        i, j, k, m = jobs.pop()
        while i < j and k < m and a[i] == b[k]:
            found.add(i)
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            found.add(j - 1)
            j, m = j - 1, m - 1
        if i == j or k == m:
            continue
        if j - i == 1:
            if a[i] in b[k:m]:
                found.add(i)
            continue
        mid = (i + j) // 2
        left = _row(a[i:mid], b[k:m])
        right = _row(a[mid:j][::-1], b[k:m][::-1])
        best = max(range(m - k + 1), key=lambda c: left[c] + right[m - k - c])
        jobs += [(i, mid, k, k + best), (mid, j, k + best, m)]
    return found


def _row(a: list[int], b: list[int]) -> list[int]:
    """Longest common subsequence length of ``a`` with every prefix of ``b``."""
    places: dict[int, int] = {}
    for n, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << n
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    out = [0]
    for bit in reversed(bin(v)[2:].zfill(len(b))):
        out.append(out[-1] + (bit == "0"))
    return out


#: Where the nearest page shares more of a page's lines than this, it may be a version of the page: a second page decides.
VERSION = 0.8
#: Different pages before and after a page, in order of host and path, among which the nearest is sought.
REACH = 2
#: Pages of that order which one group compares; REACH more on either side come along.
BUCKET = 64


def shared_with(own: dict, others: list[dict | None]) -> list[int]:
    """Numbers of the lines that a page shares with the nearest of its neighbours by path.

    Nearness is the number of leading path segments in common; the first of equal ones counts. Neighbours of
    another host, and those with the very same lines, do not count. If the nearest shares over VERSION of the lines,
    only what the others as near (or else the next nearest, if there is one) have too is shared: template lines stand
    on all, an article's only on its versions.
    """
    path = (own["path"] or "").split("/")

    def near(other: dict) -> int:
        n = 0
        for x, y in zip(path, (other["path"] or "").split("/"), strict=False):
            if x != y:
                break
            n += 1
        return n

    lines = list(own["lines"])
    mates = [o for o in others if o is not None and own["host"] and o["host"] == own["host"] and list(o["lines"]) != lines]
    mates.sort(key=near, reverse=True)
    common: set[int] = set(range(len(lines))) if mates else set()
    for mate in mates[: max(2, sum(near(m) == near(mates[0]) for m in mates))]:
        common &= common_lines(lines, list(mate["lines"]))
        if len(common) <= VERSION * len(lines):
            break
    return sorted(common)


def template_lines(pages: DataFrame) -> DataFrame:
    """``k, shared``: the line numbers that each page (``k, url, html``) has in common with its nearest page.

    Lines are the blocks that structure allows. Copies, which are pages of one host with the same lines, are one page
    under the smallest of their paths, and what it shares goes back to all of them; pages without lines take no part.
    The different pages are put in order of host and path segments over range partitions, numbered, and compared in
    buckets of BUCKET with REACH more on either side; so a host of any size spreads over tasks, only hashes of lines
    move, and nothing but one count for each partition passes through the driver.
    """
    host, path = split_url(F.col("url"))

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [[xxhash.xxh64_intdigest(b.text) >> 1 for b in blocks_of(h) if not b.chrome] for h in batch["html"]]
            page = [xxhash.xxh128_hexdigest(b"".join(n.to_bytes(8, "little") for n in x)) for x in lines]
            yield batch[["k", "host", "path"]].assign(page=page, lines=lines)

    rows = pages.withColumns({"host": host, "path": path}).where("host <> ''").select("k", "host", "path", "html")
    lined = cut(rows.mapInPandas(hashes, "k string, host string, path string, page string, lines array<long>").where("size(lines) > 0"))
    # copies have one list of lines, so any will do; a least one of all, as the order of rows is not fixed
    different = lined.groupBy("host", "page").agg(F.min("path").alias("path"), F.min("lines").alias("lines"))
    keys = ["host", F.split("path", "/"), "path", "page"]
    ordered = numbered(different.repartitionByRange(*keys).sortWithinPartitions(*keys), "n")
    own, place = F.floor(F.col("n") / BUCKET), F.pmod(F.col("n"), F.lit(BUCKET))
    buckets = F.array_compact(F.array(own, F.when(place < REACH, own - 1), F.when(place >= BUCKET - REACH, own + 1)))
    dealt = ordered.withColumn("bucket", F.explode(buckets))

    def differ(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        first = int(rows["bucket"].iat[0]) * BUCKET
        at = {r["n"]: r for r in rows.to_dict("records")}
        steps = [x for d in range(1, REACH + 1) for x in (-d, d)]
        out = [(r["host"], r["page"], shared_with(r, [at.get(n + d) for d in steps])) for n, r in at.items() if first <= n < first + BUCKET]
        return pd.DataFrame(out, columns=["host", "page", "shared"])

    shared = dealt.groupBy("bucket").applyInPandas(differ, "host string, page string, shared array<int>").where("size(shared) > 0")
    return lined.select("k", "host", "page").join(shared, ["host", "page"]).select("k", "shared")


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages`` (``page_id, url, html``) as ``page_id, url, text, n_chars``, one row each.

    Structure decides first: scripts, styles, menus, headers, footers, sidebars, forms, and whatever class, id or role
    name as adverts, notices, comments and the like, are out; of the rest, main elements or the articles outside of them
    stay, whichever have more text, or else content divisions, or else all. Every page is aligned with the nearest different page of its host by
    longest common subsequence of lines, and shared lines are deleted unless an article element guards them. Blocks are
    joined by newlines.
    Null html is empty and gives an empty text; a null or hostless url has no neighbours; repeated rows are
    extracted one by one; pages of any length are whole; other columns are not read.
    """
    keyed = pages.select("page_id", "url", "html").withColumn("k", F.md5(F.to_json(F.struct("page_id", "url", "html")).cast("binary")))
    shared = template_lines(keyed).groupBy("k").agg(F.first("shared").alias("shared"))
    joined = keyed.join(shared, "k", "left")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [settle(blocks_of(h), set(s) if s is not None else set()) for h, s in zip(batch["html"], batch["shared"], strict=True)]
            yield batch[["page_id", "url"]].assign(text=found, n_chars=[len(t) for t in found])

    return joined.mapInPandas(texts, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op6_html_text": op6_html_text}
ORACLES: dict[str, str] = {}
