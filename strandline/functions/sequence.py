"""Column expressions on sequences, k-mers, loci and qualities; all run inside Spark's generated code."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")
#: Edge bits: in-edges a, c, g, t then out-edges A, C, G, T.
IN_BITS, OUT_BITS = {b: 1 << i for i, b in enumerate(BASES)}, {b: 16 << i for i, b in enumerate(BASES)}


def col(c: Column | str) -> Column:
    """A column from a column or its name."""
    return F.col(c) if isinstance(c, str) else c


def complement(seq: Column | str) -> Column:
    """Each base replaced by its partner; other letters stay."""
    return F.translate(col(seq), "ACGTN", "TGCAN")


def reverse_complement(seq: Column | str, strict: bool = False) -> Column:
    """The other strand, read forwards; ``strict`` raises on letters that are not bases."""
    out = F.reverse(complement(seq))
    if strict:
        out = F.when(col(seq).rlike("[^ACGTN]"), F.raise_error(F.concat(F.lit("not a base in "), col(seq)))).otherwise(out)
    return out


def canonical(kmer: Column | str) -> Column:
    """The smaller of both strands."""
    return F.least(col(kmer), reverse_complement(kmer))


def is_forward(kmer: Column | str) -> Column:
    """Whether the k-mer itself is the strictly smaller strand; a palindrome counts as reverse."""
    return col(kmer) < reverse_complement(kmer)


def homopolymer_compressed(seq: Column | str) -> Column:
    """Runs of one letter collapsed to that letter."""
    return F.regexp_replace(col(seq), r"(.)\1+", "$1")


def shannon_entropy(seq: Column | str) -> Column:
    """Bits per letter of the letters' distribution; 0 for an empty sequence."""
    s = col(seq)
    n = F.length(s).cast("double")
    shares = F.transform(F.array_distinct(F.split(s, "")), lambda x: (n - F.length(F.replace(s, x, F.lit("")))) / n)
    total = F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(n > 0, total).otherwise(0.0)


def gc_content(seq: Column | str) -> Column:
    """Share of G and C; 0 for an empty sequence."""
    s = col(seq)
    return F.when(F.length(s) > 0, F.length(F.regexp_replace(s, "[^GC]", "")) / F.length(s)).otherwise(0.0)


def windows(seq: Column | str, k: int) -> Column:
    """Array of all overlapping k-mers; empty if the sequence is shorter than ``k``."""
    s = col(seq)
    starts = F.when(F.length(s) >= k, F.sequence(F.lit(1), F.length(s) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(s, i, F.lit(k)))


def tiles(seq: Column | str, size: int, name: Column | str | None = None) -> Column:
    """Array of non-overlapping pieces ``start, seq`` (and ``name``: <name>_<start>_to_<start+size>)."""
    s = col(seq)
    starts = F.when(F.length(s) > 0, F.sequence(F.lit(0), F.length(s) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))

    def piece(at: Column) -> Column:
        parts = [at.alias("start"), F.substring(s, at + 1, F.lit(size)).alias("seq")]
        if name is not None:
            parts.append(F.concat_ws("_", col(name), at, F.lit("to"), at + size).alias("name"))
        return F.struct(*parts)

    return F.transform(starts, piece)


def valid_for_graph(seq: Column | str, k: int) -> Column:
    """Bases only, and longer than ``k``: other sequences give no k-mers at all."""
    return col(seq).rlike("^[ACGT]+$") & (F.length(col(seq)) >= k + 1)


# --- edge bits ------------------------------------------------------------------------------------------------------


def _bit(base: Column, bits: dict[str, int]) -> Column:
    out = F.lit(0)
    for b, v in bits.items():
        out = F.when(base == b, v).otherwise(out)
    return out


def edge_bits(before: Column, after: Column, forward: Column) -> Column:
    """Bits of the neighbours of one occurrence, in the orientation of the canonical k-mer; empty bases give none."""
    straight = _bit(before, IN_BITS).bitwiseOR(_bit(after, OUT_BITS))
    turned = _bit(complement(after), IN_BITS).bitwiseOR(_bit(complement(before), OUT_BITS))
    return F.when(forward, straight).otherwise(turned)


def in_degree(edges: Column | str) -> Column:
    """Number of in-edges."""
    return F.bit_count(col(edges).bitwiseAND(F.lit(15)))


def out_degree(edges: Column | str) -> Column:
    """Number of out-edges."""
    return F.bit_count(col(edges).bitwiseAND(F.lit(240)))


def is_junction(edges: Column | str) -> Column:
    """More than one edge on either side."""
    return (in_degree(edges) > 1) | (out_degree(edges) > 1)


def junction_ahead(kmer: Column | str, edges: Column | str) -> Column:
    """More than one edge on the side that a walk through ``kmer`` as written faces."""
    return F.when(col(kmer) == canonical(kmer), out_degree(edges)).otherwise(in_degree(edges)) > 1


def edges_text(edges: Column | str) -> Column:
    """Eight characters acgtACGT, with a dot for an absent edge."""
    names = [*((b.lower(), v) for b, v in IN_BITS.items()), *OUT_BITS.items()]
    return F.concat(*[F.when(col(edges).bitwiseAND(F.lit(v)) != 0, n).otherwise(".") for n, v in names])


def parse_edges(text: Column | str) -> Column:
    """Edge bits of their eight-character text."""
    out = F.lit(0)
    for name, v in [*((b.lower(), v) for b, v in IN_BITS.items()), *OUT_BITS.items()]:
        out = out.bitwiseOR(F.when(F.instr(col(text), name) > 0, v).otherwise(0))
    return out


def next_kmers(kmer: Column | str, edges: Column | str) -> Column:
    """K-mers that follow ``kmer`` as written."""
    k, e = col(kmer), col(edges)
    tail = F.substring(k, F.lit(2), F.length(k))
    straight = [F.when(e.bitwiseAND(F.lit(OUT_BITS[b])) != 0, F.concat(tail, F.lit(b))) for b in BASES]
    turned = [F.when(e.bitwiseAND(F.lit(IN_BITS[b])) != 0, F.concat(tail, complement(F.lit(b)))) for b in BASES]
    return F.array_compact(F.when(k == canonical(k), F.array(*straight)).otherwise(F.array(*turned)))


def previous_kmers(kmer: Column | str, edges: Column | str) -> Column:
    """K-mers that precede ``kmer`` as written."""
    k, e = col(kmer), col(edges)
    head = F.substring(k, F.lit(1), F.length(k) - 1)
    straight = [F.when(e.bitwiseAND(F.lit(IN_BITS[b])) != 0, F.concat(F.lit(b), head)) for b in BASES]
    turned = [F.when(e.bitwiseAND(F.lit(OUT_BITS[b])) != 0, F.concat(complement(F.lit(b)), head)) for b in BASES]
    return F.array_compact(F.when(k == canonical(k), F.array(*straight)).otherwise(F.array(*turned)))


# --- loci, names ----------------------------------------------------------------------------------------------------

_LOCUS = r"^(.*)[:\s]+(\d+)[-\s]+(\d+)(?:[|\s+](.*))?$"


def parse_locus(text: Column | str, padding: int = 0) -> Column:
    """Struct ``contig, start, stop, name`` of a locus text.

    Commas are dropped. Padding widens both ends, the start at 0 at least; a missing name is the padded
    contig:start-stop. Texts that are no locus, or whose start is over their stop, raise an error.
    """
    t = F.regexp_replace(col(text), ",", "")
    part = lambda i: F.regexp_extract(t, _LOCUS, i)
    start, stop = part(2).cast("long"), part(3).cast("long")
    low, high = F.greatest(start - padding, F.lit(0)), stop + padding
    name = F.when(part(4) == "", F.concat(part(1), F.lit(":"), low, F.lit("-"), high)).otherwise(part(4))
    whole = F.struct(part(1).alias("contig"), low.alias("start"), high.alias("stop"), name.alias("name"))
    wrong = ~t.rlike(_LOCUS) | (start > stop)
    return F.when(wrong, F.raise_error(F.concat(F.lit("not a locus: "), col(text)))).otherwise(whole)


def pad_interval(start: Column | str, stop: Column | str, window: int) -> Column:
    """Struct ``start, stop``: widened to a multiple of ``window``, half on each side, the start at 0 at least."""
    a, b = col(start), col(stop)
    missing = F.pmod(-(b - a), F.lit(window))
    left = F.floor(missing / 2)
    return F.struct(F.greatest(a - left, F.lit(0)).alias("start"), (b + missing - left).alias("stop"))


def window_starts(start: Column | str, stop: Column | str, window: int) -> Column:
    """Starts of the windows that cover an interval."""
    a, b = col(start).cast("long"), col(stop).cast("long")
    return F.when(b > a, F.sequence(a, b - 1, F.lit(window).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def read_name(*parts: Column | str) -> Column:
    """Name fields joined by bars."""
    return F.concat_ws("|", *[col(p) for p in parts])


def sample_of(name: Column | str) -> Column:
    """Last field of a read name."""
    return F.element_at(F.split(col(name), r"\|"), -1)


def base_name(path: Column | str, extensions: Sequence[str]) -> Column:
    """File name without any of the extensions, stripped repeatedly, longest first."""
    ends = "|".join(e.replace(".", r"\.") for e in sorted(extensions, key=len, reverse=True))
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), f"({ends})+$", "")


def bed_line(locus: Column | str) -> Column:
    """A locus (see parse_locus) as a line of BED."""
    l = col(locus)  # noqa: E741
    return F.concat_ws("\t", l["contig"], l["start"].cast("string"), l["stop"].cast("string"), l["name"])


def renamed(name: Column | str, prefix: Column | str) -> Column:
    """A name with a prefix and a bar before it, as where files of several samples are put together."""
    return F.concat_ws("|", col(prefix), col(name))


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance of two sequences."""
    return F.levenshtein(col(a), col(b))


def ungapped(seq: Column | str) -> Column:
    """Sequence without alignment gaps."""
    return F.replace(col(seq), F.lit("-"), F.lit(""))


# --- qualities ------------------------------------------------------------------------------------------------------


def phred_text(quals: Column | str) -> Column:
    """Quality numbers as text, shifted by 33."""
    return F.array_join(F.transform(col(quals), lambda q: F.char(q + 33)), "")


def score_quality(log_sum: Column, n: Column) -> Column:
    """Quality character from the summed logs of ``n`` k-mer scores over a base: their product to the power 1/(1+n)."""
    p = F.exp(log_sum / (n + 1))
    q = F.floor(-10 * F.log10(1 - F.greatest(p - 1e-4, F.lit(0.0)))).cast("int") + 33
    return F.char(F.least(F.greatest(q, F.lit(33)), F.lit(73)))


def path_quality(score: Column | str, cap: int = 60) -> Column:
    """Phred-like quality of a path score, at most ``cap``."""
    s = col(score)
    return F.when(s >= 1, cap).otherwise(F.least(F.lit(cap), (-10 * F.log10(1 - s)).cast("int")))


# --- links, paths ---------------------------------------------------------------------------------------------------


def link_complement(junctions: Column | str) -> Column:
    """Junction bases of the other strand."""
    return complement(junctions)


def link_text(is_forward_: Column | str, junctions: Column | str) -> Column:
    """``F`` or ``R`` and the junction bases."""
    return F.concat(F.when(col(is_forward_), "F").otherwise("R"), F.lit(" "), col(junctions))


def contig_of_path(kmers: Column | str) -> Column:
    """First k-mer and the last base of each further one; empty for an empty path."""
    a = col(kmers)
    rest = F.transform(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), lambda x: F.right(x, F.lit(1)))
    return F.when(F.size(a) > 0, F.concat(F.element_at(a, 1), F.array_join(rest, ""))).otherwise("")


def ordered_concat(order: Column | str, piece: Column | str, joiner: str = "") -> Column:
    """Aggregate: pieces joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(col(order).alias("o"), col(piece).alias("p")))), lambda x: x["p"]), joiner)


def apply_cs(reference: Column | str, edits: Column | str) -> Column:
    """Alternate sequence from a reference and its difference string (:n match, *ab substitution, +x insert, -x delete)."""
    ref = col(reference)
    ops = F.regexp_extract_all(col(edits), F.lit(r"(:[0-9]+|\*[a-z][a-z]|\+[a-z]+|-[a-z]+)"), F.lit(1))

    def step(acc: Column, op: Column) -> Column:
        kind, rest = F.left(op, F.lit(1)), F.substring(op, F.lit(2), F.length(op))
        n = F.when(kind == ":", F.try_to_number(rest, F.lit("9999999999")).cast("int")).when(kind == "*", 1).when(kind == "-", F.length(rest)).otherwise(0)
        add = F.when(kind == ":", F.substring(ref, acc["at"] + 1, n)).when(kind == "*", F.upper(F.right(rest, F.lit(1)))).when(kind == "+", F.upper(rest)).otherwise("")
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], add).alias("out"))

    return F.aggregate(ops, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])


# --- repeats --------------------------------------------------------------------------------------------------------


def trim_to_repeat(seq: Column | str, begins: Sequence[str], ends: Sequence[str]) -> Column:
    """Struct ``trimmed, repeat, pre, post`` between the first matching begin and end patterns, in priority order.

    ``trimmed`` includes both matches and ``repeat`` neither; null if no pattern of either list matches in order.
    """
    first = lambda s, patterns: F.coalesce(*[F.when(s.rlike(p), F.struct(F.regexp_instr(s, F.lit(p)).alias("at"), F.regexp_substr(s, F.lit(p)).alias("text"))) for p in patterns])

    def cut_at(pre: Column, rest: Column, end: Column) -> Column:
        repeat = F.substring(rest, F.lit(1), end["at"] - 1)
        whole = F.struct(F.concat(pre["text"], repeat, end["text"]).alias("trimmed"), repeat.alias("repeat"), pre["text"].alias("pre"), end["text"].alias("post"))
        return F.when(pre.isNotNull() & end.isNotNull(), whole)

    def after(s: Column, pre: Column) -> Column:
        rest = F.substring(s, pre["at"] + F.length(pre["text"]), F.length(s))
        return _once(rest, lambda r: _once(first(r, ends), lambda end: cut_at(pre, r, end)))

    return _once(col(seq), lambda s: _once(first(s, begins), lambda pre: after(s, pre)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it stands there."""
    return F.transform(F.array(value), use)[0]


def repeat_interruptions(repeat: Column | str, patterns: Sequence[tuple[str, str]]) -> Column:
    """Map of interruption name to count. Each pattern's matches are masked by as many dots before the next looks."""
    s, pairs = col(repeat), []
    for name, pattern in patterns:
        pairs += [F.lit(name), F.regexp_count(s, F.lit(pattern))]
        s = F.regexp_replace(s, pattern, "." * len(name))
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def repeat_units(seq: Column | str, unit: str, counted: Sequence[str] = ()) -> Column:
    """Units between the first and the last unit of a repeat, both included, and the ``counted`` interruptions there.

    Each is counted as it is written, without overlap with itself.
    """
    region = F.coalesce(F.regexp_substr(col(seq), F.lit(f"{unit}(.*{unit})?")), F.lit(""))
    total = F.regexp_count(region, F.lit(unit))
    for other in counted:
        total = total + F.regexp_count(region, F.lit(rf"\Q{other}\E"))
    return total
