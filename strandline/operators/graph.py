"""K-mer graphs as tables: unitigs, cleaning, walks, bubbles, read correction.

Tables are ``kmers`` (``cn_kmer, cov, edges, score, sources``) and, for walks and bubbles, ``nodes`` (``id, seq``) and
``edges`` (``src, dst``). With ``keys``, a table holds a graph for each of their values, and all are worked on together.
Bubbles and paths take nodes of any type, so nodes of keyed graphs are structs of keys and name.
"""

from __future__ import annotations

import itertools
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators.kmers import infer_edges, met, occurrences
from strandline.operators.lineage import components, cut

#: Most edges of a component that one task takes, and of a graph that is not split into components first.
MAX_COMPONENT, WHOLE = 200_000, 20_000
#: Most edges of a bubble whose best paths one task finds; those of a larger one are found in rounds of joins.
BUBBLE = 200_000
#: What stands for the logarithm's argument where a score is 0.
TINY = 1e-300
Keys = tuple[str, ...]


def oriented(kmers: DataFrame, keys: Keys = ()) -> DataFrame:
    """``keys, node, cn_kmer, edges``: each k-mer as written on both strands (palindromes once)."""
    return kmers.select(*keys, F.explode(F.array_distinct(F.array("cn_kmer", S.reverse_complement("cn_kmer")))).alias("node"), "cn_kmer", "edges")


def traverse(kmers: DataFrame, keys: Keys = ()) -> DataFrame:
    """``keys, src, dst``: the graph of k-mers on both strands, along edges whose ends are both k-mers of the table."""
    rows = oriented(kmers, keys).select(*keys, F.col("node").alias("src"), F.explode(S.next_kmers("node", "edges")).alias("dst"))
    there = kmers.select(*keys, "cn_kmer")
    return rows.withColumn("cn_kmer", S.canonical("dst")).join(there, [*keys, "cn_kmer"], "left_semi").select(*keys, "src", "dst").distinct()


def only_ways(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``node, head``: for each node of the edges ``src, dst`` the first one on the only way to it.

    A node with one predecessor, if it is no start, hangs on that; one with none or several, and a start, is a head.
    Pointers double each round, so rounds grow with the logarithm of the longest such way. Nodes that hang on rings without
    a head, to which nothing leads from elsewhere, have no row.
    """
    into = edges.distinct().groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ins"), F.min("src").alias("before"))
    hung = into.where("ins = 1").select("node", "before").join(starts.select("node"), "node", "left_anti")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(starts.select("node")).distinct()
    at = cut(nodes.join(hung, "node", "left").select("node", F.coalesce("before", "node").alias("head"), F.col("before").isNull().alias("done")))
    for _ in range(at.count().bit_length() + 1):
        if at.where("not done").isEmpty():
            break
        beyond = at.select(F.col("node").alias("head"), F.col("head").alias("next"), F.col("done").alias("ends"))
        further = at.where("not done").join(beyond, "head").select("node", F.col("next").alias("head"), F.col("ends").alias("done"))
        at = cut(at.where("done").union(further))
    return at.where("done").select("node", "head")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``node`` that the roots reach along ``src, dst``, roots included.

    All nodes to which one way leads are taken with its first (see only_ways), so a round goes on to the next node at which
    ways meet, however far, and rounds grow with the number of these on the longest way.
    """
    starts = roots.select("node").where("node is not null").distinct().transform(cut)
    ways = only_ways(edges, starts)
    met = ways.where("node = head").select(F.col("node").alias("dst"))
    jumps = edges.join(met, "dst", "left_semi").join(ways.select(F.col("node").alias("src"), "head"), "src").where("head <> dst").select("head", "dst").distinct().transform(cut)
    seen = front = starts
    while True:
        front = front.join(jumps, front["node"] == jumps["head"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").transform(cut)
        if front.isEmpty():
            return ways.join(seen.select(F.col("node").alias("head")), "head", "left_semi").select("node")
        seen = seen.union(front).transform(cut)


def unitigs(kmers: DataFrame, rounds: int = 40, keys: Keys = ()) -> DataFrame:
    """``keys, node, unitig, offset``: maximal non-branching runs of oriented k-mers; the run is named by its first one.

    A k-mer's successor counts where it is the only one and has no other predecessor. Pointers to the run's start
    double each round, so rounds grow with the logarithm of the longest run; rings are cut before their smallest k-mer.
    """
    e = traverse(kmers, keys)
    one_out = e.groupBy(*keys, "src").agg(F.min("dst").alias("dst"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    one_in = e.groupBy(*keys, "dst").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    step = one_out.join(one_in, [*keys, "dst"]).where("src <> dst")
    nodes = oriented(kmers, keys).select(*keys, "node")
    table = _pointers(nodes, step, keys)
    for n in range(rounds):
        table, moving, size = _jump(table, keys)
        if not moving:
            return table.select(*keys, "node", F.col("jump").alias("unitig"), "offset")
        # whoever still moves after the whole table could have been crossed sits on a ring
        if 2**n > 4 and size < 2**n:
            starts = table.where("moved and node = low").select(*keys, F.col("node").alias("dst"))
            table = _pointers(nodes, step.join(starts, [*keys, "dst"], "left_anti"), keys)
            for _ in range(rounds):
                table, moving, _ = _jump(table, keys)
                if not moving:
                    return table.select(*keys, "node", F.col("jump").alias("unitig"), "offset")
    raise RuntimeError("unitigs did not settle")


def _pointers(nodes: DataFrame, step: DataFrame, keys: Keys) -> DataFrame:
    """Each node with the one before it in its run (itself at a start), and the smaller of both."""
    table = nodes.join(step.select(*keys, F.col("dst").alias("node"), F.col("src").alias("back")), [*keys, "node"], "left")
    back = F.coalesce("back", "node")
    return table.select(*keys, "node", back.alias("jump"), F.when(F.col("back").isNull(), 0).otherwise(1).alias("offset"), F.least("node", back).alias("low")).transform(cut)


def _jump(table: DataFrame, keys: Keys) -> tuple[DataFrame, int, int]:
    """(table, how many moved, rows) after each pointer has taken that of the node it points at."""
    far = table.select(*keys, F.col("node").alias("jump"), F.col("jump").alias("jump2"), F.col("offset").alias("more"), F.col("low").alias("low2"))
    new = table.drop("moved").join(far, [*keys, "jump"]).select(*keys, "node", F.col("jump2").alias("jump"), (F.col("offset") + F.col("more")).alias("offset"), F.least("low", "low2").alias("low"), (F.col("more") > 0).alias("moved")).transform(cut)
    return new, *new.agg(F.count_if("moved"), F.count(F.lit(1))).first()


def _log(score: Column | str = "score") -> Column:
    return F.log(F.greatest(S.col(score), F.lit(TINY)))


def unitig_table(members: DataFrame, kmers: DataFrame, keys: Keys = ()) -> DataFrame:
    """``keys, unitig, n, seq, low, mean, geo``: sequence and least, mean and geometric mean score of each unitig."""
    rows = members.withColumn("cn_kmer", S.canonical("node")).join(kmers.select(*keys, "cn_kmer", "score"), [*keys, "cn_kmer"])
    geo = F.when(F.min("score") <= 0, 0.0).otherwise(F.exp(F.avg(_log())))
    path = F.transform(F.array_sort(F.collect_list(F.struct("offset", "node"))), lambda x: x["node"])
    return rows.groupBy(*keys, "unitig").agg(F.count(F.lit(1)).alias("n"), S.contig_of_path(path).alias("seq"), F.min("score").alias("low"), F.avg("score").alias("mean"), geo.alias("geo"))


def contigs(kmers: DataFrame, keys: Keys = ()) -> DataFrame:
    """``keys, seq`` of each unitig, the smaller of both strands, once."""
    return unitig_table(unitigs(kmers, keys=keys), kmers.withColumn("score", F.lit(1.0)), keys).select(*keys, S.canonical("seq").alias("seq")).distinct()


# --- cleaning -------------------------------------------------------------------------------------------------------


def _drop(kmers: DataFrame, members: DataFrame, bad: DataFrame, keys: Keys) -> DataFrame:
    gone = members.join(bad, [*keys, "unitig"], "left_semi").select(*keys, S.canonical("node").alias("cn_kmer")).distinct()
    return infer_edges(kmers.join(gone, [*keys, "cn_kmer"], "left_anti"), keys).transform(cut)


def _only(color: str) -> Column:
    return F.col("sources") == F.array(F.lit(color))


def remove_branches(kmers: DataFrame, threshold: float, keys: Keys = ()) -> DataFrame:
    """Without unitigs that hold a k-mer under the threshold and whose geometric mean score is under it."""
    m = unitigs(kmers, keys=keys)
    return _drop(kmers, m, unitig_table(m, kmers, keys).where((F.col("low") < threshold) & (F.col("geo") < threshold)), keys)


def remove_color_paths(kmers: DataFrame, color: str, threshold: float, keys: Keys = ()) -> DataFrame:
    """Without unitigs of one color only whose mean score is under the threshold."""
    m = unitigs(kmers, keys=keys)
    own = m.withColumn("cn_kmer", S.canonical("node")).join(kmers.select(*keys, "cn_kmer", "sources"), [*keys, "cn_kmer"]).groupBy(*keys, "unitig").agg(F.bool_and(_only(color)).alias("own"))
    return _drop(kmers, m, unitig_table(m, kmers, keys).join(own, [*keys, "unitig"]).where(F.col("own") & (F.col("mean") < threshold)), keys)


def _ends(kmers: DataFrame, members: DataFrame, keys: Keys) -> DataFrame:
    """``keys, unitig, n, ins, outs``: edges into the first and out of the last k-mer of each unitig."""
    e = traverse(kmers, keys)
    ins = e.groupBy(*keys, F.col("dst").alias("unitig")).agg(F.count(F.lit(1)).alias("ins"))
    outs = e.groupBy(*keys, F.col("src").alias("last")).agg(F.count(F.lit(1)).alias("outs"))
    span = members.groupBy(*keys, "unitig").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("offset", "node"))["node"].alias("last"))
    return span.join(ins, [*keys, "unitig"], "left").join(outs, [*keys, "last"], "left").select(*keys, "unitig", "n", F.coalesce("ins", F.lit(0)).alias("ins"), F.coalesce("outs", F.lit(0)).alias("outs"))


def remove_tips(kmers: DataFrame, k: int, threshold: float, strict: bool = True, keys: Keys = ()) -> DataFrame:
    """Without unitigs of at most 3k k-mers that end on one side, whose mean score is under the threshold.

    With ``strict``, the other side must have more than one edge, so an ordinary tip (one edge) stays.
    """
    m = unitigs(kmers, keys=keys)
    other = 1 if strict else 0
    tip = ((F.col("ins") == 0) & (F.col("outs") > other)) | ((F.col("outs") == 0) & (F.col("ins") > other))
    return _drop(kmers, m, _ends(kmers, m, keys).where(tip & (F.col("n") <= 3 * k)).join(unitig_table(m, kmers, keys).drop("n"), [*keys, "unitig"]).where(F.col("mean") < threshold), keys)


def remove_short(kmers: DataFrame, k: int, least: int = 100, keys: Keys = ()) -> DataFrame:
    """Without unitigs under ``least`` bases that have no neighbour on either side."""
    m = unitigs(kmers, keys=keys)
    return _drop(kmers, m, _ends(kmers, m, keys).where((F.col("ins") == 0) & (F.col("outs") == 0) & (F.col("n") + k - 1 < least)), keys)


def remove_tangles(kmers: DataFrame, color: str, threshold: float, limit: int = 500, keys: Keys = ()) -> DataFrame:
    """Without the one-color neighbourhoods of low-score k-mers with four edges or more.

    From these seeds, steps go through k-mers of the color alone, at most ``limit``; a low-score k-mer is removed but
    not passed.
    """
    by = [*keys, "cn_kmer"]
    own = kmers.where(_only(color))
    low = F.coalesce("score", F.lit(1.0)) < threshold
    seeds = own.where(low & (F.bit_count("edges") >= 4)).select(*by)
    near = traverse(own, keys).select(*keys, S.canonical("src").alias("cn_kmer"), S.canonical("dst").alias("b"))
    near = near.union(near.select(*keys, "b", "cn_kmer")).distinct()
    open_ = own.where(~low).select(*by)
    seen = front = seeds.transform(cut)
    for _ in range(limit):
        if front.isEmpty():
            break
        front = front.join(near, by).select(*keys, F.col("b").alias("cn_kmer")).distinct().join(seen, by, "left_anti").transform(cut)
        seen = seen.union(front).transform(cut)
        front = front.join(open_, by, "left_semi")
    return infer_edges(kmers.join(seen, by, "left_anti"), keys).transform(cut)


def remove_bubbles(kmers: DataFrame, color: str, threshold: float, keys: Keys = ()) -> DataFrame:
    """Without the k-mers that only inferior bubble paths have.

    Of all paths through a superbubble the best by geometric mean score stays, and one more if it is over the threshold; a
    path of which over half is of the one color alone counts as 0 (see best_paths). Bubbles may be nested.
    """
    m = unitigs(kmers, keys=keys).transform(cut)
    found, inside = bubbles(unitig_edges(kmers, m, keys))
    best = best_paths(kmers, m, found, inside, color, keys)
    kept = best.where((F.col("place") == 1) | (F.col("value") > threshold)).select("entry", "exit", F.explode("path").alias("node")).distinct().withColumn("kept", F.lit(True))
    marked = inside.join(kept, ["entry", "exit", "node"], "left").select("entry", "exit", *_parts("node", keys), F.coalesce("kept", F.lit(False)).alias("kept"))
    # a k-mer goes if some bubble has it on bad paths only
    rows = marked.join(m, [*keys, "unitig"]).groupBy("entry", "exit", *keys, S.canonical("node").alias("cn_kmer")).agg(F.bool_or("kept").alias("kept"))
    gone = rows.where("not kept").select(*keys, "cn_kmer").distinct()
    return infer_edges(kmers.join(gone, [*keys, "cn_kmer"], "left_anti"), keys).transform(cut)


def _window(by: list[str], order: list) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def clean(kmers: DataFrame, k: int, threshold: float, colors: tuple[str, str] = ("long", "short"), noise: DataFrame | None = None, limit: int = 500, keys: Keys = ()) -> DataFrame:
    """All cleaning steps in order: noise, tangles of either color, tips, branches, bubbles, branches, short contigs."""
    if noise is not None:
        kmers = infer_edges(kmers.join(noise, [*keys, "cn_kmer"], "left_anti"), keys)
    for color in colors:
        kmers = remove_tangles(kmers, color, threshold, limit, keys)
    kmers = remove_branches(remove_tips(kmers, k, threshold, keys=keys), threshold, keys)
    kmers = remove_branches(remove_bubbles(kmers, colors[1], threshold, keys), threshold, keys)
    return remove_short(kmers, k, keys=keys)


# --- bubbles --------------------------------------------------------------------------------------------------------


def _node(name: str, keys: Keys) -> Column:
    """A node of one graph of many: its name, with the graph's keys if there are any."""
    return F.struct(*keys, F.col(name).alias("unitig")) if keys else F.col(name)


def _parts(node: str, keys: Keys) -> list[Column]:
    """Keys and ``unitig`` of a node."""
    return [F.col(f"{node}.{c}").alias(c) for c in (*keys, "unitig")] if keys else [F.col(node).alias("unitig")]


def unitig_edges(kmers: DataFrame, members: DataFrame, keys: Keys = ()) -> DataFrame:
    """``src, dst``: the graph of unitigs, which are named by their first k-mers (structs of keys and ``unitig``, with keys)."""
    last = members.groupBy(*keys, "unitig").agg(F.max(F.struct("offset", "node"))["node"].alias("src"))
    firsts = members.where("offset = 0").select(*keys, F.col("node").alias("dst"))
    rows = traverse(kmers, keys).join(last, [*keys, "src"]).select(*keys, "unitig", "dst").join(firsts, [*keys, "dst"], "left_semi")
    return rows.select(_node("unitig", keys).alias("src"), _node("dst", keys).alias("dst")).distinct()


def _sweep(graph: DataFrame, starts: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found ``entry, exit, interior``, nodes ``entry, node`` met by them, entries not told within ``limit`` rounds).

    All entries are swept together, as rows. A round passes every met node into which no edge is left that was not
    counted, and meets those after it. A sweep ends where a node has none after it, where it comes back to its entry, or
    where none can be passed; if all met ones are passed but one, and that one could be, it is the exit (Onodera, Sadakane
    and Shibuya, 2013). ``graph`` has ``src, dst, hidden``: nodes that an edge stands for.
    """
    into = graph.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("into"))
    front = starts.select("entry", F.col("entry").alias("node")).transform(cut)
    met = front.select("entry", "node", F.lit(0).cast("long").alias("came"), F.lit(True).alias("passed")).limit(0)
    hidden = front.select("entry", F.lit(0).cast("long").alias("hidden"))
    found = front.select("entry", F.col("node").alias("exit"), F.lit(0).cast("long").alias("interior")).limit(0)
    held = met.select("entry", "node")
    for _ in range(limit):
        grown = front.join(graph, front["node"] == graph["src"], "left").select("entry", "dst", F.coalesce("hidden", F.lit(0)).alias("hidden")).transform(cut)
        bad = grown.where("dst is null or dst = entry").select("entry").distinct()
        more = grown.join(bad, "entry", "left_anti").transform(cut)
        hidden = hidden.union(more.select("entry", "hidden")).groupBy("entry").agg(F.sum("hidden").alias("hidden"))
        rows = met.select("entry", "node", "came", "passed").union(more.select("entry", F.col("dst").alias("node"), F.lit(1).cast("long"), F.lit(False)))
        met = rows.groupBy("entry", "node").agg(F.sum("came").alias("came"), F.bool_or("passed").alias("passed")).join(more.select("entry").distinct(), "entry", "left_semi")
        met = met.join(into, "node").withColumn("ready", ~F.col("passed") & (F.col("came") == F.col("into"))).transform(cut)
        state = met.groupBy("entry").agg(F.count_if(~F.col("passed")).alias("open"), F.count_if("ready").alias("ready"), F.count(F.lit(1)).alias("n")).transform(cut)
        # one open node, which could be passed: the exit, unless it leads back to the entry
        ends = met.where("ready").join(state.where("open = 1 and ready = 1").select("entry", "n"), "entry").select("entry", F.col("node").alias("exit"), "n")
        back = graph.select(F.col("src").alias("exit"), F.col("dst").alias("entry"))
        hit = ends.join(back, ["entry", "exit"], "left_anti").join(hidden, "entry").select("entry", "exit", (F.col("n") - 1 + F.col("hidden")).alias("interior")).transform(cut)
        found = found.union(hit)
        held = held.union(met.join(hit, "entry", "left_semi").select("entry", "node")).transform(cut)
        going = state.where("ready > 0 and not (open = 1 and ready = 1)").select("entry")
        front = met.where("ready").join(going, "entry", "left_semi").select("entry", "node").transform(cut)
        if front.isEmpty():
            return found.transform(cut), held, front.select("entry")
        met = met.join(going, "entry", "left_semi").select("entry", "node", "came", (F.col("passed") | F.col("ready")).alias("passed"))
        hidden = hidden.join(going, "entry", "left_semi").transform(cut)
    return found.transform(cut), held, front.select("entry").distinct()


def _bubbles_by_joins(edges: DataFrame, limit: int = 4) -> tuple[DataFrame, DataFrame]:
    """What bubbles returns, for components of any size.

    Nodes that branch are swept for an exit (see _sweep), at most ``limit`` rounds at first. What is found is contracted to an
    edge that stands for its inside, and the sweeps that were not done begin anew on the smaller graph with twice the
    rounds, until all are. No component is gathered anywhere.
    """
    graph = edges.select("src", "dst", F.lit(0).cast("long").alias("hidden")).distinct().transform(cut)
    starts = graph.groupBy(F.col("src").alias("entry")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entry").transform(cut)
    found, held = None, None
    while True:
        new, nodes, starts = _sweep(graph, starts, limit)
        nodes = nodes.join(new.select("entry", "exit"), "entry").select("entry", "exit", "node").transform(cut)
        found = new if found is None else found.union(new)
        held = nodes if held is None else held.union(nodes)
        if starts.isEmpty():
            break
        inner = nodes.where("node <> exit").select("node").distinct()
        left = graph.join(inner.withColumnRenamed("node", "src"), "src", "left_anti").join(inner.withColumnRenamed("node", "dst"), "dst", "left_anti")
        outer = new.select(F.col("entry").alias("src"), F.col("exit").alias("dst"), F.col("interior").alias("hidden"))
        outer = outer.join(inner.withColumnRenamed("node", "src"), "src", "left_anti").join(inner.withColumnRenamed("node", "dst"), "dst", "left_anti")
        graph = left.select("src", "dst", "hidden").join(outer.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(outer).transform(cut)
        starts, limit = starts.transform(cut), 2 * limit
    found = found.transform(cut)
    whole = held.union(held.select("entry", "exit", F.col("entry").alias("node"))).distinct().transform(cut)
    # a bubble lies in another one that met both its ends
    a = whole.select(F.col("entry").alias("oe"), F.col("exit").alias("ox"), F.col("node").alias("entry"))
    b = whole.select(F.col("entry").alias("oe"), F.col("exit").alias("ox"), F.col("node").alias("exit"))
    size = found.select(F.col("entry").alias("oe"), F.col("exit").alias("ox"), F.col("interior").alias("more"))
    within = found.join(a, "entry").join(b, ["oe", "ox", "exit"]).join(size, ["oe", "ox"]).where("more > interior").select("oe", "ox", "entry", "exit").transform(cut)
    nested = within.select("entry", "exit").distinct().withColumn("is_nested", F.lit(True))
    marked = found.join(nested, ["entry", "exit"], "left").select("entry", "exit", F.col("interior").cast("int").alias("interior"), F.coalesce("is_nested", F.lit(False)).alias("is_nested"))
    inside = held.where("node <> exit").transform(cut)
    while True:  # what contracted bubbles hide lies in those around them too, level by level
        deeper = within.join(inside, ["entry", "exit"]).select(F.col("oe").alias("entry"), F.col("ox").alias("exit"), "node")
        fresh = deeper.join(inside, ["entry", "exit", "node"], "left_anti").distinct().transform(cut)
        if fresh.isEmpty():
            return marked, inside
        inside = inside.union(fresh).transform(cut)


def find_superbubble(start: object, nexts: dict, into: dict) -> tuple[object, set] | None:
    """(exit, nodes inside) of the superbubble that starts at a node, or None: _sweep for one entry.

    ``nexts`` are the nodes after each one, ``into`` the number of edges into each.
    """
    left: dict = {}
    ready, inside = [start], set()
    while ready:
        node = ready.pop()
        after = nexts.get(node)
        if not after or start in after:
            return None
        inside.add(node)
        for child in after:
            left[child] = left.get(child, into[child]) - 1
            if not left[child]:
                ready.append(child)
        if len(ready) == 1 and len(left) == len(inside):
            inside.discard(start)
            return None if start in nexts.get(ready[0], ()) else (ready[0], inside)
    return None


def _bubbles_in_groups(rows: DataFrame) -> DataFrame:
    """``entry, exit, interior, is_nested, nodes`` of the bubbles of whole components (``part, src, dst``), each in one task."""
    kind = rows.schema["src"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        name = lambda x: tuple(x.values()) if isinstance(x, dict) else x
        written: dict = {}
        nexts: dict = {}
        into: dict = {}
        for a, b in zip(frame["src"], frame["dst"], strict=True):
            x, y = name(a), name(b)
            written[x], written[y] = a, b
            nexts.setdefault(x, set()).add(y)
            into[y] = into.get(y, 0) + 1
        found = {(x, hit[0]): hit[1] for x, after in nexts.items() if len(after) > 1 and (hit := find_superbubble(x, nexts, into))}
        # the bubbles that hold each node inside; the nodes of a nested one all lie in one of them
        around: dict = {}
        for pair, inside in found.items():
            for x in inside:
                around.setdefault(x, []).append(pair)
        out = []
        for (x, y), inside in found.items():
            nested = any(len(found[o]) > len(inside) and {x, y} <= found[o] | set(o) for o in around[next(iter(inside))] if o != (x, y))
            out.append((written[x], written[y], len(inside), nested, [written[z] for z in inside]))
        return pd.DataFrame(out, columns=["entry", "exit", "interior", "is_nested", "nodes"])

    return rows.groupBy("part").applyInPandas(run, f"entry {kind}, exit {kind}, interior int, is_nested boolean, nodes array<{kind}>")


def bubbles(edges: DataFrame, largest: int = MAX_COMPONENT, limit: int = 4) -> tuple[DataFrame, DataFrame]:
    """(bubbles ``entry, exit, interior, is_nested``, inside ``entry, exit, node``) of all superbubbles of ``src, dst``.

    Components of at most ``largest`` edges are searched in one task each; larger ones by sweeps that are joins (see
    _bubbles_by_joins). Both find the same. A bubble whose ends both lie in a larger one is nested.
    """
    rows = edges.select("src", "dst").distinct().transform(cut)
    if rows.count() <= min(largest, WHOLE):
        small, large = rows.withColumn("part", F.lit(0)), None
    else:
        part = rows.join(components(rows).select(F.col("node").alias("src"), F.xxhash64("component").alias("part")), "src").select("part", "src", "dst").transform(cut)
        size = part.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > largest)
        small, large = part.join(size, "part", "left_anti"), part.join(size, "part", "left_semi").select("src", "dst").transform(cut)
    held = _bubbles_in_groups(small).transform(cut)
    found, inside = held.drop("nodes"), held.select("entry", "exit", F.explode("nodes").alias("node"))
    if large is not None and not large.isEmpty():
        more, within = _bubbles_by_joins(large, limit)
        found, inside = found.union(more), inside.union(within)
    return found, inside


def superbubbles(edges: DataFrame) -> DataFrame:
    """``entry, exit, interior, is_nested`` of all superbubbles of ``src, dst``, in the direction of the edges (see bubbles)."""
    return bubbles(edges)[0]


def best_paths(kmers: DataFrame, members: DataFrame, found: DataFrame, inside: DataFrame, color: str | None = None, keys: Keys = ()) -> DataFrame:
    """``entry, exit, place, path, n, value``: the two best paths through each bubble of the unitig graph.

    A path's k-mers go from its entry's last to its exit's first one; ``n`` counts them, ``path`` names its unitigs, ends
    included. Its value is their geometric mean score (missing: 1), or 0 where over half of them are of ``color`` alone.
    Of paths of one value, that with fewer zero scores is first, then that with the higher mean, then the smaller one read
    from its exit. Paths are not listed: the two best ways to each node for each number of k-mers (and of k-mers of the color) suffice.
    """
    scored = members.withColumn("cn_kmer", S.canonical("node")).join(kmers.select(*keys, "cn_kmer", "score", *(["sources"] if color else [])), [*keys, "cn_kmer"], "left")
    own = _only(color).cast("int") if color else F.lit(0)
    each = scored.select(_node("unitig", keys).alias("unit"), "offset", _log(F.coalesce("score", F.lit(1.0))).alias("logs"), (F.coalesce("score", F.lit(1.0)) <= 0).cast("int").alias("zeros"), F.coalesce(own, F.lit(0)).alias("own"))
    values = ("logs", "zeros", "own")
    unit = each.groupBy(F.col("unit").alias("dst")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in values], F.max_by(F.struct(*values), "offset").alias("last"), F.min_by(F.struct(*values), "offset").alias("first")).transform(cut)
    edges = unitig_edges(kmers, members, keys)
    steps = inside.select("entry", "exit", F.col("node").alias("src")).union(found.select("entry", "exit", F.col("entry").alias("src"))).join(edges, "src").join(unit, "dst")
    rows = steps.select("entry", "exit", "src", "dst", F.when(F.col("dst") == F.col("exit"), F.struct(F.lit(1).cast("long").alias("n"), "first.*")).otherwise(F.struct("n", *values)).alias("v"))
    start = found.select("entry", "exit").join(unit.select(F.col("dst").alias("entry"), F.col("last").alias("start")), "entry")
    return ranked_ways(rows.select("entry", "exit", "src", "dst", "v.*").transform(cut), start).transform(cut)


def ranked_ways(rows: DataFrame, start: DataFrame, largest: int = BUBBLE) -> DataFrame:
    """``entry, exit, place, path, n, value``: the two best ways through each of many graphs without cycles (see best_paths).

    ``rows`` are the edges ``entry, exit, src, dst`` with what ``dst`` adds: ``n``, ``logs``, ``zeros``, ``own``; ``start`` has
    ``entry, exit`` and these (``start``, but for n, which is 1) of the entry. Every node leads from the entry to the exit. Graphs
    of up to ``largest`` edges take a task each, others take rounds of joins; both give the same ways.
    """
    size = rows.groupBy("entry", "exit").agg(F.count(F.lit(1)).alias("_edges")).join(start, ["entry", "exit"]).transform(cut)
    small, large = size.where(F.col("_edges") <= largest), size.where(F.col("_edges") > largest)
    ways = _ways_in_groups(rows, small)
    if not large.isEmpty():
        ways = ways.union(_ways_in_rounds(rows, large))
    share, mean = F.col("own") / F.col("n"), F.col("logs") / F.col("n")
    value = F.when((F.col("zeros") > 0) | (share > 0.5), 0.0).otherwise(F.exp(mean))
    order = [F.desc("value"), F.asc("zeros"), F.desc("_mean"), F.reverse("path")]
    ranked = ways.withColumn("value", value).withColumn("_mean", mean).withColumn("place", F.row_number().over(_window(["entry", "exit"], order)))
    return ranked.where("place <= 2").select("entry", "exit", "place", "path", "n", "value")


def _ways_in_groups(rows: DataFrame, size: DataFrame) -> DataFrame:
    """``entry, exit, path, n, logs, zeros, own``: per bubble, the two best paths of each length and color count, in one task each."""
    schema = ", ".join(f"{c} {rows.schema[t].dataType.simpleString()}" for c, t in (("entry", "src"), ("exit", "src"))) + f", path array<{rows.schema['src'].dataType.simpleString()}>, n long, logs double, zeros long, own long"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        name = lambda x: tuple(x.values()) if isinstance(x, dict) else x
        entry, exit_ = frame["entry"].iat[0], frame["exit"].iat[0]
        first, last = name(entry), name(exit_)
        written = {first: entry, last: exit_} | {name(x): x for x in frame["dst"]}
        nexts: dict = {}
        into: dict = {}
        for s, d, *v in zip(frame["src"].map(name), frame["dst"].map(name), frame["n"], frame["logs"], frame["zeros"], frame["own"], strict=True):
            nexts.setdefault(s, []).append((d, v))
            into[d] = into.get(d, 0) + 1
        begin = frame["start"].iat[0]
        # a node's ways: (n, own) to at most two of (zeros, -logs, node before, place there, n before, own before)
        ways = {first: {(1, begin["own"]): [(begin["zeros"], -begin["logs"], None, 0, None)]}}
        ready, coming = [first], {}
        while ready:
            node = ready.pop()
            for after, (n, logs, zeros, own) in nexts.get(node, ()):
                gathered = coming.setdefault(after, {})
                for state, best in ways[node].items():
                    gathered.setdefault((state[0] + n, state[1] + own), []).extend((z + zeros, w - logs, node, place, state) for place, (z, w, *_) in enumerate(best))
                into[after] -= 1
                if not into[after]:
                    ways[after] = {state: sorted(x, key=lambda y: y[:4])[:2] for state, x in coming.pop(after).items()}
                    ready.append(after)
        out = []
        for state, best in ways[last].items():
            for z, w, node, place, before in best:
                path, at = [exit_], (node, place, before)
                while at[0] is not None:
                    path.append(written[at[0]])
                    at = ways[at[0]][at[2]][at[1]][2:]
                out.append((entry, exit_, path[::-1], state[0], -w, z, state[1]))
        return pd.DataFrame(out, columns=["entry", "exit", "path", "n", "logs", "zeros", "own"])

    return rows.join(size, ["entry", "exit"]).groupBy("entry", "exit").applyInPandas(run, schema)


def _ways_in_rounds(rows: DataFrame, size: DataFrame) -> DataFrame:
    """The same as _ways_in_groups, node by node in topological rounds of joins, for bubbles of any size."""
    by = ["entry", "exit"]
    rows = rows.join(size.select(*by), by, "left_semi").transform(cut)
    into = rows.groupBy(*by, F.col("dst").alias("at")).agg(F.count(F.lit(1)).alias("into"))
    long = [F.col(f"start.{c}").cast("long").alias(c) for c in ("zeros", "own")]
    front = size.select(*by, F.col("entry").alias("at"), F.array("entry").alias("path"), F.lit(1).cast("long").alias("n"), F.col("start.logs").alias("logs"), *long)
    columns = [*by, "at", "path", "n", "logs", "zeros", "own"]
    order = [F.asc("zeros"), F.desc("logs"), F.reverse("path")]
    waiting = came = done = None
    while True:
        step = front.join(rows.select(*by, F.col("src").alias("at"), "dst", *[F.col(c).alias(f"_{c}") for c in ("n", "logs", "zeros", "own")]), [*by, "at"])
        grown = step.select(*by, F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in ("n", "logs", "zeros", "own")]).transform(cut)
        if grown.isEmpty():
            return done.drop("at")
        arrived = front.select(*by, "at").distinct().join(rows.select(*by, F.col("src").alias("at"), "dst"), [*by, "at"]).groupBy(*by, F.col("dst").alias("at")).agg(F.count(F.lit(1)).alias("came"))
        came = arrived if came is None else came.union(arrived).groupBy(*by, "at").agg(F.sum("came").alias("came"))
        came = came.transform(cut)
        waiting = grown if waiting is None else waiting.union(grown)
        full = came.join(into, [*by, "at"]).where("came = into").select(*by, "at")
        ready = waiting.join(full, [*by, "at"], "left_semi").withColumn("_n", F.row_number().over(_window([*by, "at", "n", "own"], order))).where("_n <= 2").select(*columns).transform(cut)
        waiting = waiting.join(full, [*by, "at"], "left_anti").transform(cut)
        came = came.join(full, [*by, "at"], "left_anti").transform(cut)
        ended = ready.where("at = exit")
        done = ended if done is None else done.union(ended)
        front = ready.where("at <> exit").transform(cut)


def path_nodes(best: DataFrame, members: DataFrame, keys: Keys = ()) -> DataFrame:
    """``entry, exit, place, keys, step, offset, node``: the k-mers of best_paths, from the entry's last to the exit's first one."""
    steps = best.select("entry", "exit", "place", F.size("path").alias("_n"), F.posexplode("path").alias("step", "_unit")).select("entry", "exit", "place", "_n", "step", *_parts("_unit", keys))
    sized = members.join(members.groupBy(*keys, "unitig").agg(F.max("offset").alias("_last")), [*keys, "unitig"])
    inner = (F.col("step") > 0) & (F.col("step") < F.col("_n") - 1)
    ends = ((F.col("step") == 0) & (F.col("offset") == F.col("_last"))) | ((F.col("step") == F.col("_n") - 1) & (F.col("offset") == 0))
    return steps.join(sized, [*keys, "unitig"]).where(inner | ends).select("entry", "exit", "place", *keys, "step", "offset", "node")


def simple_paths(edges: DataFrame, pairs: DataFrame, longest: int) -> DataFrame:
    """``start, stop, path``: all simple paths of at most ``longest`` nodes inside between given ends."""
    live = pairs.select("start", "stop", F.col("start").alias("at"), F.array("start").alias("path"))
    done = None
    for _ in range(longest + 1):
        grown = live.join(edges, live["at"] == edges["src"]).where(~F.array_contains("path", F.col("dst")))
        grown = grown.select("start", "stop", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path")).transform(cut)
        arrived = grown.where("at = stop").drop("at")
        done = arrived if done is None else done.union(arrived)
        live = grown.where("at <> stop")
        if live.isEmpty():
            break
    return done


def rank_paths(paths: DataFrame, kmers: DataFrame, n: int = 2) -> DataFrame:
    """The ``n`` best paths between each pair of ends by geometric mean score (missing: 1), with ``value`` and ``place``."""
    keyed = paths.withColumn("_id", F.md5(F.array_join("path", " ")))
    rows = keyed.select("start", "stop", "_id", F.explode("path").alias("node")).withColumn("cn_kmer", S.canonical("node")).join(kmers.select("cn_kmer", "score"), "cn_kmer", "left")
    s = F.coalesce("score", F.lit(1.0))
    value = rows.groupBy("start", "stop", "_id").agg(F.when(F.min(s) <= 0, 0.0).otherwise(F.exp(F.avg(F.log(F.greatest(s, F.lit(1e-300)))))).alias("value"))
    ranked = keyed.join(value, ["start", "stop", "_id"]).withColumn("place", F.row_number().over(_window(["start", "stop"], [F.desc("value"), F.col("_id")])))
    return ranked.where(F.col("place") <= n).drop("_id")


def path_support(paths: DataFrame, read_kmers: DataFrame, key: str, share: float = 0.8) -> DataFrame:
    """``path_id, key``: reads that hold over ``share`` of a path's k-mers. ``paths`` has ``path_id, path``."""
    rows = paths.select("path_id", F.explode("path").alias("node")).select("path_id", S.canonical("node").alias("cn_kmer")).distinct()
    size = rows.groupBy("path_id").agg(F.count(F.lit(1)).alias("n"))
    hits = rows.join(read_kmers.select(key, "cn_kmer").distinct(), "cn_kmer").groupBy("path_id", key).agg(F.count(F.lit(1)).alias("hit"))
    return hits.join(size, "path_id").where(F.col("hit") > share * F.col("n")).select("path_id", key)


# --- walks ----------------------------------------------------------------------------------------------------------


class Walker:
    """Greedy walks over one graph: at a junction, the oldest link in scope whose next choice is still open decides."""

    def __init__(self, kmers: dict[str, int], links: dict[tuple[str, bool], list[str]], k: int):
        self.kmers, self.links, self.k = kmers, links, k

    def _canonical(self, kmer: str) -> str:
        return min(kmer, _rc(kmer))

    def nexts(self, kmer: str) -> list[str]:
        """K-mers after one as written."""
        cn = self._canonical(kmer)
        edges = self.kmers.get(cn, 0)
        out = []
        for i, b in enumerate("ACGT"):
            bit = 16 << i if kmer == cn else 1 << (3 - i)
            if edges & bit:
                out.append(kmer[1:] + b)
        return out

    def forward(self, start: str, stop: set[str] | None = None, most: int | None = None) -> str:
        """Sequence from a k-mer on, to a stop k-mer, an unresolved junction, a repeat without links, or ``most`` steps."""
        contig, at, seen = start, start, {start}
        scope: deque[deque[str]] = deque()
        steps = 0
        while stop is None or at not in stop or at == start:
            cn = self._canonical(at)
            for chosen in self.links.get((cn, at == cn), ()):
                scope.append(deque(chosen))
            after = self.nexts(at)
            if not after or (most is not None and steps >= most):
                break
            if len(after) == 1:
                new = after[0]
            else:
                while scope and not scope[0]:
                    scope.popleft()
                if not scope:
                    break
                base = scope[0][0]
                new = at[1:] + base
                if new not in after:
                    break
                kept: deque[deque[str]] = deque()
                for link in scope:
                    if link and link[0] == base:
                        link.popleft()
                        if link:
                            kept.append(link)
                scope = kept
            if new in seen and not scope:
                break
            seen.add(new)
            contig += new[-1]
            at = new
            steps += 1
        return contig

    def contig(self, seed: str) -> str:
        """Sequence through a k-mer, walked both ways."""
        ahead = self.forward(seed)
        behind = self.forward(_rc(seed))
        return _rc(behind)[: -self.k] + ahead if len(behind) > self.k else ahead


def _rc(s: str) -> str:
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def assemble(kmers: DataFrame, links: DataFrame, seeds: DataFrame, k: int, keys: tuple[str, ...] = ("component",)) -> DataFrame:
    """``keys, seed, contig``: walks with links from each seed, per component."""

    def run(key: tuple, graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        nodes = graph[graph["kind"] == 0]
        if len(nodes) > MAX_COMPONENT:
            raise ValueError("component too large for a walk")
        by_anchor: dict[tuple[str, bool], list[str]] = {}
        for r in graph[graph["kind"] == 1].sort_values(["cn_kmer", "junctions"]).itertuples():
            by_anchor.setdefault((r.cn_kmer, bool(r.fw)), []).append(r.junctions)
        walker = Walker(dict(zip(nodes["cn_kmer"], nodes["edges"].astype(int), strict=True)), by_anchor, k)
        return pd.DataFrame([(*key, s, walker.contig(s)) for s in asked["seed"]], columns=[*keys, "seed", "contig"])

    a = kmers.select(*keys, F.lit(0).alias("kind"), "cn_kmer", "edges", F.lit(True).alias("fw"), F.lit("").alias("junctions"))
    b = links.select(*keys, F.lit(1).alias("kind"), F.col("anchor_kmer").alias("cn_kmer"), F.lit(0).alias("edges"), F.col("is_forward").alias("fw"), "junctions")
    kinds = ", ".join(f"{c} {dict(kmers.dtypes)[c]}" for c in keys)
    return a.union(b).groupBy(*keys).cogroup(seeds.select(*keys, "seed").groupBy(*keys)).applyInPandas(run, f"{kinds}, seed string, contig string")


# --- correction -----------------------------------------------------------------------------------------------------


def _sole_ways(rows: DataFrame, ahead: bool) -> DataFrame:
    """``entry, exit, node``: nodes inside a bubble to which one way leads from its entry (or, not ``ahead``, from which one leads to its exit)."""
    a, b, start, stop = ("src", "dst", "entry", "exit") if ahead else ("dst", "src", "exit", "entry")
    one = rows.groupBy("entry", "exit", b).agg(F.count(F.lit(1)).alias("n"), F.first(a).alias(a)).where(f"n = 1 and {b} <> {stop}").select("entry", "exit", a, b).transform(cut)
    live = one.where(F.col(a) == F.col(start)).select("entry", "exit", F.col(b).alias("node")).transform(cut)
    out = live
    while not live.isEmpty():
        live = one.join(live.withColumnRenamed("node", a), ["entry", "exit", a]).select("entry", "exit", F.col(b).alias("node")).transform(cut)
        out = out.union(live)
    return out


def assemble_at_bubbles(kmers: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """``contig``: walks with links through the first k-mer of each bubble path that no other path of the bubble has, once each."""
    m = unitigs(kmers).transform(cut)
    edges = unitig_edges(kmers, m).transform(cut)
    found, inside = bubbles(edges)
    rows = inside.select("entry", "exit", F.col("node").alias("src")).union(found.select("entry", "exit", F.col("entry").alias("src"))).join(edges, "src").transform(cut)
    own = _sole_ways(rows, True).join(_sole_ways(rows, False), ["entry", "exit", "node"], "left_semi").transform(cut)
    later = own.withColumnRenamed("node", "src").join(rows, ["entry", "exit", "src"]).select("entry", "exit", F.col("dst").alias("node"))
    seeds = own.join(later, ["entry", "exit", "node"], "left_anti").select(F.col("node").alias("seed")).distinct()
    labels = components(edges)
    part = m.join(labels.withColumnRenamed("node", "unitig"), "unitig", "left").select("node", S.canonical("node").alias("cn_kmer"), F.coalesce("component", "unitig").alias("component"))
    # both strands of a k-mer are walked, so a component and its other strand are one
    one = part.groupBy("cn_kmer").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    joined = components(one.where("low <> high").select(F.col("low").alias("src"), F.col("high").alias("dst")))
    named = one.join(joined.withColumnRenamed("node", "low").withColumnRenamed("component", "_c"), "low", "left").select("cn_kmer", F.coalesce("_c", "low").alias("component"))
    graph = kmers.join(named, "cn_kmer")
    linked = links.join(named.withColumnRenamed("cn_kmer", "anchor_kmer"), "anchor_kmer")
    asked = seeds.withColumn("cn_kmer", S.canonical("seed")).join(named, "cn_kmer").select("component", "seed").transform(cut)
    return assemble(graph, linked, asked, k).select(S.canonical("contig").alias("contig")).distinct()


def correct_reads(reads: DataFrame, kmers: DataFrame, k: int, key: str, least: float = 0.1, keys: Keys = ()) -> DataFrame:
    """``keys, key, seq, replaced``: reads whose poor stretches take the best other path of the graph between their ends.

    With ``keys``, a read is corrected in the graph of its own keys. Good k-mers are those of the table with a score of at
    least ``least``. A stretch of a read is what lies between two good k-mers with none between them; it is poor if its
    geometric mean score, ends included and missing k-mers 0, is under ``least``. Ways from one end to the other through good
    k-mers, of at most twice its length and k more, are its alternatives; the one with the most k-mers of the read counts, then
    the best by mean score, then the smallest read from its end. Stretches do not overlap, so a read can have any number of them;
    one without alternatives stays.

    Ways are not listed: of those that reach a unitig with the same number of k-mers only the best goes on, which loses nothing
    where the graph between the ends has no cycle. Where it has, a way never comes back to a unitig.
    """
    by = [*keys, key]
    good = infer_edges(kmers.where(F.coalesce("score", F.lit(0.0)) >= least), keys).transform(cut)
    m = unitigs(good, keys=keys).transform(cut)
    scores = kmers.select(*keys, "cn_kmer", "score")
    # of a read's k-mers only those of the table are rows; where others stand is told by the places left out
    words = oriented(kmers.withColumn("edges", F.lit(0)), keys).join(scores, [*keys, "cn_kmer"]).select(*keys, F.col("node").alias("kmer"), "cn_kmer", "score").join(m.withColumnRenamed("node", "kmer"), [*keys, "kmer"], "left").transform(cut)
    at = (occurrences(reads, k, by).select(*by, "pos", "kmer").join(words, [*keys, "kmer"]) if keys else met(reads, words, k, by)).select(*by, "pos", "cn_kmer", "score", "unitig", "offset").transform(cut)
    poor = _poor_stretches(at, by, least).transform(cut)
    # k-mers of unitigs with running sums of their logs, so that parts of unitigs cost one lookup
    order = Window.partitionBy(*keys, "unitig").orderBy("offset")
    nodes = m.withColumn("cn_kmer", S.canonical("node")).join(scores.select(*keys, "cn_kmer", F.log("score").alias("log")), [*keys, "cn_kmer"]).withColumn("upto", F.sum("log").over(order)).transform(cut)
    size = nodes.groupBy(*keys, "unitig").agg(F.count(F.lit(1)).alias("size"), F.sum("log").alias("logs"))
    # which k-mers of unitigs the reads in question have
    seen = at.join(poor.select(*by).distinct(), by, "left_semi").select(*by, "cn_kmer").distinct()
    hits = seen.join(nodes.select(*keys, "cn_kmer", "unitig", "offset"), [*keys, "cn_kmer"]).select(*by, "unitig", "offset").transform(cut)
    held = hits.groupBy(*by, "unitig").agg(F.count(F.lit(1)).alias("hit")).transform(cut)
    asked = _with_ends(poor, nodes, hits, size, k, by, keys).transform(cut)

    ends = [*by, "a", "z", "uz", "oz", "most", "hit_z", "log_z"]
    edges = unitig_edges(good, m, keys).select(*_parts("src", keys), _parts("dst", keys)[-1].alias("dst")).withColumnRenamed("unitig", "at").join(size.select(*keys, F.col("unitig").alias("dst"), "size", F.col("logs").alias("_logs")), [*keys, "dst"]).transform(cut)
    straight = asked.where("ua = uz and oz > oa").select(*by, "a", "z", "oa", "oz", F.array("ua").alias("path"), F.col("hit_s").alias("hit"), F.col("log_s").alias("logs"), (F.col("oz") - F.col("oa") - 1).cast("long").alias("n"))
    live = asked.where("far <= most").select(*ends, "oa", F.col("ua").alias("at"), F.array("ua").alias("path"), "far", F.col("hit_a").alias("hit"), F.col("log_a").alias("logs"))
    done = straight
    for _ in itertools.count():
        grown = live.join(edges, [*keys, "at"]).where(~F.array_contains("path", F.col("dst"))).withColumn("path", F.concat("path", F.array("dst"))).transform(cut)
        arrived = grown.where("dst = uz and far + oz <= most")
        done = done.union(arrived.select(*by, "a", "z", "oa", "oz", "path", (F.col("hit") + F.col("hit_z")).alias("hit"), (F.col("logs") + F.col("log_z")).alias("logs"), (F.col("far") + F.col("oz")).cast("long").alias("n")))
        onward = grown.where("dst <> uz and far + size <= most").join(held.select(*by, F.col("unitig").alias("dst"), F.col("hit").alias("_hit")), [*by, "dst"], "left")
        onward = onward.select(*ends, "oa", F.col("dst").alias("at"), "path", (F.col("far") + F.col("size")).alias("far"), (F.col("hit") + F.coalesce("_hit", F.lit(0))).alias("hit"), (F.col("logs") + F.col("_logs")).alias("logs"))
        best = F.row_number().over(_window([*by, "a", "at", "far"], [F.desc("hit"), F.desc("logs"), F.reverse("path")]))
        live = onward.withColumn("_n", best).where("_n = 1").drop("_n").transform(cut)
        if live.isEmpty():
            break
    mean = F.when(F.col("n") > 0, F.col("logs") / F.col("n")).otherwise(0.0)
    first = F.row_number().over(_window([*by, "a"], [F.desc("hit"), F.desc("_mean"), F.reverse("path")]))
    chosen = done.withColumn("_mean", mean).withColumn("_n", first).where("_n = 1").select(*by, "a", "z", "oa", "oz", "path").transform(cut)
    steps = chosen.select(*by, "a", "z", "oa", "oz", F.size("path").alias("_n"), F.posexplode("path").alias("step", "unitig")).join(m, [*keys, "unitig"])
    # the base that each k-mer between the ends adds, and the last one's
    after, upto = (F.col("step") > 0) | (F.col("offset") > F.col("oa")), (F.col("step") < F.col("_n") - 1) | (F.col("offset") <= F.col("oz"))
    bases = steps.where(after & upto).groupBy(*by, "a", "z").agg(S.ordered_concat(F.col("step").cast("long") * F.lit(1 << 40) + F.col("offset"), F.right("node", F.lit(1))).alias("bases"))
    return _replaced(reads, bases, k, by)


def _poor_stretches(at: DataFrame, by: list[str], least: float) -> DataFrame:
    """``by, a, z, ua, oa, uz, oz``: places and unitigs of the good k-mers around each poor stretch.

    ``at`` holds the places of the table's k-mers alone; all others score 0.
    """
    w = Window.partitionBy(*by).orderBy("pos")
    good = F.col("unitig").isNotNull()
    ends = at.where(good).select(*by, F.col("pos").alias("a"), F.lead("pos").over(w).alias("z"), F.col("unitig").alias("ua"), F.col("offset").alias("oa"), F.lead("unitig").over(w).alias("uz"), F.lead("offset").over(w).alias("oz"), F.lead("score").over(w).alias("end"))
    inside = at.withColumn("a", F.when(good, F.col("pos")).otherwise(F.max(F.when(good, F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))).where("a is not null")
    s = F.coalesce("score", F.lit(0.0))
    own = inside.groupBy(*by, "a").agg(F.min(s).alias("low"), F.sum(_log(s)).alias("logs"), F.count(F.lit(1)).alias("n"))
    missing = F.col("n") < F.col("z") - F.col("a")
    geo = F.when(missing | (F.col("low") <= 0) | (F.col("end") <= 0), 0.0).otherwise(F.exp((F.col("logs") + F.log("end")) / (F.col("n") + 1)))
    return ends.where("z > a + 1").join(own, [*by, "a"]).where(geo < least).select(*by, "a", "z", "ua", "oa", "uz", "oz")


def _with_ends(poor: DataFrame, nodes: DataFrame, hits: DataFrame, size: DataFrame, k: int, by: list[str], keys: Keys) -> DataFrame:
    """``poor`` with ``most`` and, of the k-mers after its first end (``_a``), before its last (``_z``) and between both (``_s``), how many the read has and their summed logs."""
    at = lambda u, o, name: nodes.select(*keys, F.col("unitig").alias(u), F.col("offset").alias(o), F.col("upto").alias(f"_{name}"), F.col("log").alias(f"_{name}1"))
    rows = poor.join(at("ua", "oa", "x"), [*keys, "ua", "oa"]).join(at("uz", "oz", "y"), [*keys, "uz", "oz"]).join(size.withColumnRenamed("unitig", "ua"), [*keys, "ua"])
    near = lambda u, test: poor.join(hits.withColumnRenamed("unitig", u), [*by, u]).where(test).groupBy(*by, "a").agg(F.count(F.lit(1)).alias("_h"))
    for name, u, test in (("a", "ua", "offset > oa"), ("z", "uz", "offset < oz"), ("s", "ua", "ua = uz and offset > oa and offset < oz")):
        rows = rows.join(near(u, test).withColumnRenamed("_h", f"hit_{name}"), [*by, "a"], "left").na.fill(0, [f"hit_{name}"])
    sums = [(F.col("logs") - F.col("_x")).alias("log_a"), (F.col("_y") - F.col("_y1")).alias("log_z"), (F.col("_y") - F.col("_y1") - F.col("_x")).alias("log_s")]
    return rows.select(*by, "a", "z", "ua", "oa", "uz", "oz", (2 * (F.col("z") - F.col("a")) + k).alias("most"), (F.col("size") - F.col("oa") - 1).cast("long").alias("far"), "hit_a", "hit_z", "hit_s", *sums)


def _replaced(reads: DataFrame, bases: DataFrame, k: int, by: list[str]) -> DataFrame:
    """``by, seq, replaced``: reads with the ``bases`` in place of what follows the k-mer at ``a``, to the end of that at ``z``.

    A read with stretches is cut once, into what stays between them, which is joined with the bases in order.
    """
    w = Window.partitionBy(*by).orderBy("a")
    # what stays runs from the end of the last stretch's last k-mer to the end of this one's first
    kept = bases.withColumn("from", F.coalesce(F.lag("z").over(w) + k, F.lit(0))).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("a", "from", "z", "bases"))).alias("fixes")
    )
    none = F.array().cast("array<struct<a:int,from:int,z:int,bases:string>>")
    joined = reads.join(kept, by, "left").withColumn("fixes", F.coalesce("fixes", none))
    parts = F.transform("fixes", lambda f: F.concat(F.substring("seq", f["from"] + 1, f["a"] + k - f["from"]), f["bases"]))
    rest = F.coalesce(F.element_at("fixes", -1)["z"] + k, F.lit(0))
    fixed = F.when(F.size("fixes") > 0, F.concat(F.array_join(parts, ""), F.substring("seq", rest + 1, F.length("seq")))).otherwise(F.col("seq"))
    return joined.select(*by, fixed.alias("seq"), F.size("fixes").alias("replaced"))
