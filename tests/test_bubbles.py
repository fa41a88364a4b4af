"""Superbubbles by joins against their definition, and best ways against enumeration."""

import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from strandline.operators import graph as G


@pytest.fixture(autouse=True)
def small_plans(spark):
    """One job a step: these chains are many steps over few rows."""
    small = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in small}
    for name, value in small.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def _bubbles(edges):
    """(entry, exit): nodes inside, by definition: what the entry reaches short of the exit is what reaches the exit short of the entry, without a cycle, and no nearer exit will do."""
    nodes = {x for e in edges for x in e}
    ahead = {x: {b for a, b in edges if a == x} for x in nodes}
    behind = {x: {a for a, b in edges if b == x} for x in nodes}

    def reach(start, stop, near):
        seen, todo = {start}, [start]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                if y != stop:
                    todo.append(y)
        return seen

    def cyclic(inside):
        left = {x: len(behind[x] & inside) for x in inside}
        ready = [x for x in inside if not left[x]]
        n = 0
        while ready:
            n += 1
            for y in ahead[ready.pop()] & inside:
                left[y] -= 1
                if not left[y]:
                    ready.append(y)
        return n < len(inside)

    good = {}
    for s, t in itertools.permutations(nodes, 2):
        u = reach(s, t, ahead)
        if t in u and u == reach(t, s, behind) and not cyclic(u):
            good[s, t] = u - {s, t}
    least = {(s, t): u for (s, t), u in good.items() if not any((s, x) in good for x in u)}
    return {p: u for p, u in least.items() if u}


def _random_graph(rng):
    n = rng.randint(5, 16)
    edges = set()
    for _ in range(rng.randint(n, 2 * n)):
        a, b = rng.sample(range(n), 2)
        edges.add((min(a, b), max(a, b)) if rng.random() < 0.93 else (a, b))
    return edges


def _nested(rng, depth):
    """A chain of bubbles with bubbles in them."""
    edges, names = set(), itertools.count()

    def build(depth):
        s = t = next(names)
        for _ in range(rng.randint(1, 2)):
            s2, t = t, next(names)
            for _ in range(rng.randint(2, 3)):
                if depth and rng.random() < 0.7:
                    a, b = build(depth - 1)
                else:
                    a = b = next(names)
                edges.update({(s2, a), (b, t)})
        return s, t

    build(depth)
    return edges


def test_bubbles_of_random_and_nested_graphs(spark):
    rng = random.Random(5)
    graphs = [_random_graph(rng) for _ in range(30)] + [_nested(rng, 2) for _ in range(4)]
    want, inner = {}, {}
    for g, edges in enumerate(graphs):
        found = _bubbles(edges)
        for (s, t), u in found.items():
            held = any({s, t} <= v | {a, b} and len(v) > len(u) for (a, b), v in found.items())
            want[f"{g}|{s}", f"{g}|{t}"] = (len(u), held)
            inner[f"{g}|{s}", f"{g}|{t}"] = {f"{g}|{x}" for x in u}
    frame = spark.createDataFrame([(f"{g}|{a}", f"{g}|{b}") for g, edges in enumerate(graphs) for a, b in edges], "src string, dst string")
    for largest, limit in ((0, 2), (G.MAX_COMPONENT, 4)):
        found, inside = G.bubbles(frame, largest, limit)
        assert {(r.entry, r.exit): (r.interior, r.is_nested) for r in found.collect()} == want
        got = {}
        for r in inside.collect():
            got.setdefault((r.entry, r.exit), set()).add(r.node)
        assert got == inner
    assert len(want) > 25 and sum(x[1] for x in want.values()) > 5


def test_sequential_search_finds_the_same():
    """The definition above against a plain walk in the way of the algorithm, so that the test itself is tested."""
    edges = {("s", "a"), ("s", "b"), ("a", "t"), ("b", "t"), ("t", "c"), ("t", "d"), ("c", "e"), ("c", "f"), ("e", "g"), ("f", "g"), ("g", "u"), ("d", "u")}
    assert _bubbles(edges) == {("s", "t"): {"a", "b"}, ("t", "u"): set("cdefg"), ("c", "g"): {"e", "f"}}


def test_one_long_component(spark):
    """A chain of 20,000 bubbles is one component; none of it is gathered."""
    n = 20_000
    base = spark.range(n).withColumn("i", F.col("id"))
    step = base.select(F.explode(F.array(*[F.struct(a.alias("src"), b.alias("dst")) for a, b in ((3 * F.col("i"), 3 * F.col("i") + 1), (3 * F.col("i"), 3 * F.col("i") + 2), (3 * F.col("i") + 1, 3 * F.col("i") + 3), (3 * F.col("i") + 2, 3 * F.col("i") + 3))])).alias("e")).select("e.*")
    found = G.bubbles(step, 1_000)[0]
    assert found.where("interior = 2 and exit = entry + 3 and not is_nested").count() == n == found.count()


def _ways(edges, entry, exit_, value):
    """All paths as (path, n, logs, zeros, own)."""
    out, todo = [], [((entry,), (1, 0.0, 0, 0))]
    while todo:
        path, total = todo.pop()
        if path[-1] == exit_:
            out.append((path, *total))
            continue
        for a, b in edges:
            if a == path[-1]:
                todo.append(((*path, b), tuple(x + y for x, y in zip(total, value[b], strict=True))))
    return out


def _best(ways):
    def rank(w):
        path, n, logs, zeros, own = w
        worth = 0.0 if zeros or own / n > 0.5 else math.exp(logs / n)
        return (-worth, zeros, -logs / n, path[::-1]), worth

    return [(w[0], w[1], rank(w)[1]) for w in sorted(ways, key=lambda w: rank(w)[0])[:2]]


def _frames(spark, graphs):
    rows = [(f"{g}s", f"{g}t", f"{g}{a}", f"{g}{b}", *value[b]) for g, (edges, value) in graphs.items() for a, b in edges]
    frame = spark.createDataFrame(rows, "entry string, exit string, src string, dst string, n long, logs double, zeros int, own int")
    start = spark.createDataFrame([(f"{g}s", f"{g}t", (0.0, 0, 0)) for g in graphs], "entry string, exit string, start struct<logs:double,zeros:int,own:int>")
    return frame, start


def test_best_ways_equal_enumeration(spark):
    rng = random.Random(9)
    graphs = {}
    for g in range(40):
        layers = [["s"], *[[f"n{i}{j}" for j in range(rng.randint(1, 3))] for i in range(rng.randint(1, 4))], ["t"]]
        edges = {(a, b) for x, y in itertools.pairwise(layers) for a in x for b in y if rng.random() < 0.8 or a == x[0] or b == y[0]}
        edges |= {(layers[0][0], layers[-1][0])} if rng.random() < 0.3 else set()
        edges |= {(a, "t") for x in layers[1:-1] for a in x if rng.random() < 0.2}
        nodes = {x for e in edges for x in e}
        # logarithms are whole numbers, so that sums are exact and ties real
        value = {x: (rng.choice([1, 2, 5]), -float(rng.randint(0, 3)), int(rng.random() < 0.1), 0) for x in nodes}
        value = {x: (*v[:3], rng.randint(0, v[0])) for x, v in value.items()}
        graphs[f"g{g}_"] = (edges, value)
    frame, start = _frames(spark, graphs)
    want = {}
    for g, (edges, value) in graphs.items():
        for place, (path, n, worth) in enumerate(_best(_ways(edges, "s", "t", value)), 1):
            want[f"{g}s", place] = ([f"{g}{x}" for x in path], n, pytest.approx(worth))
    for largest in (G.BUBBLE, 0):
        got = {(r.entry, r.place): (r.path, r.n, r.value) for r in G.ranked_ways(frame, start, largest).collect()}
        assert got == want


def test_a_ladder_of_two_hundred_rungs(spark):
    """Two rails with a crossing at every rung: 2 to the power 200 ways."""
    n = 200
    edges = {("s", f"r0a"), ("s", "r0b"), (f"r{n - 1}a", "t"), (f"r{n - 1}b", "t")}
    edges |= {(f"r{i}{x}", f"r{i + 1}{y}") for i in range(n - 1) for x in "ab" for y in "ab"}
    rng = random.Random(2)
    good = [rng.choice("ab") for _ in range(n)]
    value = {f"r{i}{x}": (1, 0.0 if x == good[i] else -1.0 - (i == 77) * -0.5, 0, int(x != good[i])) for i in range(n) for x in "ab"} | {"t": (1, 0.0, 0, 0)}
    frame, start = _frames(spark, {"": (edges, value)})
    began = time.perf_counter()
    got = {r.place: (r.path, r.n, r.value) for r in G.ranked_ways(frame, start).collect()}
    assert time.perf_counter() - began < 20
    first = ["s", *[f"r{i}{x}" for i, x in enumerate(good)], "t"]
    second = [*first[:78], f"r77{'ab'[good[77] == 'a']}", *first[79:]]
    assert got == {1: (first, 202, 1.0), 2: (second, 202, pytest.approx(math.exp(-0.5 / 202)))}
