"""Column alignment, orientation, windows with graphs of their own, and two haplotypes of several loci."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import alignment as L
from strandline.operators import coassembly as C
from strandline.operators import graph as G
from strandline.operators import kmers as K

K_SIZE = 15


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


def _genome(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def _flip(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def _put(s, at):
    return s[:at] + "ACGT"[("ACGT".index(s[at]) + 1) % 4] + s[at + 1 :]


def _value(pairs, a, b):
    return sum(L.GAP if p < 0 or q < 0 else L.MATCH if a[p] == b[q] else L.MISMATCH for p, q in pairs)


def _best(a, b):
    row = [L.GAP * j for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [L.GAP * (i + 1)]
        for j, y in enumerate(b):
            new.append(max(row[j] + (L.MATCH if x == y else L.MISMATCH), row[j + 1] + L.GAP, new[-1] + L.GAP))
        row = new
    return row[-1]


def test_alignments_are_whole_and_best():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randint(0, 14))) for _ in range(2))
        for start, end in itertools.product((False, True), repeat=2):
            pairs = L.aligned(a, b, start, end)
            assert [p for p, _ in pairs if p >= 0] == list(range(len(a))) and [q for _, q in pairs if q >= 0] == list(range(len(b)))
            # free are the bases of one side alone with which the pairs begin, or end
            inner = pairs
            if start and inner and min(inner[0]) < 0:
                inner = list(itertools.dropwhile(lambda x: x.index(-1) == inner[0].index(-1) if -1 in x else False, pairs))
            if end and inner and min(inner[-1]) < 0:
                side = inner[-1].index(-1)
                while inner and -1 in inner[-1] and inner[-1].index(-1) == side:
                    inner = inner[:-1]
            if not start and not end:
                assert _value(pairs, a, b) == _best(a, b)
            else:  # no cut of either side at the free ends does better
                best = max(_best(a[i:x], b[j:y]) for i in range(len(a) + 1 if start else 1) for j in range(len(b) + 1 if start else 1) if not (i and j) for x in (range(i, len(a) + 1) if end else [len(a)]) for y in (range(j, len(b) + 1) if end else [len(b)]) if x == len(a) or y == len(b))
                assert _value(inner, a, b) == best


def test_chained_words_are_the_longest_ascending_ones():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ("".join(rng.choice("AC") for _ in range(rng.randint(5, 22))) for _ in range(2))
        k = 4
        once = lambda s: {s[i : i + k]: i for i in range(len(s) - k + 1) if [s[j : j + k] for j in range(len(s) - k + 1)].count(s[i : i + k]) == 1}
        x, y = once(a), once(b)
        pairs = sorted((i, y[w]) for w, i in x.items() if w in y)
        best = [1] * len(pairs)
        for n, m in itertools.combinations(range(len(pairs)), 2):
            if pairs[n][1] < pairs[m][1]:
                best[m] = max(best[m], best[n] + 1)
        got = L.chained(a, b, k)
        assert len(got) == max(best, default=0) and set(got) <= set(pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(got))


def test_columns_spell_the_read():
    rng = random.Random(3)
    for n in range(40):
        spine = _genome(n, 400)
        read = list(spine)
        for at in rng.sample(range(30, 370), 12):
            read[at] = rng.choice(["", "A", "C", "GT", read[at] + "TTT"])
        lead, tail = _genome(n + 100, rng.choice([0, 9])), _genome(n + 200, rng.choice([0, 40]))
        read = lead + "".join(read) + tail
        shown = L.columns(read, spine)
        assert "".join(s for _, s in shown).replace("-", "") == read
        assert [q for q, _ in shown] == list(range(-1 if lead else 0, 400))
        # most places show the spine's own base
        assert sum(s == spine[q] for q, s in shown if 0 <= q < 399) > 370


def test_orientation_follows_the_read_before(spark):
    g = _genome(4, 600)
    rng = random.Random(4)
    parts = {("l", i): g[a : a + n] for i, (a, n) in enumerate([(0, 500), (20, 480), (100, 450), (60, 440), (150, 430), (10, 300)])}
    parts |= {("m", i): s for i, s in enumerate([_genome(5, 200), _genome(6, 150), _genome(6, 150)[:140]])}
    flips = {p: rng.random() < 0.5 for p in parts}
    rows = [(*p, _flip(s) if flips[p] else s) for p, s in parts.items()]
    got = {(r.locus, r.id): r.seq for r in L.orient(spark.createDataFrame(rows, "locus string, id int, seq string"), ["locus"], "id").collect()}
    given = {(a, b): s for a, b, s in rows}

    def shared(a, b):
        words = {b[i : i + 17] for i in range(len(b) - 16)}
        return sum(a[i : i + 17] in words for i in range(len(a) - 16))

    for locus in "lm":
        last = None
        for p in sorted((p for p in given if p[0] == locus), key=lambda p: (-len(given[p]), p)):
            s = given[p]
            want = s if last is None or shared(s, last) > shared(_flip(s), last) else _flip(s)
            assert got[p] == want
            last = want
    assert len({got["l", i] in g or _flip(got["l", i]) in g for i in range(6)}) == 1


def test_consensus_of_reads_with_errors(spark):
    """Reads with substitutions, insertions and deletions that tile two loci; the backbone has errors of its own."""
    truth = {"l": _genome(7, 900), "m": _genome(8, 500)}
    rng = random.Random(7)
    rows = []
    for locus, g in truth.items():
        spans = [(0, 700), (100, len(g)), (0, len(g) - 60), (50, len(g)), (200, len(g)), (0, 450), (0, len(g) - 200), (120, len(g))]
        for i, (a, z) in enumerate(spans):
            s = list(g[a:z])
            for at in rng.sample(range(40, len(s) - 40), 5):
                s[at] = rng.choice(["", s[at] + "A", "ACGT"[("ACGT".index(s[at]) + 1) % 4]])
            rows.append((locus, i, "".join(s)))
    got = {r.locus: r.seq for r in L.consensus(spark.createDataFrame(rows, "locus string, id int, seq string"), ["locus"], "id").collect()}
    assert got == truth


def test_windows_keep_their_own_variants(spark):
    """Two windows hold the same stretch with contradicting bases; each is corrected to its own, as in no graph of both."""
    core = _genome(9, 120)
    a, b = core, _put(core, 60)
    left, right = [(_genome(s, 60), _genome(s + 50, 60)) for s in (10, 11)]
    truth = {0: left[0] + a + left[1], 1: right[0] + b + right[1]}
    # one of four reads has the other window's base, which is an error there
    wrong = {0: left[0] + b + left[1], 1: right[0] + a + right[1]}
    pieces = [("l", t, f"r{i}", wrong[t] if i == 3 else truth[t]) for t in (0, 1) for i in range(4)]
    frame = spark.createDataFrame(pieces, "locus string, tile int, read string, seq string")
    # short reads lie beside the stretch that both windows have
    shorts = spark.createDataFrame([(100 * t + i, x) for t, pair in ((0, left), (1, right)) for i, x in enumerate(pair)], "s int, seq string")
    near = K.recruit_distinct(shorts, frame, K_SIZE, "s", ("locus", "tile"))
    assert {(r.tile, r.s) for r in near.collect()} == {(t, 100 * t + i) for t in (0, 1) for i in (0, 1)}
    seen_twice = F.when(F.col("cov") >= 2, 0.9).otherwise(0.01)
    table = C.scored_graph(frame, near.join(shorts, "s"), K_SIZE, threshold=None, keys=("locus", "tile")).withColumn("score", seen_twice)
    fixed = {(r.tile, r.read): (r.seq, r.replaced) for r in G.correct_reads(frame, table, K_SIZE, "read", keys=("locus", "tile")).collect()}
    assert fixed == {(t, f"r{i}"): (truth[t], int(i == 3)) for t in (0, 1) for i in range(4)}
    # one graph of both windows knows both variants and corrects nothing
    pooled = frame.select("seq", F.concat("read", "tile").alias("read"))
    both = C.scored_graph(pooled, shorts, K_SIZE, threshold=None).withColumn("score", seen_twice)
    assert {r.replaced for r in G.correct_reads(pooled, both, K_SIZE, "read").collect()} == {0}
    # cleaning, too, works on each graph alone
    cleaned = G.clean(table, K_SIZE, 0.1, keys=("locus", "tile"))
    for t in (0, 1):
        want = {min(x, _flip(x)) for i in range(len(truth[t]) - K_SIZE + 1) for x in [truth[t][i : i + K_SIZE]]}
        assert {r.cn_kmer for r in cleaned.where(F.col("tile") == t).collect()} == want


def test_two_haplotypes_of_two_loci(spark):
    """Substitutions and insertions or deletions tell the haplotypes apart; reads come from either strand, with errors."""
    rows, truth = [], {}
    rng = random.Random(13)
    for locus, seed in (("l", 14), ("m", 15)):
        one = _genome(seed, 420)
        two = _put(one[:110] + "GATTACA" + one[110:], 60)
        two = two[:250] + two[253:]
        two = _put(two, 340)
        truth[locus] = {one, two}
        for i in range(8):
            s = (one, two)[i % 2]
            if i >= 6:
                s = _put(s, rng.choice([30, 200, 390]))
            rows.append((locus, i, _flip(s) if rng.random() < 0.5 else s))
    longs = spark.createDataFrame(rows, "locus string, id int, seq string")
    shorts = longs.where("id < 6").select("locus", F.col("id").alias("s"), "seq")
    got = {}
    for r in C.co_assemble(longs, shorts, K_SIZE, "id", threshold=None, least=100).collect():
        got.setdefault(r.locus, []).append(min(r.seq, _flip(r.seq)))
    assert {x: sorted(y) for x, y in got.items()} == {x: sorted(min(s, _flip(s)) for s in y) for x, y in truth.items()}


def test_consensus_of_reads_over_loci(spark):
    g = _genome(16, 700)
    rng = random.Random(16)
    rows = []
    for i, (a, z) in enumerate([(0, 300), (20, 320), (10, 310), (350, 690), (360, 700), (340, 680), (400, 700)]):
        s = _put(g[a:z], rng.randint(60, z - a - 60))
        rows.append((f"r{i}", "c", a, f"{z - a}M", s))
    rows += [("r0", "c", 500, "300M", None), ("far", "d", 0, "200M", _genome(17, 200)), ("un", None, None, None, "ACGT")]
    aln = spark.createDataFrame(rows, "qname string, contig string, pos long, cigar string, seq string")
    loci = spark.createDataFrame([("one", "c", 100, 150), ("two", "c", 450, 460), ("none", "e", 0, 9)], "name string, contig string, start long, stop long")
    got = {r.name: r.seq for r in L.locus_consensus(aln, loci, "qname", "name").collect()}
    assert got == {"one": g[:320], "two": g[340:700]}
