import random

import pytest

from strandline.operators import phasing as P


def folded(rows):
    """Windows in order: each is turned to agree with what stands, and adds the sites that do not."""
    out = {}
    for locus in {r[0] for r in rows}:
        standing = {}
        for window in sorted({r[1] for r in rows if r[0] == locus}):
            part = [(site, h) for place, w, site, h in rows if (place, w) == (locus, window)]
            same = sum(1 if standing[s] == h else -1 for s, h in part if s in standing)
            for s, h in part:
                standing.setdefault(s, 1 - h if same < 0 else h)
        out |= {(locus, s): h for s, h in standing.items()}
    return out


@pytest.mark.parametrize(("length", "stride", "block"), [(20, 5, 4), (12, 5, 1), (20, 2, 4), (6, 6, 3)])
def test_stitching_equals_a_fold(spark, length, stride, block):
    rng = random.Random(length * stride)
    # windows without rows, and sites that some windows lack, as reads do not cover all
    rows = [(locus, w, s, rng.randrange(2)) for locus in (1, 2, 3) for w in range(40 * locus) if rng.random() < 0.9 for s in range(w * stride, w * stride + length) if rng.random() < 0.7]
    frame = spark.createDataFrame(rows, "locus long, window int, site long, h1 int")
    got = P.stitch(frame, -(-length // stride) - 1, block).collect()
    assert {(r.locus, r.site): r.h1 for r in got} == folded(rows) and all(r.h1 + r.h2 == 1 for r in got)
    assert P.stitch(frame.limit(0), 3, block).count() == 0


def test_windows_of_cells(spark):
    rows = [(locus, 1, 10 * s, 0, 1) for locus, n in ((5, 3), (7, 23), (9, 40)) for s in range(n)]
    cells = spark.createDataFrame(rows, "locus long, read long, site long, allele int, weight int")
    got = sorted((r.locus, r.window, r.rank) for r in P.windowed_cells(cells, 20, 5).select("locus", "window", "rank").collect())
    wins = {(r.locus, r.window): (r.first, r.last) for r in P.site_windows(cells, 20, 5).collect()}
    assert got == sorted((locus, w, i) for (locus, w), (a, b) in wins.items() for i in range(a, b))
