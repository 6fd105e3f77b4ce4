"""Overlap removal by passes: sweeps in ranges, lists in windows and projections in parts give what one array gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_large import RECT, arrays, some_rects

from gridloom.functions import rectangles as R
from gridloom.operators import overlap as O
from gridloom.operators import projection as Q


@pytest.mark.parametrize("seed", range(20))
def test_windows_and_ranges_see_what_arrays_see(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(2, 400))
    x, y, w, h = r.integers(0, 200, n) / 2, r.integers(0, 30, n) / 2, r.choice([0, 0.25, 1, 3, 8], n), r.choice([0, 0.25, 1, 5], n)
    o = np.lexsort((np.arange(n), x + w / 2))
    box, w = np.stack([x, x + w, y, y + h], 1)[o], w[o]
    c, ids = (box[:, 0] + box[:, 1]) / 2, np.arange(n)
    pairs = lambda a, b: sorted(zip(np.asarray(a).tolist(), np.asarray(b).tolist()))
    left, right, _ = O.listed(box, c, w, box[:, 2] + box[:, 3], True)
    assert pairs(left, right) == pairs(*O.nearest_apart(box[:, 2], box[:, 3], box[:, 0], box[:, 1], n, n)[:2])
    lo, hi = box[:, 2], box[:, 3]
    part = np.empty(n, int)
    part[np.lexsort((ids, hi))] = np.arange(n) // 30
    got = []
    for at in range(part.max() + 1):
        here = np.flatnonzero((part == at) | ((part > at) & (lo <= hi[part == at].max())))
        a, b = O.closed(lo[here], hi[here], c[here], here, np.flatnonzero(part[here] == at))
        got += pairs(here[a], here[b])
    assert sorted(got) == pairs(*O.sweep(lo, hi, c, w)[:2])


@pytest.mark.parametrize("few,crowded", [(0, 0), (1000, 8)])
def test_lists_and_sweeps_of_large_groups_with_and_without_trees(spark, monkeypatch, few, crowded):
    rows = [(*x[:6], 0.25, 0.5) for x in some_rects(4, groups=2)]
    df = spark.createDataFrame(rows, RECT)
    show = lambda d: sorted(map(tuple, d.select("group_id", "left", "right", F.round("gap", 6)).collect()))
    want = show(O.neighbour_constraints(df))
    for name, value in (("CHUNK", 3), ("FEW", few), ("SWEPT", 10), ("CROWDED", crowded)):
        monkeypatch.setattr(O, name, value)
    assert want == show(O.neighbour_constraints(df, small=0))
    swept = []
    for g in range(2):
        ids, b = arrays(rows, g)
        b = b + np.array([-0.25, 0.25, -0.5, 0.5])
        left, right, gap = O.sweep(b[:, 2], b[:, 3], (b[:, 0] + b[:, 1]) / 2, b[:, 1] - b[:, 0])
        swept += [(g, int(ids[i]), int(ids[j]), round(float(v), 6)) for i, j, v in zip(left, right, gap)]
    assert sorted(swept) == show(O.sweep_constraints(df, R.X))


def test_a_connected_part_is_solved_in_parts(spark):
    """One connected problem of 400 variables in parts of 20, and a second one with the same ids."""
    r = np.random.default_rng(1)
    n = 400
    lo, c = r.random(n) * 300, r.random(n) * 100
    left, right, gap = O.sweep(lo, lo + 25, c, np.full(n, 5.0))
    assert not Q._parts(n, left, right).any()
    part = np.argsort(np.argsort(lo)) // 20
    v = spark.createDataFrame([(p, i, float(c[i]) + p, 1.0, int(part[i])) for p in (1, 2) for i in range(n)], "problem_id long, var_id long, desired double, weight double, part long")
    rules = spark.createDataFrame([(p, *map(int, e), float(g)) for p in (1, 2) for *e, g in zip(left, right, gap)], "problem_id long, left long, right long, gap double")
    want = Q.solve_forward(c, np.ones(n), left, right, gap)
    got = {(x.problem_id, x.var_id): x.position for x in Q.project_forward(v, rules).collect()}
    assert len(got) == 2 * n and all(abs(got[p, i] - want[i] - p) < 1e-6 for p, i in got)


def test_equal_centres_go_by_their_ids(spark):
    """Borders must not part them by rounding (before: others were next to each other than without)."""
    sizes = [(1.0, 1.0), (1.0, 0.5), (1.0, 1.0)]
    rows = [(0, i, float(i), float(i + 9), y - h, y + h, 0.0, 0.0005) for i, (y, h) in enumerate(sizes)]
    _, b = arrays(rows, 0)
    left, right, _ = O.sweep(b[:, 0], b[:, 1], (b[:, 2] + b[:, 3]) / 2, b[:, 3] - b[:, 2])
    got = O.sweep_constraints(spark.createDataFrame(rows, RECT), R.Y).select("left", "right").collect()
    assert sorted(map(tuple, got)) == sorted(zip(left.tolist(), right.tolist()))
