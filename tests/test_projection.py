"""Separation projections, sweeps, clusters and grids beyond what the registered queries show."""

import random

import numpy as np
import pytest

from gridloom.functions import rectangles as R
from gridloom.operators import clusters as C
from gridloom.operators import overlap as O
from gridloom.operators import placement as P
from gridloom.operators import projection as Q
from gridloom.plans.cut import numbered


@pytest.mark.parametrize("seed", range(20))
def test_paths_have_the_optimum_of_the_active_set(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(2, 12))
    order = r.permutation(n)
    links = [(order[i], order[i + 1]) for i in range(n - 1) if r.random() < 0.8]
    left, right = (np.array([x[k] for x in links], int) for k in (0, 1))
    desired, weight, gap, equal = r.normal(0, 5, n), r.uniform(0.5, 3, n), r.uniform(-1, 4, len(links)), r.random(len(links)) < 0.3
    x, on, dead = Q.solve_separation(desired, weight, np.ones(n), left, right, gap, equal)
    y, _, _ = Q.active_set(desired, weight, np.ones(n), left, right, gap, equal)
    assert np.allclose(x, y, atol=1e-6) and not dead.any()
    assert (x[right] - x[left] - gap >= -1e-9).all() and np.allclose((x[right] - x[left] - gap)[equal], 0)


def test_cycles_and_contradictions_are_named():
    one, no = np.ones(3), np.zeros(3, bool)
    left, right = np.array([0, 1, 2]), np.array([1, 2, 0])
    x, _, dead = Q.solve_separation(np.zeros(3), one, one, left, right, one, no)
    assert dead.sum() == 1
    x, _, dead = Q.solve_separation(np.array([0.0, 9.0]), np.ones(2), np.ones(2), np.array([0, 0]), np.array([1, 1]), np.array([2.0, 3.0]), np.ones(2, bool))
    assert dead.tolist() == [False, True] and np.isclose(x[1] - x[0], 2)


def test_chains_are_pooled_in_segments(spark):
    r = random.Random(3)
    rows = [(p, i, r.uniform(0, 30), r.uniform(0.5, 2), 1.0) for p in (1, 2) for i in range(200)]
    v = spark.createDataFrame(rows, "problem_id long, var_id long, desired double, weight double, scale double")
    whole, cut = ({(x.problem_id, x.var_id): x.position for x in Q.chain_projection(v, 1.5, segment=s).collect()} for s in (1000, 7))
    assert whole.keys() == cut.keys() and all(abs(whole[k] - cut[k]) < 1e-9 for k in whole)
    for p in (1, 2):
        d, w = (np.array([x[k] for x in rows if x[0] == p]) for k in (2, 3))
        want, _, _ = Q.active_set(d, w, np.ones(200), np.arange(199), np.arange(1, 200), np.full(199, 1.5), np.zeros(199, bool))
        assert np.allclose([whole[p, i] for i in range(200)], want, atol=1e-6)


def test_a_problem_without_variables_or_constraints(spark):
    v = spark.createDataFrame([(1, 0, 3.0, 1.0, 1.0)], "problem_id long, var_id long, desired double, weight double, scale double")
    c = spark.createDataFrame([(2, 0, 0, 1, 1.0, True)], "problem_id long, c_id long, left long, right long, gap double, equality boolean")
    assert [(x.problem_id, x.position, x.unsatisfied) for x in Q.project(v, c).collect()] == [(1, 3.0, 0)]
    assert Q.unsatisfiable(v, c).count() == 0 and Q.project(v.limit(0), c).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_no_overlap_is_left(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(2, 25))
    x, y, w, h = r.uniform(0, 30, n), r.uniform(0, 30, n), r.uniform(1, 9, n), r.uniform(1, 9, n)
    box = np.stack([x - w / 2, x + w / 2, y - h / 2, y + h / 2], 1)
    for third in (False, True):
        out = O.separated(box, np.ones(n), third_pass=third)
        assert np.allclose(out[:, 1] - out[:, 0], w) and np.allclose(out[:, 3] - out[:, 2], h)
        for i in range(n):
            for j in range(i):
                assert out[i, 1] <= out[j, 0] + 1e-7 or out[j, 1] <= out[i, 0] + 1e-7 or out[i, 3] <= out[j, 2] + 1e-7 or out[j, 3] <= out[i, 2] + 1e-7
    held = O.separated(box, np.where(np.arange(n) == 0, O.FIXED_WEIGHT, 1.0))
    assert abs(held[0, 0] - box[0, 0]) + abs(held[0, 2] - box[0, 2]) < 0.05


def test_boxes_of_very_different_sizes_meet(spark):
    r = random.Random(5)
    rows = [(g, i, (x := r.uniform(-50, 50)), x + r.choice((0.0, 0.5, 4.0, 300.0)), (y := r.uniform(-50, 50)), y + r.choice((0.0, 1.0, 90.0))) for g in (0, 1) for i in range(60)]
    b = spark.createDataFrame(rows, "group_id long, id long, lo_x double, hi_x double, lo_y double, hi_y double")
    got = sorted((x.group_id, x.a_id, x.b_id) for x in R.meeting_boxes(b, b).collect())
    want = sorted((p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[2] <= q[3] and q[2] <= p[3] and p[4] <= q[5] and q[4] <= p[5])
    assert got == want


def test_a_circle_of_clusters_is_an_error(spark):
    tree = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "cluster_id long, parent_id long")
    with pytest.raises(ValueError):
        C.closure(tree)


def test_deep_trees_have_all_their_levels(spark):
    n = 70
    tree = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)], "cluster_id long, parent_id long")
    members = spark.createDataFrame([(n - 1, 0.0, 1.0, 0.0, 1.0)], "cluster_id long, min_x double, max_x double, min_y double, max_y double")
    got = {x.cluster_id: x.min_x for x in C.bounds(tree, members, padding=1).collect()}
    assert got == {i: -float(n - i) for i in range(n)}


def test_rows_are_numbered_over_ranges(spark):
    df = spark.createDataFrame([(7 * k % 101,) for k in range(101)], "k long")
    assert sorted((x.k, x["rank"]) for x in numbered(df, "k").collect()) == [(i, i) for i in range(101)]


def test_feasible_positions_without_overlaps(spark):
    nodes = spark.createDataFrame([(1, i, float(i), 0.0, 0.0, 4.0, 2.0) for i in range(4)], "graph_id long, node_id long, x double, y double, z double, w double, h double")
    rules = spark.createDataFrame([(1, 1, 0, 1, 0.0, True, 1, 1)], "problem_id long, dim int, left long, right long, gap double, equality boolean, priority int, cc_id int")
    out = {x.node_id: x for x in P.make_feasible(nodes, rules, avoid_overlaps=True).collect()}
    for i in out:
        for j in range(i):
            assert abs(out[i].x - out[j].x) >= 4 - 1e-6 or abs(out[i].y - out[j].y) >= 2 - 1e-6


def test_short_chains_are_pooled_many_at_a_time(spark, monkeypatch):
    """Values fall at the borders of chains, and none is pooled over them."""
    rows = [(p, i, float((i * 7 + p) % 5 - 3 * p), 1.0 + i % 2) for p in range(40) for i in range(6)]
    df = spark.createDataFrame(rows, "problem_id long, var_id long, desired double, weight double")
    calls, one = spark.sparkContext.accumulator(0), Q.pooled
    monkeypatch.setattr(Q, "pooled", lambda *a: (calls.add(1), one(*a))[1])
    got = {(r.problem_id, r.var_id): r.position for r in Q.chain_projection(df, 1.0).collect()}
    assert calls.value <= 8
    for p in range(40):
        own = np.array([r[2:] for r in rows if r[0] == p])
        mean, count = one(own[:, 0] - np.arange(6), own[:, 1])
        assert np.allclose([got[p, i] for i in range(6)], np.repeat(mean, count) + np.arange(6))
