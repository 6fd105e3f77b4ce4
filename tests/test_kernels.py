"""Kernels against optimality conditions and invariants."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.operators.layout import LayoutSession
from gridloom.operators.overlap import separated
from gridloom.operators.projection import solve_separation
from gridloom.operators.quadratic import gradient_projection, minimise


def solve(desired, weight, rules):
    cols = [np.array([r[i] for r in rules], t) for i, t in ((0, int), (1, int), (2, float), (3, bool))]
    return solve_separation(np.array(desired, float), np.array(weight, float), np.ones(len(desired)), *cols)


@pytest.mark.parametrize(
    "desired, weight, rules, want",
    [
        ([0, 0], [1, 1], [(0, 1, 10, False)], [-5, 5]),
        ([0, 0], [10, 1], [(0, 1, 10, False)], [-10 / 11, 100 / 11]),
        ([0, 10], [1, 1], [(0, 1, 5, True)], [2.5, 7.5]),
        ([0] * 20, [1] * 20, [(i, i + 1, 1, False) for i in range(19)], [i - 9.5 for i in range(20)]),
        ([0, 0, 0], [1, 1, 1], [(0, 1, 1, False), (0, 2, 1, False)], [-2 / 3, 1 / 3, 1 / 3]),
        ([0, 10], [1, 1], [(0, 1, 5, False)], [0, 10]),
    ],
)
def test_projection(desired, weight, rules, want):
    x, _, dead = solve(desired, weight, rules)
    assert np.allclose(x, want) and not dead.any()


def test_contradiction_is_reported():
    _, _, dead = solve([0, 0], [1, 1], [(0, 1, 5, False), (1, 0, 5, False)])
    assert dead.tolist() == [False, True]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(1, 15), st.integers(1, 15)), min_size=1, max_size=15))
def test_no_overlaps_are_left(boxes):
    b = np.array([(x - w / 2, x + w / 2, y - h / 2, y + h / 2) for x, y, w, h in boxes])
    o = separated(b, np.ones(len(b)))
    assert np.allclose(o[:, 1] - o[:, 0], b[:, 1] - b[:, 0])
    for i in range(len(o)):
        for j in range(i):
            assert not (o[i, 0] < o[j, 1] - 1e-6 and o[j, 0] < o[i, 1] - 1e-6 and o[i, 2] < o[j, 3] - 1e-6 and o[j, 2] < o[i, 3] - 1e-6)


def test_two_nodes_reach_their_distance(spark):
    s = LayoutSession(spark, ideal_length=100.0, tolerance=1e-8, max_iterations=300)
    s.add_node(0, 0, 10, 10), s.add_node(1, 0, 10, 10), s.add_edge(0, 1)
    a, b = s.run().orderBy("node_id").collect()
    assert abs(np.hypot(a.x - b.x, a.y - b.y) - 100) < 5


def test_boxes_are_kept_apart_and_separations_hold(spark):
    s = LayoutSession(spark, ideal_length=20.0, max_iterations=20, avoid_overlaps=True)
    for i in range(3):
        s.add_node(i, i, 30, 30)
    s.add_edge(0, 1).add_edge(1, 2).add_separation(0, 0, 2, 50)
    r = s.run().orderBy("node_id").collect()
    assert r[2].x - r[0].x >= 50 - 1e-6
    assert all(abs(p.x - q.x) >= 30 - 1e-6 or abs(p.y - q.y) >= 30 - 1e-6 for i, p in enumerate(r) for q in r[:i])


@pytest.mark.parametrize("seed", range(20))
def test_quadratic_optimum(seed):
    """Every choice of binding separations is solved by its own linear system; the best feasible one is the optimum."""
    from itertools import product

    g = np.random.default_rng(seed)
    n = 4
    half = g.normal(size=(n, n))
    q, b = half @ half.T + np.diag(10.0 ** g.integers(-1, 3, n)), g.normal(size=n) * 5
    rules = [(i, i + 1, float(g.integers(0, 4)), bool(g.random() < 0.3)) for i in range(n - 1)]
    left, right, gap, equal = (np.array(c) for c in zip(*rules))
    x, _ = minimise(*(c.ravel() for c in np.indices((n, n))), q.ravel(), b, left, right, gap, equal, np.full(n, np.nan))
    best = np.inf, None
    for on in product((False, True), repeat=len(rules)):
        on = np.array(on) | equal
        a = np.eye(n)[right[on]] - np.eye(n)[left[on]]
        k = int(on.sum())
        y = np.linalg.solve(np.block([[2 * q, a.T], [a, np.zeros((k, k))]]), np.r_[2 * b, gap[on]])[:n]
        if (y[right] - y[left] >= gap - 1e-9).all():
            best = min(best, (y @ q @ y - 2 * b @ y, tuple(y)))
    assert np.allclose(x, best[1], atol=1e-5)


def test_quadratic_holds_fixed_variables(spark):
    q = spark.createDataFrame([(1, 0, 0, 2.0), (1, 1, 1, 1.0), (1, 7, 7, 1.0)], "m_id long, i long, j long, v double")
    b = spark.createDataFrame([(1, 0, 2.0), (1, 1, 0.0)], "m_id long, i long, v double")
    more = spark.createDataFrame([(1, 0, 0, 1.0)], "m_id long, i long, j long, v double")
    rule = spark.createDataFrame([(1, 0, 1, 4.0, False), (1, 1, 9, 1.0, True)], "m_id long, left long, right long, gap double, equality boolean")
    held = spark.createDataFrame([(1, 0, 5.0)], "m_id long, i long, v double")
    at = lambda df: [round(x.v, 5) for x in df.orderBy("i").collect()]
    assert at(gradient_projection(q, b)) == [1.0, 0.0]
    assert at(gradient_projection(q, b, sparse=more)) == [round(2 / 3, 5), 0.0]
    assert at(gradient_projection(q, b, rule, held)) == [5.0, 9.0]
    assert at(gradient_projection(q, b, rule, held, more, small=0)) == [5.0, 9.0]
    assert at(gradient_projection(q, b.limit(0), small=0)) == []
