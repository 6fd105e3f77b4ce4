"""Operators for groups that fit no task: sweeps, overlap removal, forests, contradictions, cluster order."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import rectangles as R
from gridloom.operators import clusters as C
from gridloom.operators import graph as G
from gridloom.operators import linalg as L
from gridloom.operators import overlap as O
from gridloom.operators import placement as P
from gridloom.operators import projection as Q
from gridloom.operators import quadratic as D
from gridloom.operators import tiles as K
from gridloom.operators.forest import forest_set
from gridloom.plans.cut import dealt, neighbours

RECT = "group_id long, rect_id long, min_x double, max_x double, min_y double, max_y double, x_border double, y_border double"


def some_rects(seed, groups=3, n=40):
    """Rectangles with equal centres and edges, points, lines and one that covers most others."""
    r = random.Random(seed)
    out = []
    for g in range(groups):
        for i in range(n):
            x, y, w, h = r.randrange(60) / 2, r.randrange(60) / 2, r.choice([0, 0.25, 1, 2, 3, 8]), r.choice([0, 0.25, 1, 2, 5])
            if i == 7:
                x, y, w, h = 3, 3, 25, 25
            out.append((g, i * 3, float(x), float(x + w), float(y), float(y + h), 0.0, 0.0))
    return out


def arrays(rows, g):
    own = sorted(r for r in rows if r[0] == g)
    return np.array([x[1] for x in own]), np.array([x[2:6] for x in own])


@pytest.mark.parametrize("seed", [1, 2])
def test_sweeps_and_lists_match_the_ones_in_memory(spark, seed):
    rows = some_rects(seed)
    df = spark.createDataFrame(rows, RECT)
    got = {name: sorted(map(tuple, f.select("group_id", "left", "right", F.round("gap", 6)).collect())) for name, f in (("x", O.sweep_constraints(df, R.X)), ("y", O.sweep_constraints(df, R.Y)), ("list", O.neighbour_constraints(df)))}
    want = {"x": [], "y": [], "list": []}
    for g in range(3):
        ids, b = arrays(rows, g)
        mid = lambda k: (b[:, 2 * k] + b[:, 2 * k + 1]) / 2
        size = lambda k: b[:, 2 * k + 1] - b[:, 2 * k]
        for name, (left, right, gap) in (("x", O.sweep(b[:, 2], b[:, 3], mid(0), size(0))), ("y", O.sweep(b[:, 0], b[:, 1], mid(1), size(1))), ("list", O.listed(b, mid(0), size(0), mid(1)))):
            want[name] += [(g, int(ids[i]), int(ids[j]), round(float(v), 6)) for i, j, v in zip(left, right, gap)]
    assert {k: sorted(v) for k, v in want.items()} == got


def test_a_span_falls_into_few_nodes(spark):
    n = 5000
    spans = spark.range(n).select("id", (F.col("id") * 7919 % n).alias("a"), (F.col("id") * 104729 % n).alias("b")).select("id", F.least("a", "b").alias("first"), (F.greatest("a", "b") + 1).alias("end"))
    nodes = spans.withColumn("node", F.explode(O.nodes_of(F.col("first"), F.col("end"))))
    sums = nodes.groupBy("id", "first", "end").agg(F.sum(F.pow(F.lit(2), F.col("node.level"))).alias("ranks"), F.count("*").alias("k"))
    assert sums.filter("ranks <> end - first").count() == 0
    assert sums.agg(F.max("k")).first()[0] <= 2 * math.log2(n)
    above = spark.range(n).withColumn("node", F.explode(O.nodes_above(F.col("id"), F.lit(n).cast("long"))))
    assert above.count() <= n * (math.log2(n) + 2)
    assert above.filter("node.place <> id div cast(pow(2, node.level) as long)").count() == 0


def test_neighbours_reach_over_ranges(spark):
    r = random.Random(5)
    rows = [(r.randrange(3), i, r.choice([None, None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, at int, v int")
    got = {(x.k, x["at"]): (x.prev, x.next) for x in neighbours(dealt(df, "k", "at", rows=20), ["k"], ["at"], "v").collect()}
    assert len(got) == 400
    for k, at, _ in rows:
        before = [v for q, a, v in rows if q == k and a < at and v is not None]
        after = [v for q, a, v in rows if q == k and a > at and v is not None]
        assert got[k, at] == (max(before, default=None), min(after, default=None))


def test_overlap_removal_by_passes_is_that_in_memory(spark):
    r = random.Random(4)
    rows = [(g, i, float(x), x + r.choice([1.0, 3.0, 6.5]), float(y), y + r.choice([1.0, 2.0, 4.5]), 0.0, 0.0) for g in range(2) for i in range(45) for x, y in [(r.random() * 20, r.random() * 20)]]
    df = spark.createDataFrame(rows, RECT)
    fixed = df.filter("rect_id % 9 = 0")
    show = lambda d: {(x.group_id, x.rect_id): x[2:6] for x in d.select("group_id", "rect_id", "min_x", "max_x", "min_y", "max_y").collect()}
    small, large = show(O.remove_overlaps(df, fixed)), show(O.remove_overlaps(df, fixed, small=0))
    assert small.keys() == large.keys() and all(np.allclose(small[k], large[k], atol=1e-6) for k in small)
    boxes = [(k[0], *v) for k, v in large.items()]
    assert not any(a[0] == b[0] and a[1] < b[2] - 1e-6 and b[1] < a[2] - 1e-6 and a[3] < b[4] - 1e-6 and b[3] < a[4] - 1e-6 for i, a in enumerate(boxes) for b in boxes[:i])
    width = {(x[0], x[1]): (x[3] - x[2], x[5] - x[4]) for x in rows}
    assert all(np.allclose((v[1] - v[0], v[3] - v[2]), width[k]) for k, v in large.items())
    assert O.remove_overlaps(df.limit(0), small=0).count() == 0


def test_groups_in_line_are_chains(spark, monkeypatch):
    """A group whose rectangles all cross a line gets no pairs that overlap, only next ones; another beside it is unchanged."""
    r = random.Random(5)
    rows = [(1, i, x, x + r.choice([0.0, 1.0, 4.0]), -20.0 - i % 3, 30.0 + i % 4, 0.0, 0.0) for i in range(60) for x in [float(r.randrange(40))]]
    df = spark.createDataFrame(rows, RECT)
    show = lambda d: {(x.group_id, x.rect_id): x[2:6] for x in d.select("group_id", "rect_id", "min_x", "max_x", "min_y", "max_y").collect()}
    more = df.unionByName(spark.createDataFrame([(2, *x[1:4], x[2] / 7, x[2] / 7 + 3, 0.0, 0.0) for x in rows], RECT))
    want, got = show(O.remove_overlaps(more)), show(O.remove_overlaps(more, small=0))
    assert want.keys() == got.keys() and all(np.allclose(want[k], got[k], atol=1e-6) for k in want)
    monkeypatch.setattr(O, "neighbour_constraints", None)
    assert show(O.remove_overlaps(df, small=0)).keys() == {k for k in want if k[0] == 1}


@pytest.mark.parametrize("seed", range(30))
def test_constraints_that_come_in_when_violated_have_the_optimum_of_all(seed):
    r = np.random.default_rng(seed)
    n, m = int(r.integers(2, 25)), int(r.integers(1, 60))
    left = r.integers(0, n - 1, m)
    right = np.minimum(n - 1, left + r.integers(1, n, m))
    desired, weight, gap = r.random(n) * 9, r.random(n) + 0.5, r.integers(0, 5, m).astype(float)
    assert np.allclose(Q.solve_forward(desired, weight, left, right, gap), forest_set(desired, weight, np.ones(n), left, right, gap, np.zeros(m, bool))[0], atol=1e-7)
    few = Q._needed(n, left, right, gap)
    assert not len({(left[k], right[k]) for k in few}) < len(few)


def test_problems_are_solved_many_at_a_time(spark, monkeypatch):
    """Paths, a star, a circle and a contradiction with the same variable ids, in one batch as one by one."""
    rules = [[(0, 1, 2.0, False), (1, 2, 2.0, False)], [(0, 1, 3.0, False), (0, 2, 3.0, False)], [(0, 1, 1.0, True), (1, 2, 1.0, True), (2, 0, 0.0, False)], [(0, 9, 1.0, False)], []]
    v = [(10 * p, i, float(i * p % 3), 1.0, 1.0) for p in range(5) for i in range(3)]
    c = [(10 * p, k, *rule) for p, own in enumerate(rules) for k, rule in enumerate(own)] + [(77, 0, 0, 1, 1.0, False)]
    vs, cs = "problem_id long, var_id long, desired double, weight double, scale double", "problem_id long, c_id long, left long, right long, gap double, equality boolean"
    v, c = spark.createDataFrame(v, vs), spark.createDataFrame(c, cs)
    whole = sorted(map(tuple, Q.project(v, c).collect()))
    single = sorted(tuple(x) for p in range(5) for x in Q.project(v.filter(f"problem_id = {10 * p}"), c.filter(f"problem_id = {10 * p}")).collect())
    assert len(whole) == 15 and np.allclose(whole, single) and {x[0] for x in whole if x[3]} == {20}
    calls = spark.sparkContext.accumulator(0)
    solve = Q._project
    monkeypatch.setattr(Q, "_project", lambda *a: (calls.add(1), solve(*a))[1])
    many = spark.range(300).select(F.col("id").alias("problem_id"), F.lit(0).cast("long").alias("var_id"), F.lit(0.0).alias("desired"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("scale"))
    assert Q.project(many, c.limit(0)).collect() and calls.value <= 8


@pytest.mark.parametrize("seed", range(40))
def test_the_forest_finds_what_the_matrix_finds(seed):
    r = np.random.default_rng(seed)
    n, m = int(r.integers(2, 14)), int(r.integers(1, 22))
    left, right = r.integers(0, n, m), r.integers(0, n, m)
    left, right = left[left != right], right[left != right]
    if seed % 2:
        left, right = np.minimum(left, right), np.maximum(left, right)
    equal, gap = r.random(len(left)) < (0.2 if seed % 3 else 0), r.integers(0, 6, len(left)).astype(float)
    desired, weight, scale = r.integers(0, 15, n) + r.random(n), r.integers(1, 4, n).astype(float), r.integers(1, 3, n).astype(float)
    x, _, dead = Q.active_set(desired, weight, scale, left, right, gap, equal)
    y, _, gone = forest_set(desired, weight, scale, left, right, gap, equal)
    assert np.allclose(x, y, atol=1e-6) and (dead == gone).all()


def test_stars_and_grids_of_many_variables():
    r = np.random.default_rng(2)
    n = 20_000
    desired = np.r_[60.0, r.random(n - 1) * 50]
    hub, leaf = np.zeros(n - 1, int), np.arange(1, n)
    x, on, dead = forest_set(desired, np.ones(n), np.ones(n), hub, leaf, np.full(n - 1, 3.0), np.zeros(n - 1, bool))
    # The hub and the leaves that it pushes share a mean.
    t = np.sort(desired[1:] - 3)
    top = np.min((60.0 + np.cumsum(t)) / np.arange(2, n + 1))
    assert np.isclose(x[0], top) and np.allclose(x[1:], np.maximum(desired[1:], top + 3)) and not dead.any()
    k = 142
    g = np.arange(k * k).reshape(k, k)
    left, right = np.r_[g[:, :-1].ravel(), g[:-1].ravel()], np.r_[g[:, 1:].ravel(), g[1:].ravel()]
    desired = r.random(k * k) * 60
    x, on, dead = forest_set(desired, np.ones(k * k), np.ones(k * k), left, right, np.ones(len(left)), np.zeros(len(left), bool))
    slack = x[right] - x[left] - 1
    assert slack.min() > -1e-8 and not dead.any() and np.abs(slack[on]).max() < 1e-7
    # The forces of active constraints are not negative and cancel the pulls, so this is the optimum.
    assert np.isclose((x - desired).sum(), 0, atol=1e-6)


def test_paths_of_contradictions(spark):
    v = spark.createDataFrame([(p, i, float(i), 1.0, 1.0) for p in (1, 2, 3) for i in range(5)], "problem_id long, var_id long, desired double, weight double, scale double")
    rule = "problem_id long, c_id long, left long, right long, gap double, equality boolean"
    c = spark.createDataFrame(
        # An order that closes to a circle; an equality missed from above; all well.
        [(1, i, i, i + 1, 2.0, True) for i in range(4)] + [(1, 9, 4, 0, -7.0, False), (1, 8, 0, 7, 1.0, False)]
        + [(2, 1, 0, 1, 5.0, True), (2, 2, 1, 2, 1.0, True), (2, 3, 0, 2, 3.0, True)] + [(3, 1, 0, 1, 2.0, False)], rule)
    got = sorted(map(tuple, Q.unsatisfiable_paths(v, c).select("problem_id", "failed", "step", "c_id").collect()))
    assert got == [(1, 9, 1, 0), (1, 9, 2, 1), (1, 9, 3, 2), (1, 9, 4, 3), (2, 3, 1, 1), (2, 3, 2, 2)]


def test_clusters_are_numbered_children_first(spark):
    r = random.Random(6)
    up = {0: None, 1: None} | {i: r.randrange(i) for i in range(2, 60)}
    df = spark.createDataFrame(list(up.items()), "cluster_id long, parent_id long")
    want = []

    def walk(k):
        for c in sorted(i for i, p in up.items() if p == k):
            walk(c)
        want.append(k)

    for k in (0, 1):
        walk(k)
    got = sorted((x.post, x.cluster_id) for x in C.post_order(df).collect())
    assert got == list(enumerate(want))
    assert C.post_order(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no tree"):
        C.post_order(spark.createDataFrame([(1, 2), (2, 1)], "cluster_id long, parent_id long"))


def test_a_chain_of_many_clusters(spark):
    n = 5000
    chain = spark.range(n).select(F.col("id").alias("cluster_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    got = C.post_order(chain)
    assert got.filter(f"post <> {n - 1} - cluster_id").count() == 0 and got.count() == n


def test_given_rectangles_count_above_and_hide_what_is_below(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "cluster_id long, parent_id long")
    nodes = spark.createDataFrame([(3, 1, 0.0, 1.0, 0.0, 1.0), (2, 2, 900.0, 901.0, 0.0, 1.0)], "cluster_id long, node_id long, min_x double, max_x double, min_y double, max_y double")
    given = spark.createDataFrame([(2, 100.0, 200.0, 100.0, 200.0)], "cluster_id long, min_x double, max_x double, min_y double, max_y double")
    got = {x.cluster_id: tuple(x)[1:] for x in C.bounds(tree, nodes, 3, given).collect()}
    assert got == {1: (97.0, 203.0, 97.0, 203.0), 2: (100.0, 200.0, 100.0, 200.0), 3: (-3.0, 4.0, -3.0, 4.0)}


def test_boxes_of_any_scale_meet(spark):
    r = random.Random(9)
    for scale in (1e-9, 1.0, 1e12):
        rows = [(0, i, x * scale, (x + w) * scale, y * scale, (y + h) * scale) for i in range(60) for x, y, w, h in [(r.random(), r.random(), r.choice([0, 0.01, 0.1]), r.choice([0, 0.02, 0.2]))]]
        df = spark.createDataFrame(rows, "group_id long, id long, lo_x double, hi_x double, lo_y double, hi_y double")
        got = sorted((x.a_id, x.b_id) for x in R.meeting_boxes(df, df).collect())
        assert got == sorted((a[1], b[1]) for a in rows for b in rows if a[2] <= b[3] and b[2] <= a[3] and a[4] <= b[5] and b[4] <= a[5])


def chain(spark, desired):
    rows = [(1, i, float(v), 1.0) for i, v in enumerate(desired)]
    return spark.createDataFrame(rows, "problem_id long, var_id long, desired double, weight double")


@pytest.mark.parametrize("seed", range(3))
def test_pools_over_many_segments(spark, seed):
    r = random.Random(seed)
    desired = [r.random() * 50 for _ in range(200)] if seed else [200.0 - i for i in range(200)]
    got = {x.var_id: x.position for x in Q.chain_projection(chain(spark, desired), 1.0, segment=16).collect()}
    mean, count = Q.pooled(np.array(desired) - np.arange(200), np.ones(200))
    assert np.allclose([got[i] for i in range(200)], np.repeat(mean, count) + np.arange(200))


def test_a_chain_in_order_keeps_its_pools(spark):
    """A million variables, none of which moves: no task gathers them."""
    n = 1_000_000
    v = spark.range(n).select(F.lit(1).cast("long").alias("problem_id"), F.col("id").alias("var_id"), (F.col("id") * 3.0).alias("desired"), F.lit(1.0).alias("weight"))
    got = Q.chain_projection(v, 2.0)
    assert got.agg(F.count("*"), F.max(F.abs(F.col("position") - 3.0 * F.col("var_id")))).first()[:] == (n, 0.0)


def test_conjugate_gradients_of_a_large_system(spark):
    """The Laplacian of a path of 100,000 nodes plus the identity, and a small system that stops earlier."""
    n = 100_000
    i = spark.range(n).select(F.lit(1).cast("long").alias("m_id"), F.col("id").alias("i"))
    diag = i.select("m_id", "i", F.col("i").alias("j"), F.when((F.col("i") == 0) | (F.col("i") == n - 1), 2.0).otherwise(3.0).alias("v"))
    side = i.filter(F.col("i") < n - 1)
    up = side.select("m_id", "i", (F.col("i") + 1).alias("j"), F.lit(-1.0).alias("v"))
    down = side.select("m_id", (F.col("i") + 1).alias("i"), F.col("i").alias("j"), F.lit(-1.0).alias("v"))
    two = spark.createDataFrame([(2, 0, 0, 4.0), (2, 1, 1, 5.0)], "m_id long, i long, j long, v double")
    a = diag.unionByName(up).unionByName(down).unionByName(two)
    x = i.select("m_id", "i", (F.col("i") % 17).cast("double").alias("v")).unionByName(spark.createDataFrame([(2, 0, 8.0), (2, 1, -5.0)], "m_id long, i long, v double"))
    got = L.conjugate_gradient(a, L.times_vector(a, x), tolerance=1e-3, small=1)
    both = got.join(x.withColumnRenamed("v", "w"), ["m_id", "i"])
    assert both.count() == n + 2 and both.agg(F.max(F.abs(F.col("v") - F.col("w")))).first()[0] < 1e-3


def some_programmes(sizes, seed):
    """Chains of springs of the given sizes: entries, right sides, rules on runs of seven variables (some equal, two that contradict each other), held variables."""
    r = random.Random(seed)
    cells, b, rules, held = [], [], [], []
    for m, n in enumerate(sizes):
        cells += [(m, i, i, 8.0 + (0 < i) + (i < n - 1)) for i in range(n)] + [(m, i + a, i + 1 - a, -1.0) for i in range(n - 1) for a in (0, 1)]
        b += [(m, i, float(r.randrange(-200, 200))) for i in range(n)]
        rules += [(m, i, i + 1, float(r.randrange(5)), r.random() < 0.2) for i in range(n - 1) if i % 7 != 6]
        rules += [(m, i, i + 3, 4.0, False) for i in range(0, n - 3, 7)] + [(m, 9, 8, 50.0, False), (m, 3, n + 5, 1.0, True)]
        held += [(m, i, 3.0) for i in range(12, n, 70)]
    return cells, b, rules, held


def programme_tables(spark, rows):
    return [spark.createDataFrame(x, s) for x, s in zip(rows, ("m_id long, i long, j long, v double", "m_id long, i long, v double", "m_id long, left long, right long, gap double, equality boolean", "m_id long, i long, v double"))]


def test_programmes_by_rounds_equal_those_in_a_task(spark):
    q, b, rules, held = programme_tables(spark, some_programmes((40, 11, 25), 5))
    ways = [{(x.m_id, x.i): x.v for x in D.gradient_projection(q, b, rules, held, tolerance=1e-12, small=n).collect()} for n in (1000, 30)]
    assert ways[0].keys() == ways[1].keys() and len(ways[0]) == 76
    assert all(abs(ways[0][k] - ways[1][k]) < 1e-6 for k in ways[0])


def test_a_programme_of_many_parts_is_that_in_a_task(spark):
    n = 1500
    rows = some_programmes((n,), 8)
    q, b, rules, held = programme_tables(spark, rows)
    got = D.gradient_projection(q, b, rules, held, tolerance=1e-12, small=500)
    x = np.array([v.v for v in got.orderBy("i").collect()])
    i, j, v = (np.array(c) for c in zip(*[c[1:] for c in rows[0]]))
    left, right, gap, equal = (np.array(c) for c in zip(*[c[1:] for c in rows[2] if c[2] < n]))
    fixed = np.full(n, np.nan)
    fixed[[c[1] for c in rows[3]]] = 3.0
    alone, _ = D.minimise(i, j, v, np.array([c[2] for c in rows[1]]), left, right, gap, equal, fixed, tolerance=1e-12)
    assert len(x) == n and np.allclose(x, alone, atol=1e-6)


def test_hulls_of_many_points(spark):
    """Most points of a disc go by expressions; points on a circle, on a line and in one place stay."""
    r = random.Random(8)
    rows = [(1, i, q * math.cos(t), q * math.sin(t)) for i in range(4000) for q, t in [(math.sqrt(r.random()), r.random() * 7)]]
    rows += [(2, i, math.cos(i), math.sin(i)) for i in range(300)] + [(3, i, float(i % 40), 2.0 * (i % 40)) for i in range(120)] + [(4, i, 1.0, 1.0) for i in range(90)] + [(5, 7, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "set_id long, idx long, x double, y double")
    assert G.outside_extremes(df).filter("set_id = 1").count() < 400
    dealt = sorted(map(tuple, G.convex_hulls(df, part_points=30).collect()))
    assert dealt == sorted(map(tuple, df.groupBy("set_id").applyInArrow(G._hull, G.HULL).collect()))
    assert G.convex_hulls(df.limit(0)).count() == 0


@pytest.mark.parametrize("part_points", [2, 100])
def test_of_equal_points_the_least_counts_on_both_sides_of_a_hull(spark, part_points):
    corners = [(0.0, 0.0), (4.0, 0.0), (5.0, 2.0), (4.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([(1, 100 - 5 * copy - k, x, y) for copy in range(6) for k, (x, y) in enumerate(corners)], "set_id long, idx long, x double, y double")
    assert sorted(map(tuple, G.convex_hulls(df, part_points=part_points).collect())) == [(1, k, 75 - k, *corners[k]) for k in range(5)]


def test_fixed_relative_among_mixed_kinds(spark):
    members = spark.createDataFrame([(1, 5, 2.0, 3.0), (1, 2, 0.0, 1.0)], "problem_id long, node long, x double, y double")
    pairs = spark.createDataFrame([(1, 0, 4, 5, 2.0, False)], "problem_id long, dim int, left long, right long, gap double, equality boolean")
    got = sorted(map(tuple, P.rules_of({"fixed_relative": members, "separation": pairs}).collect()))
    assert got == [(1, 0, 2, 5, 2.0, True, "fixed_relative"), (1, 0, 4, 5, 2.0, False, "separation"), (1, 1, 2, 5, 2.0, True, "fixed_relative")]


def test_distances_by_tiles_equal_other_ways(spark):
    """Graphs of one, two and many tiles, one with a lone node, parallel edges, loops, a missing length and two parts."""
    r = random.Random(8)
    nodes = [(g, 3 * v) for g, n in ((0, 1), (1, 5), (2, 16), (3, 41)) for v in range(n)]
    edges = []
    for g, n in ((1, 5), (2, 16), (3, 40)):
        for e in range(2 * n):
            u, v = r.randrange(n), r.randrange(n)
            if g == 2 and (u < 8) != (v < 8):
                v = u
            edges.append((g, e, 3 * u, 3 * v, r.choice([None, 0.5, 1.0, 2.25, 7.0])))
    edges.append((1, 99, 0, 1000, 1.0))
    n = spark.createDataFrame(nodes + nodes[:3], "graph_id long, node_id long")
    e = spark.createDataFrame(edges, "graph_id long, edge_idx long, src long, dst long, length double")
    want = sorted(map(tuple, G.all_pairs(e, n.distinct()).collect()))
    assert sorted(map(tuple, K.all_pairs_by_tiles(e, n, side=8).collect())) == want
    assert sorted(map(tuple, K.all_pairs_by_tiles(e, n).collect())) == want
    assert K.all_pairs_by_tiles(e.limit(0), n.limit(0)).count() == 0


def test_distances_by_tiles_of_one_large_graph(spark):
    """A ring of 900 nodes with chords, in 16 tiles."""
    n = 900
    ring = spark.range(n).select(F.lit(4).cast("long").alias("graph_id"), F.col("id").alias("edge_idx"), F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), F.lit(1.0).alias("length"))
    chords = spark.range(n).filter("id % 10 = 0").select(F.lit(4).cast("long").alias("graph_id"), (F.col("id") + n).alias("edge_idx"), F.col("id").alias("src"), (F.col("id") * 7 % n).alias("dst"), F.lit(3.0).alias("length"))
    e, nodes = ring.unionByName(chords), spark.range(n).select(F.lit(4).cast("long").alias("graph_id"), F.col("id").alias("node_id"))
    got = K.all_pairs_by_tiles(e, nodes, side=256)
    want = G.all_pairs(e, nodes)
    both = got.withColumnRenamed("d", "got").join(want, ["graph_id", "u", "v"], "full")
    assert both.count() == n * n and both.filter("got IS DISTINCT FROM d").count() == 0
