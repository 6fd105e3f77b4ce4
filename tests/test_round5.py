"""What goes side by side or in one task gives what one at a time gives."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.operators import layout as Y
from gridloom.operators import tiles as K

NODE, EDGE = "graph_id long, node_id long, x double, y double, w double, h double", "graph_id long, edge_idx long, src long, dst long, length double"


@pytest.mark.parametrize("spec", [Y.LayoutSpec(40.0, max_iterations=5), Y.LayoutSpec(40.0, max_iterations=5, runge_kutta=False, separations=((0, 0, 1, 30.0, False), (0, 0, 2, 5.0, False), (1, 1, 2, 0.0, True))), Y.LayoutSpec(40.0, max_iterations=4, avoid_overlaps=True)])
def test_layouts_side_by_side_are_those_one_by_one(spec):
    """Graphs that stop at different times, with nodes on one spot, locks, wishes and a graph without edges."""
    r = np.random.default_rng(3)
    m, n = 9, 6
    pos = r.random((m, n, 2)) * 50
    pos[::3, 2] = pos[::3, 4]
    of = np.repeat(np.arange(m - 1), 8)
    src, dst = r.integers(0, 3, len(of)), r.integers(3, n, len(of))
    length, size = r.choice([1.0, 2.0], len(of)), np.full((m, n, 2), 8.0)
    lock, wish = np.full((2, m, n, 2), np.nan)
    lock[1, 0], wish[2:4, 5] = 7.0, 20.0
    weight = np.where(np.isfinite(wish[:, :, 0]), 2.0, 0.0)
    run = lambda g: Y._Graphs(spec, pos[g], size[g], of[np.isin(of, g)] - g[0], *(a[np.isin(of, g)] for a in (src, dst, length)), lock[g], wish[g], weight[g]).run(pos[g])
    got = run(np.arange(m))
    for g in range(m):
        alone = run(np.array([g]))
        assert np.allclose(got[0][g], alone[0][0], atol=1e-6) and np.isclose(got[1][g], alone[1][0]) and got[2][g] == alone[2][0]
        assert np.allclose([s[at == g][0] for at, s in got[3] if g in at], [s[0] for _, s in alone[3]])
    assert len(set(got[2].tolist())) > 1


def test_layouts_of_many_graphs_are_those_alone(spark):
    """Graphs of one to four nodes with numbers of their own, some without edges."""
    nodes = [(g, 10 * v + g, float(7 * v * v % 11), float(5 * v + g), 4.0, 3.0) for g in range(300) for v in range(1 + g % 4)]
    edges = [(g, v, 10 * v + g, 10 * (v + 1) + g, None if v else 2.0) for g in range(0, 300, 2) for v in range(g % 4)] + [(1, 9, 1, 999, 1.0)]
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    spec = Y.LayoutSpec(10.0, max_iterations=6)
    together = Y.layout(n, e, spec)
    assert together.count() == len(nodes)
    cut = lambda df: [tuple(round(v, 6) for v in r) for r in df.orderBy("graph_id", "node_id").collect()]
    for g in (1, 2, 3):
        assert cut(together.filter(F.col("graph_id") == g)) == cut(Y.layout(n.filter(F.col("graph_id") == g), e.filter(F.col("graph_id") == g), spec))
    trace = Y.layout(n, e, spec, trace=True)
    last = trace.groupBy("graph_id").agg(F.max("iteration").alias("iterations"))
    assert last.join(together, ["graph_id", "iterations"], "left_semi").count() == 300
    assert Y.layout(n.limit(0), e, spec).count() == 0


def test_tiles_of_the_same_sides_are_one_stack():
    """Tiles of two shapes, known or not and with or without a way, in one record batch (before: a record batch of pairs for each tile)."""
    r = np.random.default_rng(1)
    tile = lambda *s: np.where(r.random(s) < 0.3, np.inf, r.integers(1, 9, s).astype(float))
    rows, want = [], []
    for g in range(40):
        h, w, t = (2, 3, 4) if g % 3 else (3, 3, 2)
        d, left, right = tile(h, w), tile(h, t), tile(t, w)
        known, way = g % 4 != 1, g % 5 != 2 or g % 4 == 1
        rows.append((g, 1, 2, h, w, 3, d.tobytes() if known else None, left.tobytes() if way else None, right.tobytes() if way else None))
        both = (left[:, :, None] + right[None]).min(1) if way else np.inf
        want.append(np.minimum(d if known else np.inf, both))
    types = [pa.int64(), *[pa.int32()] * 5, *[pa.binary()] * 3]
    b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [*K.FACTS, "d", "left", "right"])
    got = pa.Table.from_batches(K._made(K._elsewhere, K._ways)(iter([b])))
    assert {x["graph_id"]: x["d"] for x in got.to_pylist()} == {g: d.tobytes() for g, d in enumerate(want)}
    ids = [got.column(s).combine_chunks().to_pylist() for s in ("high", "wide")]
    pairs = got.append_column("from_ids", pa.array([[7 * i for i in range(h)] for h in ids[0]])).append_column("to_ids", pa.array([[9 * i for i in range(w)] for w in ids[1]]))
    out = list(K._pairs(iter(pairs.combine_chunks().to_batches())))
    assert len(out) == 2
    assert sorted(map(tuple, pd_rows(out))) == sorted((g, 7 * i, 9 * j, d[i, j]) for g, d in enumerate(want) for i, j in zip(*np.nonzero(np.isfinite(d))))


def pd_rows(batches):
    return (x.values() for x in pa.Table.from_batches(batches).to_pylist())
