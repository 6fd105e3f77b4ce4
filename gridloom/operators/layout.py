"""Stress-minimising layouts in two and three dimensions, a graph to a group.

One iteration moves each axis down the gradient with the exact step of the quadratic model,
projects onto the separations (and non-overlap constraints) and shortens the move where the
projection bends it; Runge-Kutta combines four such positions. Graphs are independent: many go to
a task, and there those of as many nodes are arrays side by side; a graph's square of distances
must fit a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import written
from .graph import both_ways, sanitised
from .overlap import EXTRA_GAP, sweep
from .projection import solve_separation
from .stress import DESIRED_FACTOR, LOCK_WEIGHT

#: Rows of nodes and edges that a task takes at once, pairs of nodes in arrays side by side (about).
BATCH, CELLS = 8_000, 1 << 15


@dataclass(frozen=True)
class LayoutSpec:
    """Options of a run. separations: (dim, left, right, gap, equality) for every graph that has both nodes."""

    ideal_length: float = 100.0
    tolerance: float = 1e-4
    max_iterations: int = 100
    dims: int = 2
    move_axes: tuple[int, ...] = (0, 1, 2)
    runge_kutta: bool = True
    avoid_overlaps: bool = False
    neighbours_only: bool = False
    skip_distant: bool = True
    separations: tuple[tuple, ...] = field(default_factory=tuple)


class _Graphs:
    """Graphs of as many nodes each, side by side, and one iteration over them. pos: graph, node, axis; src, dst: nodes of the graphs that of names."""

    #: What each graph has of its own.
    OWN = ("size", "lock", "wish", "wish_weight", "d", "near", "linked", "safe", "square", "least")

    def __init__(self, spec: LayoutSpec, pos: np.ndarray, size: np.ndarray, of: np.ndarray, src: np.ndarray, dst: np.ndarray, length: np.ndarray, lock: np.ndarray, wish: np.ndarray, wish_weight: np.ndarray):
        m, n = pos.shape[:2]
        self.spec, self.size, self.lock, self.wish, self.wish_weight = spec, size, lock, wish, wish_weight
        d, self.near = np.full((m, n, n), np.inf), np.zeros((m, n, n), bool)
        for u, v in ((src, dst), (dst, src)):
            np.minimum.at(d.reshape(-1), (of * n + u) * n + v, length)
            self.near[of, u, v] = True
        d[:, range(n), range(n)] = 0.0
        for k in range(n):
            np.minimum(d, d[:, :, k, None] + d[:, k, None, :], out=d)
        self.d = d * spec.ideal_length
        self.linked = np.isfinite(d) & ~np.eye(n, dtype=bool)
        if spec.neighbours_only:
            self.linked &= self.near
        self.safe = np.where(self.linked, self.d, 1.0)
        self.square = self.safe**2
        self.rules = [s for s in spec.separations if s[1] < n and s[2] < n]
        least = np.where(self.linked, self.d, np.inf).min((1, 2), initial=np.inf)
        self.least = np.where(np.isfinite(least), least, 1.0)

    def keep(self, go: np.ndarray) -> None:
        """Graphs that have stopped leave the arrays."""
        for name in self.OWN:
            setattr(self, name, getattr(self, name)[go])

    def apart(self, pos: np.ndarray) -> np.ndarray:
        """Nodes on one spot are moved a little, in directions that depend on their number only."""
        out = pos.copy()
        m, n, dims = pos.shape
        spot = np.round(pos, 2).reshape(m * n, dims)
        of = np.repeat(np.arange(m), n)
        order = np.lexsort((*spot.T, of))
        same = (spot[order[1:]] == spot[order[:-1]]).all(1) & (of[order[1:]] == of[order[:-1]])
        g, i = np.divmod(order[1:][same], n)
        turn = 2.399963 * (i + 1)
        way = np.stack([np.cos(turn), np.sin(turn), np.cos(1.3 * turn)], 1)[:, :dims]
        out[g, i] += 0.1 * self.least[g, None] * way / np.linalg.norm(way, axis=1, keepdims=True)
        return out

    def pairs(self, pos: np.ndarray, axis: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How far nodes are from each other on the axis and in all, and which pairs count."""
        diff = [pos[:, :, None, a] - pos[:, None, :, a] for a in range(pos.shape[2])]
        l = np.sqrt(sum(d * d for d in diff))
        on = self.linked & ~((l > self.d) & ~self.near) if self.spec.skip_distant else self.linked
        return diff[axis], l, on

    def stress(self, pos: np.ndarray) -> np.ndarray:
        _, l, on = self.pairs(pos)
        s = np.where(on, (self.safe - l) ** 2 / self.square, 0.0).reshape(len(pos), -1).sum(1) / 2
        s += LOCK_WEIGHT * np.nansum((pos - self.lock) ** 2, (1, 2))
        return s + DESIRED_FACTOR * np.nansum(self.wish_weight[:, :, None] * (pos - self.wish) ** 2, (1, 2))

    def project(self, goal: np.ndarray, pos: np.ndarray, axis: int) -> np.ndarray:
        m, n = goal.shape
        locked = np.isfinite(self.lock[:, :, axis])
        goal = np.where(locked, self.lock[:, :, axis], goal)
        # The variables of all graphs in one row.
        base = n * np.arange(m)[:, None]
        rules = [r for r in self.rules if r[0] == axis]
        left, right = ((base + np.array([r[k] for r in rules], int)).ravel() for k in (1, 2))
        gap, equal = (np.tile(np.array([r[k] for r in rules], t), m) for k, t in ((3, float), (4, bool)))
        if self.spec.avoid_overlaps and axis < 2:
            o = 1 - axis
            half = self.size[:, :, o] / 2
            swept = [sweep(p[:, o] - h, p[:, o] + h, p[:, axis], s[:, axis] + EXTRA_GAP) for p, h, s in zip(pos, half, self.size)]
            a, b, g = (np.concatenate([x[k] + n * i * (k < 2) for i, x in enumerate(swept)]) for k in range(3))
            left, right, gap, equal = np.r_[left, a].astype(int), np.r_[right, b].astype(int), np.r_[gap, g], np.r_[equal, np.zeros(len(a), bool)]
        if not len(gap):
            return goal
        # What is under no rule keeps its goal.
        v = np.unique(np.r_[left, right])
        x = goal.ravel()
        x[v] = solve_separation(x[v], np.where(locked.ravel()[v], LOCK_WEIGHT, 1.0), np.ones(len(v)), np.searchsorted(v, left), np.searchsorted(v, right), gap, equal)[0]
        return x.reshape(m, n)

    def descend(self, pos: np.ndarray) -> np.ndarray:
        pos = pos.copy()
        n = pos.shape[1]
        diagonal = np.arange(n)
        along = lambda h, u, v: (np.matmul(u[:, None, :], h)[:, 0] * v).sum(1)
        over = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=np.abs(b) > 1e-30)
        for axis in self.spec.move_axes[: self.spec.dims]:
            a, l, on = self.pairs(pos, axis)
            l = np.where(l > 0, l, 1.0)
            grad = np.where(on, a * (l - self.safe) / (self.square * l), 0.0).sum(2)
            ll = l * l
            h = np.where(on, (self.safe * (ll - a * a) / (ll * l) - 1) / self.square, 0.0)
            h[:, diagonal, diagonal] = -h.sum(2)
            x = pos[:, :, axis]
            wished = np.isfinite(self.wish[:, :, axis])
            grad -= np.where(wished, self.wish_weight * (self.wish[:, :, axis] - x), 0.0)
            h[:, diagonal, diagonal] += np.where(wished, self.wish_weight, 0.0)
            step = over((grad * grad).sum(1), along(h, grad, grad))
            most = np.abs(grad).max(1, initial=0.0)
            limit = self.spec.ideal_length * n
            step = np.where(most * np.abs(step) > limit, np.sign(step) * limit / np.where(most > 0, most, 1.0), step)
            goal = self.project(x - step[:, None] * grad, pos, axis)
            move = x - goal
            beta = np.clip(over((grad * move).sum(1), along(h, move, move)), 0.0, 1.0)
            # A move the constraints ask for is made in full.
            bound = any(r[0] == axis for r in self.rules) or self.spec.avoid_overlaps or np.isfinite(self.lock[:, :, axis]).any(1, keepdims=True)
            pos[:, :, axis] = np.where(bound, goal, x - beta[:, None] * move)
        return pos

    def iterate(self, pos: np.ndarray) -> np.ndarray:
        start = pos = self.apart(pos)
        if self.spec.runge_kutta:
            a = self.descend(start)
            b = self.descend(start + (a - start) / 2)
            c = self.descend(start + (b - start) / 2)
            e = self.descend(c)
            pos = (a + 2 * b + 2 * c + e) / 6
        else:
            pos = self.descend(start)
        for axis in self.spec.move_axes[: self.spec.dims]:
            pos[:, :, axis] = self.project(pos[:, :, axis], pos, axis)
        return pos

    def run(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Positions, the stress there, iterations, and for each iteration (from 0) the graphs that had it and their stress. Each graph stops by itself."""
        at, now = np.arange(len(pos)), self.stress(pos)
        out, after, iterations, said, k = pos.copy(), now.copy(), np.zeros(len(pos), np.int64), [(at, now)], 0
        # Without constraints the least stress on the way is the result; with them the start may break them.
        free = ~(np.isfinite(self.lock).any((1, 2)) | bool(self.rules) | self.spec.avoid_overlaps)
        best, best_pos = now, pos
        while len(at):
            k += 1
            pos = self.iterate(pos)
            old, now = now, self.stress(pos)
            said.append((at, now))
            better = now < best
            best, best_pos = np.where(better, now, best), np.where(better[:, None, None], pos, best_pos)
            used = k >= self.spec.max_iterations if k == 1 else k > self.spec.max_iterations
            stop = ((old - now) / (now + 1e-30) < self.spec.tolerance) & (k > 1) | used
            if stop.any():
                done, go = at[stop], ~stop
                out[done], after[done], iterations[done] = np.where(free[:, None, None], best_pos, pos)[stop], np.where(free, best, now)[stop], k
                self.keep(go)
                at, pos, now, best, best_pos, free = (a[go] for a in (at, pos, now, best, best_pos, free))
        return out, after, iterations, said


def layout(nodes: DataFrame, edges: DataFrame, spec: LayoutSpec = LayoutSpec(), locks: DataFrame | None = None, desired: DataFrame | None = None, trace: bool = False) -> DataFrame:
    """graph_id, node_id, x, y, z, w, h, stress_before, stress_after, iterations for every node; with trace, graph_id, iteration, stress instead.

    nodes: graph_id, node_id, x, y, z (3-D), w, h; edges: graph_id, edge_idx, src, dst, length.
    locks: graph_id, node_id, x, y (z); desired: the same and weight. Distances between
    components have no influence. An empty table gives an empty result.
    """
    axes = ("x", "y", "z")
    add = lambda df, side, p, more: df.join(side.select("graph_id", "node_id", *[(F.col(a) if a in side.columns else F.lit(None)).cast("double").alias(p + a) for a in axes], *more), ["graph_id", "node_id"], "left") if side is not None else df.withColumns({p + a: F.lit(None).cast("double") for a in axes})
    n = add(nodes.select("graph_id", "node_id", "x", "y", (F.col("z") if "z" in nodes.columns else F.lit(0.0)).alias("z"), "w", "h"), locks, "lock_", [])
    n = add(n, desired, "wish_", [F.col("weight").alias("wish_weight")] if desired is not None else [])
    if desired is None:
        n = n.withColumn("wish_weight", F.lit(0.0))
    e = both_ways(sanitised(edges, nodes)).select("graph_id", "src", "dst", "length")
    dims = spec.dims

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        t = left.sort_by([("graph_id", "ascending"), ("node_id", "ascending")])
        graphs = t.column("graph_id").combine_chunks().dictionary_encode(null_encoding="encode")
        of, ids = graphs.indices.to_numpy(), t.column("node_id").to_numpy()
        own, nodes_of = pc.index_in(right.column("graph_id").combine_chunks(), graphs.dictionary).to_numpy(zero_copy_only=False), np.bincount(of)
        # Graphs of as many nodes stand side by side.
        turn = np.argsort(nodes_of, kind="stable")
        rank = np.empty(len(turn), np.int64)
        rank[turn] = np.arange(len(turn))
        order = np.argsort(rank[own], kind="stable")
        own = own[order]
        names = np.unique(ids)
        first = np.r_[0, np.cumsum(nodes_of)]
        key = of * np.int64(len(names) + 1) + np.searchsorted(names, ids)
        place = lambda c: np.searchsorted(key, own * np.int64(len(names) + 1) + np.searchsorted(names, right.column(c).to_numpy()[order])) - first[own]
        src, dst, length = place("src"), place("dst"), right.column("length").to_numpy()[order]
        m = lambda p: np.stack([np.asarray(t.column(p + a).to_pandas(), float) for a in axes[:dims]], 1)
        pos, lock, wish = m(""), m("lock_"), m("wish_")
        size = np.stack([t.column("w").to_numpy(), t.column("h").to_numpy()], 1)
        weight = np.nan_to_num(np.asarray(t.column("wish_weight").to_pandas(), float))
        before, after, iterations, traced = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64), []
        at = 0
        while at < len(turn):
            n = int(nodes_of[turn[at]])
            to = min(at + max(1, CELLS // (n * n)), int(np.searchsorted(nodes_of[turn], n, "right")))
            v = first[turn[at:to], None] + np.arange(n)
            e = slice(*np.searchsorted(rank[own], (at, to)))
            g = _Graphs(spec, pos[v], size[v], rank[own[e]] - at, src[e], dst[e], length[e], lock[v], wish[v], weight[v])
            pos[v], stress, used, said = g.run(pos[v])
            before[v], after[v], iterations[v] = said[0][1][:, None], stress[:, None], used[:, None]
            traced += [(turn[at + which], np.full(len(which), k), s) for k, (which, s) in enumerate(said)]
            at = to
        graph = t.column("graph_id").cast(pa.int64())
        if trace:
            which, k, s = (np.concatenate(c) for c in zip(*traced))
            return pa.table({"graph_id": graph.take(pa.array(first[which])), "iteration": pa.array(k, pa.int64()), "stress": s})
        out = {a: pos[:, i] if i < dims else t.column(a) for i, a in enumerate(axes)}
        return pa.table({"graph_id": graph, "node_id": t.column("node_id"), **out, "w": t.column("w"), "h": t.column("h"), "stress_before": before, "stress_after": after, "iterations": pa.array(iterations, pa.int64())})

    schema = "graph_id long, iteration long, stress double" if trace else "graph_id long, node_id long, x double, y double, z double, w double, h double, stress_before double, stress_after double, iterations long"
    n, e = written(n, "nodes"), written(e, "edges")
    batches = max(8, (n.count() + e.count()) // BATCH)
    spark = nodes.sparkSession
    # As many partitions as there are tasks to run, as rows are small and a graph takes long.
    parts = min(batches, 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    many = lambda df: df.withColumn("batch", F.pmod(F.xxhash64("graph_id"), F.lit(batches))).repartition(parts, "batch").groupBy("batch")
    # Edges lie between nodes, so no batch has edges alone.
    return many(n).cogroup(many(e)).applyInArrow(solve, schema)


class LayoutSession:
    """Collects nodes, edges and constraints step by step, for callers that hold one graph in hand; run() is the layout above."""

    def __init__(self, spark, **options):
        self.spark, self.options = spark, options
        self.clear()

    def clear(self) -> "LayoutSession":
        self.nodes, self.edges, self.rules, self.locks, self.wishes = [], [], [], [], []
        return self

    def add_node(self, x: float, y: float, w: float, h: float, z: float = 0.0) -> int:
        self.nodes.append((0, len(self.nodes), float(x), float(y), float(z), float(w), float(h)))
        return len(self.nodes) - 1

    def add_edge(self, src: int, dst: int, length: float | None = None) -> "LayoutSession":
        self.edges.append((0, len(self.edges), src, dst, None if length is None else length / self.options.get("ideal_length", 100.0)))
        return self

    def add_separation(self, dim: int, left: int, right: int, gap: float, equality: bool = False) -> "LayoutSession":
        self.rules.append((dim, left, right, float(gap), equality))
        return self

    def add_alignment(self, dim: int, nodes: list[int]) -> "LayoutSession":
        for a, b in zip(nodes, nodes[1:]):
            self.add_separation(dim, a, b, 0.0, True)
        return self

    def add_distribution(self, dim: int, nodes: list[int], gap: float) -> "LayoutSession":
        for a, b in zip(nodes, nodes[1:]):
            self.add_separation(dim, a, b, gap, True)
        return self

    def lock(self, node: int, x: float, y: float, z: float = 0.0) -> "LayoutSession":
        self.locks.append((0, node, float(x), float(y), float(z)))
        return self

    def desire(self, node: int, x: float, y: float, weight: float, z: float = 0.0) -> "LayoutSession":
        self.wishes.append((0, node, float(x), float(y), float(z), float(weight)))
        return self

    def run(self, iterations: int | None = None, trace: bool = False) -> DataFrame:
        at = "graph_id long, node_id long, x double, y double, z double"
        make = self.spark.createDataFrame
        options = self.options | ({"max_iterations": iterations} if iterations else {})
        spec = LayoutSpec(separations=tuple(self.rules), **options)
        edges = make(self.edges, "graph_id long, edge_idx long, src long, dst long, length double")
        return layout(make(self.nodes, f"{at}, w double, h double"), edges, spec, make(self.locks, at) if self.locks else None, make(self.wishes, f"{at}, weight double") if self.wishes else None, trace)
