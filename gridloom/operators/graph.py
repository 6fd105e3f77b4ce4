"""Graph operators on edges (graph_id, edge_idx, src, dst, length) and nodes (graph_id, node_id)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rectangles import meeting_boxes
from ..plans.cut import written

PAIRS = "graph_id long, u long, v long, d double"


def sanitised(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without self-loops and edges whose ends are not nodes; a missing length is 1, one that is not positive too."""
    ids = nodes.select("graph_id", "node_id")
    kept = edges.filter("src <> dst").join(ids.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").join(ids.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi")
    length = F.when(F.coalesce("length", F.lit(1.0)) > 0, F.coalesce("length", F.lit(1.0))).otherwise(F.lit(1.0))
    return kept.select("graph_id", "edge_idx", "src", "dst", length.alias("length"))


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select("graph_id", "edge_idx", F.col("dst").alias("src"), F.col("src").alias("dst"), "length")
    return edges.select("graph_id", "edge_idx", "src", "dst", "length").unionByName(back)


def adjacency(edges: DataFrame) -> DataFrame:
    """graph_id, u, v, weight: symmetric; of parallel edges the last counts."""
    both = both_ways(edges).withColumn("length", F.coalesce("length", F.lit(1.0)))
    return both.groupBy("graph_id", F.col("src").alias("u"), F.col("dst").alias("v")).agg(F.max_by("length", "edge_idx").alias("weight"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, node_id, degree (parallel edges count each) and the sorted distinct neighbours."""
    near = both_ways(edges).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").alias("degree"), F.array_sort(F.collect_set("dst")).alias("neighbours"))
    return nodes.select("graph_id", "node_id").join(near, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))


def _floyd_warshall(t: pa.Table) -> pa.Table:
    graph = t.column("graph_id")[0].as_py()
    u, v, w = (t.column(c).to_numpy() for c in ("src", "dst", "length"))
    ids = np.unique(np.r_[u, v])
    d = np.full((len(ids), len(ids)), np.inf)
    np.fill_diagonal(d, 0.0)
    a, b = np.searchsorted(ids, u), np.searchsorted(ids, v)
    np.minimum.at(d, (a, b), w)
    np.minimum.at(d, (b, a), w)
    np.fill_diagonal(d, 0.0)
    for k in range(len(ids)):
        np.minimum(d, d[:, k, None] + d[None, k, :], out=d)
    i, j = np.nonzero(np.isfinite(d))
    return pa.table({"graph_id": pa.array(np.full(len(i), graph)), "u": ids[i], "v": ids[j], "d": d[i, j]})


def all_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, u, v, d: shortest distances in every graph, many graphs at a time; of parallel edges the shortest counts. Pairs without a path have no row. For graphs whose square fits a task; single_source takes larger ones."""
    loops = nodes.select("graph_id", F.lit(-1).cast("long").alias("edge_idx"), F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(0.0).alias("length"))
    full = sanitised(edges, nodes).unionByName(loops)
    return full.select("graph_id", "src", "dst", "length").groupBy("graph_id").applyInArrow(_floyd_warshall, PAIRS)


def all_pairs_by_frontier(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """As all_pairs for graphs of any size: every node is a source of single_source, so no graph meets in one task."""
    sources = nodes.select("graph_id", F.col("node_id").alias("source"))
    return single_source(edges, nodes, sources).select("graph_id", F.col("source").alias("u"), F.col("node_id").alias("v"), "d")


def single_source(edges: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """graph_id, source, node_id, d from each row of sources (graph_id, source), for graphs of any size: a frontier of improved nodes meets the edges until none improves."""
    step = both_ways(sanitised(edges, nodes)).select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("to"), "length")
    known = sources.select("graph_id", "source", F.col("source").alias("node_id"), F.lit(0.0).alias("d"))
    front = known
    while True:
        reach = front.join(step, ["graph_id", "node_id"]).groupBy("graph_id", "source", F.col("to").alias("node_id")).agg(F.min(F.col("d") + F.col("length")).alias("new"))
        merged = written(known.join(reach, ["graph_id", "source", "node_id"], "full").select("graph_id", "source", "node_id", F.least("d", "new").alias("d"), (F.col("d").isNull() | (F.col("new") < F.col("d"))).alias("better")), "paths")
        known, front = merged.drop("better"), merged.filter("better").drop("better")
        if front.isEmpty():
            return known


def pair_classes(edges: DataFrame, nodes: DataFrame, ideal: float) -> DataFrame:
    """graph_id, u, v, d, g for u <> v with a path: d is the path times the ideal length; g is 1 for neighbours, else 2."""
    near = both_ways(sanitised(edges, nodes)).select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v")).distinct().withColumn("near", F.lit(True))
    pairs = all_pairs(edges, nodes).filter("u <> v").join(near, ["graph_id", "u", "v"], "left")
    return pairs.select("graph_id", "u", "v", (F.col("d") * ideal).alias("d"), F.when(F.col("near"), 1).otherwise(2).alias("g"))


def least_distance(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, min_d: the least positive distance, 1 where there is none."""
    least = pairs.filter("d > 0").groupBy("graph_id").agg(F.min("d").alias("min_d"))
    return nodes.select("graph_id").distinct().join(least, "graph_id", "left").select("graph_id", F.coalesce("min_d", F.lit(1.0)).alias("min_d"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, node_id, component_id (its least node), local_idx: least labels spread over edges and jump to their own label until none changes."""
    from pyspark.sql import Window

    near = both_ways(sanitised(edges, nodes)).select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("to")).distinct()
    near = written(near, "near")
    # Files of labels are much smaller than their rows, so the planner would broadcast them.
    merged = lambda df: df.hint("merge")
    label = nodes.select("graph_id", "node_id", F.col("node_id").alias("component_id")).distinct()
    while True:
        told = near.join(merged(label.select("graph_id", F.col("node_id").alias("to"), "component_id")), ["graph_id", "to"]).groupBy("graph_id", "node_id").agg(F.min("component_id").alias("near"))
        step = label.join(merged(told), ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.col("component_id").alias("was"), F.least("component_id", "near").alias("component_id"))
        jump = label.select("graph_id", F.col("node_id").alias("component_id"), F.col("component_id").alias("next"))
        new = written(step.join(merged(jump), ["graph_id", "component_id"]).select("graph_id", "node_id", "was", F.least("component_id", "next").alias("component_id")), "labels")
        label = new.drop("was")
        if new.filter("was <> component_id").isEmpty():
            break
    place = F.row_number().over(Window.partitionBy("graph_id", "component_id").orderBy("node_id")) - 1
    return label.select("graph_id", "node_id", "component_id", place.cast("long").alias("local_idx"))


def component_edges(edges: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges by local numbers: graph_id, component_id, edge_idx, src, dst. Parallel edges stay."""
    at = lambda end: labels.select("graph_id", F.col("node_id").alias(end), "component_id", F.col("local_idx").alias(f"{end}_local"))
    e = sanitised(edges, nodes)
    return e.join(at("src"), ["graph_id", "src"]).join(at("dst").drop("component_id"), ["graph_id", "dst"]).select("graph_id", "component_id", "edge_idx", F.col("src_local").alias("src"), F.col("dst_local").alias("dst"))


def edge_crossings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, crossings: pairs of edges without a common end that properly cross. Edges meet by their bounding boxes (meeting_boxes)."""
    p = nodes.select("graph_id", "node_id", "x", "y")
    e = sanitised(edges, nodes)
    for end in ("src", "dst"):
        e = e.join(p.select("graph_id", F.col("node_id").alias(end), F.col("x").alias(f"{end}_x"), F.col("y").alias(f"{end}_y")), ["graph_id", end])
    ends = ("src", "dst", "src_x", "src_y", "dst_x", "dst_y")
    box = e.select(F.col("graph_id").alias("group_id"), F.col("edge_idx").alias("id"), *[f(f"src_{d}", f"dst_{d}").alias(f"{n}_{d}") for d in ("x", "y") for n, f in (("lo", F.least), ("hi", F.greatest))], *ends)
    turn = lambda p, q, r: F.signum((F.col(q + "_x") - F.col(p + "_x")) * (F.col(r + "_y") - F.col(p + "_y")) - (F.col(q + "_y") - F.col(p + "_y")) * (F.col(r + "_x") - F.col(p + "_x")))
    apart = (F.col("a_src") != F.col("b_src")) & (F.col("a_src") != F.col("b_dst")) & (F.col("a_dst") != F.col("b_src")) & (F.col("a_dst") != F.col("b_dst"))
    cross = (turn("a_src", "a_dst", "b_src") * turn("a_src", "a_dst", "b_dst") < 0) & (turn("b_src", "b_dst", "a_src") * turn("b_src", "b_dst", "a_dst") < 0)
    hits = meeting_boxes(box, box, ends).filter((F.col("a_id") < F.col("b_id")) & apart & cross).groupBy(F.col("group_id").alias("graph_id")).agg(F.count("*").alias("crossings"))
    return nodes.select("graph_id").distinct().join(hits, "graph_id", "left").select("graph_id", F.coalesce("crossings", F.lit(0)).alias("crossings"))


def _hull(t: pa.Table) -> pa.Table:
    x, y, i = (t.column(c).to_numpy() for c in ("x", "y", "idx"))
    order = np.lexsort((i, y, x))
    # Of equal points the least idx, for both halves.
    first = np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)]
    pts = [(x[k], y[k], k) for k in order[first]]

    def half(points) -> list:
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = half(pts), half(pts[::-1])
    ring = [p[2] for p in (lower[:-1] + upper[:-1] or lower)]
    start = min(range(len(ring)), key=lambda k: (y[ring[k]], x[ring[k]], i[ring[k]]))
    ring = ring[start:] + ring[:start]
    s = t.column("set_id")[0].as_py()
    return pa.table({"set_id": pa.array([s] * len(ring), pa.int64()), "ord": pa.array(range(len(ring)), pa.int64()), "idx": pa.array(i[ring], pa.int64()), "x": x[ring], "y": y[ring]})


HULL = "set_id long, ord long, idx long, x double, y double"


def _part_hull(t: pa.Table) -> pa.Table:
    out = _hull(t)
    return out.append_column("part", pa.array([t.column("part")[0].as_py()] * out.num_rows, pa.int64()))


def outside_extremes(points: DataFrame) -> DataFrame:
    """points (set_id, idx, x, y) without those well inside the polygon of their set's extremes in 16 directions, which cannot be on the hull. Expressions only; of a set that fills its hull few points stay."""
    turns = [2 * math.pi * k / 16 for k in range(16)]
    far = [F.max_by(F.struct("x", "y"), F.col("x") * math.cos(t) + F.col("y") * math.sin(t)).alias(f"e{k}") for k, t in enumerate(turns)]
    span = (F.max("x") - F.min("x") + F.max("y") - F.min("y")).alias("span")
    edges = points.groupBy("set_id").agg(*far, span)
    at = lambda k, c: F.col(f"e{k % 16}.{c}")
    some = [(at(k, "x") != at(k + 1, "x")) | (at(k, "y") != at(k + 1, "y")) for k in range(16)]
    cross = [(at(k + 1, "x") - at(k, "x")) * (F.col("y") - at(k, "y")) - (at(k + 1, "y") - at(k, "y")) * (F.col("x") - at(k, "x")) > 1e-9 * F.col("span") * F.col("span") for k in range(16)]
    inside = sum((s.cast("int") for s in some), F.lit(0)) >= 3
    for s, c in zip(some, cross):
        inside = inside & (~s | c)
    return points.join(edges, "set_id").filter(~F.coalesce(inside, F.lit(False))).select(*points.columns)


def convex_hulls(points: DataFrame, part_points: int = 100_000) -> DataFrame:
    """set_id, ord, idx, x, y: each set's hull counter-clockwise from the lowest, then leftmost point; points inside edges are left out, of equal points the least idx counts.

    Points inside the extremes go first (outside_extremes). What is left of a set is dealt to parts of
    about part_points; the hulls of parts are dealt again, eight parts to one, until one is left,
    so only hull points of parts meet in one task.
    """
    p = points.select(F.col("set_id").cast("long").alias("set_id"), F.col("idx").cast("long").alias("idx"), "x", "y")
    # Equal points go to parts by their idx, so one counts before they are dealt.
    p = p.groupBy("set_id", "x", "y").agg(F.min("idx").alias("idx")).select("set_id", "idx", "x", "y")
    p = written(outside_extremes(p), "outside")
    parts = p.groupBy("set_id").agg(F.count("*").alias("n")).select("set_id", F.ceil(F.col("n") / part_points).alias("parts"))
    dealt = p.join(parts, "set_id").withColumn("part", F.pmod(F.xxhash64("idx"), F.col("parts")))
    most = parts.agg(F.max("parts")).first()[0] or 1
    while most > 1:
        hull = dealt.groupBy("set_id", "part").applyInArrow(_part_hull, HULL + ", part long")
        dealt = written(hull.drop("ord").withColumn("part", F.floor(F.col("part") / 8)), "hulls")
        most = -(-most // 8)
    return dealt.select("set_id", "idx", "x", "y").groupBy("set_id").applyInArrow(_hull, HULL)
