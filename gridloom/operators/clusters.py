"""Cluster hierarchies: clusters (cluster_id, parent_id, kind) over nodes (cluster_id, node rectangles)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import numbered, written

#: Fixed value: weight of a cluster's boundary variables.
BOUNDARY_WEIGHT = 1e-7
SIDES = ("min_x", "max_x", "min_y", "max_y")


def closure(clusters: DataFrame, barriers: DataFrame | None = None) -> DataFrame:
    """ancestor, cluster_id, n for every cluster and itself (n = 1) and all below it (n - 1 levels down), level by level. Nothing is below a barrier (cluster_id). A cluster that is its own ancestor raises ValueError."""
    level = clusters.select(F.col("cluster_id").alias("ancestor"), "cluster_id", F.lit(1).alias("n"))
    out = level
    child = clusters.select(F.col("parent_id").alias("cluster_id"), F.col("cluster_id").alias("child"))
    if barriers is not None:
        child = child.join(barriers.select("cluster_id"), "cluster_id", "left_anti")
    while True:
        level = written(level.join(child, "cluster_id").select("ancestor", F.col("child").alias("cluster_id"), (F.col("n") + 1).alias("n")), "levels")
        if level.isEmpty():
            return out
        if not level.filter("ancestor = cluster_id").isEmpty():
            raise ValueError("the clusters are no tree: one is below itself")
        out = out.unionByName(level)


def areas(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_id, area: extents of the nodes of a cluster and all below it; a node given twice to a cluster counts once, one in two clusters twice. members: cluster_id, node_id, min_x, max_x, min_y, max_y."""
    own = members.dropDuplicates(["cluster_id", "node_id"]).groupBy("cluster_id").agg(F.sum((F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))).alias("own"))
    total = closure(clusters).join(own, "cluster_id").groupBy(F.col("ancestor").alias("cluster_id")).agg(F.sum("own").alias("area"))
    return clusters.select("cluster_id").join(total, "cluster_id", "left").select("cluster_id", F.coalesce("area", F.lit(0.0)).alias("area"))


def bounds(clusters: DataFrame, members: DataFrame, padding: float = 0.0, fixed: DataFrame | None = None) -> DataFrame:
    """Bounding rectangles, with padding once for each level: a node below n levels is wrapped n times. Null for a cluster without nodes below it. fixed: cluster_id, min_x, max_x, min_y, max_y of clusters that are a given rectangle: it counts for the clusters above in place of all below it, without padding of its own."""
    pad = F.col("n") * max(0.0, padding)
    sides = [f(F.col(c) + sign * pad).alias(c) for c, f, sign in zip(SIDES, (F.min, F.max, F.min, F.max), (-1, 1, -1, 1))]
    inside = members.select("cluster_id", *SIDES, F.lit(0).alias("less"))
    if fixed is not None:
        own = fixed.select("cluster_id", *SIDES)
        inside = inside.join(own, "cluster_id", "left_anti").unionByName(own.withColumn("less", F.lit(1)))
    got = closure(clusters, fixed).join(inside, "cluster_id").withColumn("n", F.col("n") - F.col("less")).groupBy(F.col("ancestor").alias("cluster_id")).agg(*sides)
    return clusters.select("cluster_id").join(got, "cluster_id", "left")


def post_order(clusters: DataFrame) -> DataFrame:
    """cluster_id, post (from 0): clusters numbered children first, siblings and roots by cluster_id.

    Every cluster has its successor (the first leaf below its next sibling, or its parent), and
    pointers over 1, 2, 4, ... successors rank the list, so no tree meets in one task. A cluster that
    is its own ancestor raises ValueError.
    """
    c = clusters.select(F.col("cluster_id").alias("id"), F.col("parent_id").alias("up"))
    placed = written(numbered(c.withColumn("family", F.struct(F.col("up").isNull().alias("root"), F.coalesce("up", F.lit(0)).alias("up"), "id")), "family").drop("family"), "family")
    nxt = placed.select((F.col("rank") - 1).alias("rank"), F.col("id").alias("sibling"), F.col("up").alias("sibling_up"))
    tree = placed.join(nxt, "rank", "left").select("id", "up", F.when(F.col("sibling_up").eqNullSafe(F.col("up")), F.col("sibling")).alias("sibling"))
    tree = written(tree, "siblings")
    rounds = tree.count().bit_length() + 1
    # The first leaf below each cluster, by first children of first children.
    eldest = tree.filter("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.min("id").alias("to"))
    down = written(tree.select("id").join(eldest, "id", "left").select("id", F.coalesce("to", "id").alias("to")), "down")
    for _ in range(rounds):
        two = written(down.join(down.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), "down", instead_of=down)
        down = two.select("id", "to")
        down.written_to = two.written_to
        if two.filter("moved").isEmpty():
            break
    else:
        raise ValueError("the clusters are no tree: one is below itself")
    after = tree.join(down.select(F.col("id").alias("sibling"), "to"), "sibling", "left").select("id", F.coalesce("to", "up").alias("to"), F.lit(1).cast("long").alias("n"))
    rank = written(after, "ranks")
    for _ in range(rounds):
        far = rank.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("n").alias("more"))
        rank = written(rank.join(far, "to", "left").select("id", F.col("far").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "ranks", instead_of=rank)
        if rank.filter("to IS NOT NULL").isEmpty():
            break
    else:
        raise ValueError("the clusters are no tree: one is below itself")
    total = rank.agg(F.max("n").alias("total"))
    return rank.join(F.broadcast(total)).select(F.col("id").alias("cluster_id"), (F.col("total") - F.col("n")).alias("post"))


def bounds_of_variables(variables: DataFrame) -> DataFrame:
    """cluster_id, min_x, max_x, min_y, max_y read back from boundary variables (cluster_id, dim, side, position)."""
    at = lambda d, s: F.max(F.when((F.col("dim") == d) & (F.col("side") == s), F.col("position")))
    return variables.groupBy("cluster_id").agg(*[at(d, s).alias(c) for c, d, s in (("min_x", 0, 0), ("max_x", 0, 1), ("min_y", 1, 0), ("max_y", 1, 1))])


def boundary(rects: DataFrame, margin: float = 0.0) -> DataFrame:
    """cluster_id, ord, x, y: four corners from the low left, counter-clockwise, of bounds grown by a margin; none for an empty cluster."""
    m = max(0.0, margin)
    a, b, c, d = F.col("min_x") - m, F.col("max_x") + m, F.col("min_y") - m, F.col("max_y") + m
    corner = F.posexplode(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((a, c), (b, c), (b, d), (a, d))])).alias("ord", "p")
    return rects.filter("min_x IS NOT NULL").select("cluster_id", corner).select("cluster_id", F.col("ord").cast("long").alias("ord"), "p.x", "p.y")


def corner_points(members: DataFrame) -> DataFrame:
    """The four corners of every node as points for a convex hull: set_id (cluster), idx (4 * node + corner), x, y."""
    corner = F.posexplode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y"), ("min_x", "min_y"))])).alias("k", "p")
    return members.select("cluster_id", "node_id", corner).select(F.col("cluster_id").alias("set_id"), (F.col("node_id") * 4 + F.col("k")).alias("idx"), "p.x", "p.y")


def boundary_variables(rects: DataFrame, order: str, first_id: int, desired: DataFrame | None = None, weight: float = BOUNDARY_WEIGHT) -> DataFrame:
    """Two variables for each cluster and dimension (low, high), numbered by the column order: cluster_id, dim, side, var_id, desired, weight. desired: cluster_id, min_x, max_x, min_y, max_y, weight of clusters that have bounds to aim for."""
    r = numbered(rects.filter("min_x IS NOT NULL"), order)
    if desired is not None:
        r = r.join(desired.select("cluster_id", *[F.col(c).alias("own_" + c) for c in (*SIDES, "weight")]), "cluster_id", "left").withColumns({c: F.coalesce("own_" + c, c) for c in SIDES}).withColumn("weight", F.coalesce("own_weight", F.lit(weight)))
    else:
        r = r.withColumn("weight", F.lit(weight))
    four = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(s).alias("side"), F.col(c).alias("desired")) for d, s, c in ((0, 0, "min_x"), (0, 1, "max_x"), (1, 0, "min_y"), (1, 1, "max_y"))])).alias("v")
    return r.select("cluster_id", "rank", "weight", four).select("cluster_id", "v.dim", "v.side", (2 * F.col("rank") + F.col("v.side") + first_id).cast("long").alias("var_id"), "v.desired", "weight")
