"""Layout stress and its derivatives, as joins of pair distances with positions and sums by graph or node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: Weight of a lock, and the factor of a desired position's stress.
LOCK_WEIGHT, DESIRED_FACTOR = 10_000.0, 0.5


def placed_pairs(pairs: DataFrame, nodes: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """pairs (graph_id, u, v, d, g) with the differences of positions (dx, dy, dz: u minus v) and their length l."""
    at = lambda end: nodes.select("graph_id", F.col("node_id").alias(end), *[F.col(a).alias(f"{end}_{a}") for a in axes])
    p = pairs.join(at("u"), ["graph_id", "u"]).join(at("v"), ["graph_id", "v"])
    p = p.withColumns({f"d{a}": F.col(f"u_{a}") - F.col(f"v_{a}") for a in axes})
    return p.withColumn("l", F.sqrt(sum((F.col(f"d{a}") * F.col(f"d{a}") for a in axes), F.lit(0.0))))


def counted(p: DataFrame, neighbours_only: bool = False, skip_distant: bool = True) -> DataFrame:
    """Pairs that count: with neighbours_only those of an edge; with skip_distant not those beyond their distance that are no neighbours."""
    if neighbours_only:
        p = p.filter("g = 1")
    return p.filter("NOT (g = 2 AND l > d)") if skip_distant else p


def stress(p: DataFrame, nodes: DataFrame, locks: DataFrame | None = None, desired: DataFrame | None = None, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """graph_id, stress: over pairs u < v, plus locks (graph_id, node_id, axes) and desired positions (and weight)."""
    parts = [p.filter("u < v").select("graph_id", ((F.col("d") - F.col("l")) * (F.col("d") - F.col("l")) / (F.col("d") * F.col("d"))).alias("s"))]
    off = lambda a: (F.col(a) - F.col(f"to_{a}")) * (F.col(a) - F.col(f"to_{a}"))
    for side, factor in ((locks, F.lit(LOCK_WEIGHT)), (desired, DESIRED_FACTOR * F.col("weight") if desired is not None else None)):
        if side is not None:
            to = side.withColumnsRenamed({a: f"to_{a}" for a in axes})
            parts.append(nodes.join(to, ["graph_id", "node_id"]).select("graph_id", (factor * sum((off(a) for a in axes), F.lit(0.0))).alias("s")))
    total = parts[0]
    for q in parts[1:]:
        total = total.unionByName(q)
    total = total.groupBy("graph_id").agg(F.sum("s").alias("stress"))
    return nodes.select("graph_id").distinct().join(total, "graph_id", "left").select("graph_id", F.coalesce("stress", F.lit(0.0)).alias("stress"))


def lock_position(dim: Column) -> Column:
    """A lock's coordinate along a dim (columns x, y, z)."""
    return F.when(dim == 0, F.col("x")).when(dim == 1, F.col("y")).otherwise(F.col("z"))


def with_desired(grad: DataFrame, nodes: DataFrame, desired: DataFrame, axis: str) -> DataFrame:
    """A gradient with the pull of desired positions (graph_id, node_id, axis, weight): weight times how far a node is beyond its own."""
    own = desired.select("graph_id", F.col("node_id").alias("u"), F.col(axis).alias("to"), "weight").join(nodes.select("graph_id", F.col("node_id").alias("u"), F.col(axis).alias("at")), ["graph_id", "u"])
    pull = own.select("graph_id", "u", (F.col("weight") * (F.col("at") - F.col("to"))).alias("grad"))
    return grad.unionByName(pull).groupBy("graph_id", "u").agg(F.sum("grad").alias("grad"))


def largest(grad: DataFrame) -> DataFrame:
    """graph_id, largest: the largest absolute entry."""
    return grad.groupBy("graph_id").agg(F.max(F.abs("grad")).alias("largest"))


def reduction(trace: DataFrame) -> DataFrame:
    """graph_id, percent: how far the stress of the last iteration is below that of the first, in percent; null for one iteration or no stress at first. trace: graph_id, iteration, stress."""
    ends = trace.groupBy("graph_id").agg(F.min_by("stress", "iteration").alias("first"), F.max_by("stress", "iteration").alias("last"), F.count("*").alias("n"))
    return ends.select("graph_id", F.when((F.col("n") > 1) & (F.col("first") > 0), (F.col("first") - F.col("last")) / F.col("first") * 100).alias("percent"))


def gradient(p: DataFrame, axis: str) -> DataFrame:
    """graph_id, u, g along an axis; coincident pairs give nothing."""
    each = F.when(F.col("l") > 0, F.col(f"d{axis}") * (F.col("l") - F.col("d")) / (F.col("d") * F.col("d") * F.col("l"))).otherwise(F.lit(0.0))
    return p.groupBy("graph_id", "u").agg(F.sum(each).alias("grad"))


def hessian(p: DataFrame, axis: str, desired: DataFrame | None = None) -> DataFrame:
    """graph_id, i, j, v: the pairs' entries and the diagonal, which is minus a row's sum plus the weight of a desired position (graph_id, node_id, weight)."""
    l, d, a = F.col("l"), F.col("d"), F.col(f"d{axis}")
    h = F.when(l > 0, (d * (l * l - a * a) / (l * l * l) - 1) / (d * d)).otherwise(F.lit(0.0))
    off = p.select("graph_id", F.col("u").alias("i"), F.col("v").alias("j"), h.alias("v"))
    diagonal = off.select("graph_id", "i", (-F.col("v")).alias("v"))
    if desired is not None:
        diagonal = diagonal.unionByName(desired.select("graph_id", F.col("node_id").alias("i"), F.col("weight").alias("v")))
    return off.unionByName(diagonal.groupBy("graph_id", "i").agg(F.sum("v").alias("v")).select("graph_id", "i", F.col("i").alias("j"), "v"))


def step_size(grad: DataFrame, hess: DataFrame, way: DataFrame | None = None) -> DataFrame:
    """graph_id, step: g'd / d'Hd (0 if that vanishes), with d = g by default; way: graph_id, u, grad."""
    way = grad if way is None else way
    num = grad.join(way.withColumnRenamed("grad", "w"), ["graph_id", "u"]).groupBy("graph_id").agg(F.sum(F.col("grad") * F.col("w")).alias("num"))
    at = lambda end: way.select("graph_id", F.col("u").alias(end), F.col("grad").alias(f"w_{end}"))
    den = hess.join(at("i"), ["graph_id", "i"]).join(at("j"), ["graph_id", "j"]).groupBy("graph_id").agg(F.sum(F.col("v") * F.col("w_i") * F.col("w_j")).alias("den"))
    return num.join(den, "graph_id").select("graph_id", F.when(F.abs("den") < 1e-30, F.lit(0.0)).otherwise(F.try_divide("num", "den")).alias("step"))


def runge_kutta(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Four positions combined."""
    return (a + 2 * b + 2 * c + d) / 6


def converged(trace: DataFrame, tolerance: float = 1e-4, max_iterations: int = 100) -> DataFrame:
    """graph_id, iteration (from 1), stress, done: the relative decrease is below tolerance (a rise too), or the iterations are used up (the first test: iteration >= max; later ones: iteration > max)."""
    from pyspark.sql import Window

    old = F.lag("stress").over(Window.partitionBy("graph_id").orderBy("iteration"))
    t = trace.withColumn("old", old)
    small = (F.col("old") - F.col("stress")) / (F.col("stress") + 1e-30) < tolerance
    return t.select("graph_id", "iteration", "stress", F.when(F.col("old").isNull(), F.col("iteration") >= max_iterations).otherwise(small | (F.col("iteration") > max_iterations)).alias("done"))
