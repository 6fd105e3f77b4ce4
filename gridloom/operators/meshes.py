"""Triangle meshes: faces (graph_id, face_idx, a, b, c) over nodes (graph_id, node_id, x, y, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def face_edges(faces: DataFrame) -> DataFrame:
    """graph_id, src, dst: the distinct undirected edges of the faces, src < dst; a corner given twice makes no edge with itself."""
    sides = F.explode(F.array(*[F.struct(F.least(p, q).alias("src"), F.greatest(p, q).alias("dst")) for p, q in (("a", "b"), ("b", "c"), ("a", "c"))])).alias("e")
    return faces.select("graph_id", sides).select("graph_id", "e.src", "e.dst").filter("src <> dst").distinct()


def _corner(nodes: DataFrame, corner: str) -> DataFrame:
    return nodes.select("graph_id", F.col("node_id").alias(corner), F.struct(*AXES).alias(f"at_{corner}"))


def face_normals(faces: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, face_idx, nx, ny, nz: the unit normal (b - a) x (c - a); zero for a face without area. Faces with unknown corners are left out."""
    at = faces
    for corner in ("a", "b", "c"):
        at = at.join(_corner(nodes, corner), ["graph_id", corner])
    u, v = [{k: F.col(f"at_{p}.{k}") - F.col(f"at_a.{k}") for k in AXES} for p in ("b", "c")]
    cross = {f"c{k}": u[p] * v[q] - u[q] * v[p] for k, p, q in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))}
    at = at.select("graph_id", "face_idx", *[c.alias(n) for n, c in cross.items()])
    size = F.sqrt(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy") + F.col("cz") * F.col("cz"))
    return at.select("graph_id", "face_idx", *[F.when(size > 0, F.try_divide(F.col(f"c{k}"), size)).otherwise(F.lit(0.0)).alias(f"n{k}") for k in AXES])


def mean_edge_length(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, mean_length: the mean distance of the ends of edges (graph_id, src, dst); graphs without edges are left out."""
    at = edges.select("graph_id", "src", "dst")
    for end in ("src", "dst"):
        at = at.join(_corner(nodes, end), ["graph_id", end])
    square = [(F.col(f"at_src.{k}") - F.col(f"at_dst.{k}")) * (F.col(f"at_src.{k}") - F.col(f"at_dst.{k}")) for k in AXES]
    return at.groupBy("graph_id").agg(F.avg(F.sqrt(square[0] + square[1] + square[2])).alias("mean_length"))


def merged_vertices(points: DataFrame, precision: float = 1e6) -> DataFrame:
    """graph_id, idx, vertex: points (graph_id, idx, x, y, z) whose rounded coordinates are equal are one vertex; vertices are numbered by their first points."""
    key = [F.floor(F.col(k) * precision + 0.5).alias(f"k{k}") for k in AXES]
    p = points.select("graph_id", "idx", *key)
    first = p.groupBy("graph_id", "kx", "ky", "kz").agg(F.min("idx").alias("first"))
    number = (F.row_number().over(Window.partitionBy("graph_id").orderBy("first")) - 1).cast("long")
    return p.join(first.withColumn("vertex", number), ["graph_id", "kx", "ky", "kz"]).select("graph_id", "idx", "vertex")


def face_colours(normals: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """graph_id, face_idx, red, green, blue of faces by their normals (face_normals): from the low colour for a face that looks down to the high one for a face that looks up."""
    up = (F.col("ny") + 1) / 2
    return normals.select("graph_id", "face_idx", *[(F.lit(float(a)) + (b - a) * up).alias(n) for n, a, b in zip(("red", "green", "blue"), low, high)])


def node_instances(nodes: DataFrame, radius: float, colour: tuple[float, float, float, float]) -> DataFrame:
    """graph_id, node_id, data: 16 values of a matrix that scales by the radius and moves to the node, column by column, and the colour."""
    r, z, one = F.lit(float(radius)), F.lit(0.0), F.lit(1.0)
    return nodes.select("graph_id", "node_id", F.array(r, z, z, z, z, r, z, z, z, z, r, z, "x", "y", "z", one, *map(F.lit, map(float, colour))).alias("data"))


def edge_instances(edges: DataFrame, nodes: DataFrame, radius: float, colour: tuple[float, float, float, float]) -> DataFrame:
    """graph_id, edge_idx, data: 16 values of a matrix that lays a unit rod along y from the edge's first end to its second, column by column, and the colour."""
    at = edges.select("graph_id", "edge_idx", "src", "dst")
    for end in ("src", "dst"):
        at = at.join(_corner(nodes, end), ["graph_id", end])
    d = {k: F.col(f"at_dst.{k}") - F.col(f"at_src.{k}") for k in AXES}
    at = at.withColumn("l", F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])).withColumn("l", F.when(F.col("l") > 0, F.col("l")).otherwise(F.lit(1e-6)))
    at = at.select("graph_id", "edge_idx", "at_src", "l", *[(d[k] / F.col("l")).alias(f"y{k}") for k in AXES])
    # A direction across the rod: in the plane of the floor, unless the rod is nearly upright.
    upright = F.abs("yy") >= 0.99
    side = {"x": F.when(upright, F.lit(0.0)).otherwise(F.col("yz")), "y": F.when(upright, -F.col("yz")).otherwise(F.lit(0.0)), "z": F.when(upright, F.col("yy")).otherwise(-F.col("yx"))}
    at = at.withColumns({f"x{k}": c for k, c in side.items()})
    size = F.sqrt(F.col("xx") * F.col("xx") + F.col("xy") * F.col("xy") + F.col("xz") * F.col("xz"))
    at = at.withColumn("s", size).withColumns({f"x{k}": F.col(f"x{k}") / F.when(F.col("s") > 0, F.col("s")).otherwise(F.lit(1e-6)) for k in AXES})
    at = at.withColumns({f"z{k}": F.col(f"x{p}") * F.col(f"y{q}") - F.col(f"x{q}") * F.col(f"y{p}") for k, p, q in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))})
    r, zero = F.lit(float(radius)), F.lit(0.0)
    columns = [*[F.col(f"x{k}") * r for k in AXES], zero, *[F.col(f"y{k}") * F.col("l") for k in AXES], zero, *[F.col(f"z{k}") * r for k in AXES], zero, *[F.col(f"at_src.{k}") for k in AXES], F.lit(1.0)]
    return at.select("graph_id", "edge_idx", F.array(*columns, *map(F.lit, map(float, colour))).alias("data"))
