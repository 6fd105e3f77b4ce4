"""The registered queries of the layout operators over the given tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prng
from ..functions import rectangles as R
from ..operators import clusters as C
from ..operators import graph as G
from ..operators import linalg as L
from ..operators import meshes as M
from ..operators import overlap as O
from ..operators import placement as P
from ..operators import projection as Q
from ..operators import quadratic as D
from ..operators import stress as S
from ..operators import tiles as K
from ..operators.layout import LayoutSpec, layout
from ..sources import tables as T
from .table_functions import register

IDEAL = 10.0
QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: The derived inputs in SQL, as common table expressions.
WITH = f"""
WITH RECURSIVE rects0 AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST((p_partkey * 37) % 500 AS DOUBLE) AS cx, CAST((p_partkey * 91) % 500 AS DOUBLE) AS cy, CAST(p_size AS DOUBLE) AS w, CAST(p_size % 10 + 1 AS DOUBLE) AS h FROM part),
rects AS (SELECT CAST(floor(k / {T.CANVAS}) AS BIGINT) AS group_id, k AS rect_id, cx, cy, w, h, cx - w / 2 AS min_x, cx + w / 2 AS max_x, cy - h / 2 AS min_y, cy + h / 2 AS max_y FROM rects0),
wide AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 + p_partkey % 7 END::BIGINT AS group_id, k AS rect_id, w, h, cx + 500 * floor(k / 2500) AS cx, cy, cx + 500 * floor(k / 2500) - w / 2 AS min_x, cx + 500 * floor(k / 2500) + w / 2 AS max_x, cy - h / 2 AS min_y, cy + h / 2 AS max_y FROM rects0 JOIN part ON p_partkey = k),
nodes AS (SELECT CAST(floor(c_custkey / {T.GRAPH}) AS BIGINT) AS graph_id, CAST(c_custkey % {T.GRAPH} AS BIGINT) AS node_id, CAST((c_custkey * 37) % 101 AS DOUBLE) AS x, CAST((c_custkey * 91) % 103 AS DOUBLE) AS y, CAST((c_custkey * 53) % 97 AS DOUBLE) AS z, 12.0::DOUBLE AS w, 8.0::DOUBLE AS h FROM customer),
edges0 AS (SELECT graph_id, node_id * 2 AS edge_idx, node_id AS src, node_id + 1 AS dst, CAST(node_id % 3 + 1 AS DOUBLE) AS length FROM nodes WHERE node_id % 7 <> 6 AND node_id < {T.GRAPH - 1}
  UNION ALL SELECT graph_id, node_id * 2 + 1, node_id, (node_id * 3) % 7, CASE WHEN node_id % 8 = 1 THEN 2.0 END FROM nodes WHERE node_id % 4 = 1),
edges AS (SELECT e.* FROM edges0 e JOIN nodes a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN nodes b ON b.graph_id = e.graph_id AND b.node_id = e.dst),
clean AS (SELECT graph_id, edge_idx, src, dst, CASE WHEN coalesce(length, 1.0) > 0 THEN coalesce(length, 1.0) ELSE 1.0 END AS length FROM edges WHERE src <> dst),
both_ways AS (SELECT * FROM clean UNION ALL SELECT graph_id, edge_idx, dst, src, length FROM clean),
d1 AS (SELECT graph_id, src AS u, dst AS v, min(length) AS d FROM (SELECT graph_id, src, dst, length FROM both_ways UNION ALL SELECT graph_id, node_id, node_id, 0.0 FROM nodes) GROUP BY ALL),
d2 AS (SELECT a.graph_id, a.u, b.v, min(a.d + b.d) AS d FROM d1 a JOIN d1 b ON a.graph_id = b.graph_id AND a.v = b.u GROUP BY ALL),
d4 AS (SELECT a.graph_id, a.u, b.v, min(a.d + b.d) AS d FROM d2 a JOIN d2 b ON a.graph_id = b.graph_id AND a.v = b.u GROUP BY ALL),
d8 AS (SELECT a.graph_id, a.u, b.v, min(a.d + b.d) AS d FROM d4 a JOIN d4 b ON a.graph_id = b.graph_id AND a.v = b.u GROUP BY ALL),
d16 AS (SELECT a.graph_id, a.u, b.v, min(a.d + b.d) AS d FROM d8 a JOIN d8 b ON a.graph_id = b.graph_id AND a.v = b.u GROUP BY ALL),
apsp AS (SELECT a.graph_id, a.u, b.v, min(a.d + b.d) AS d FROM d16 a JOIN d16 b ON a.graph_id = b.graph_id AND a.v = b.u GROUP BY ALL),
comp AS (SELECT graph_id, u AS node_id, min(v) AS component_id FROM apsp GROUP BY ALL),
labels AS (SELECT *, row_number() OVER (PARTITION BY graph_id, component_id ORDER BY node_id) - 1 AS local_idx FROM comp),
pairs AS (SELECT p.graph_id, p.u, p.v, p.d * {IDEAL} AS d, CASE WHEN EXISTS (SELECT 1 FROM both_ways e WHERE e.graph_id = p.graph_id AND e.src = p.u AND e.dst = p.v) THEN 1 ELSE 2 END AS g FROM apsp p WHERE p.u <> p.v),
pos3 AS (SELECT p.*, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz FROM pairs p JOIN nodes a ON a.graph_id = p.graph_id AND a.node_id = p.u JOIN nodes b ON b.graph_id = p.graph_id AND b.node_id = p.v),
pos2 AS (SELECT *, sqrt(dx * dx + dy * dy) AS l, sqrt(dx * dx + dy * dy + dz * dz) AS l3 FROM pos3),
used AS (SELECT * FROM pos2 WHERE NOT (g = 2 AND l > d)),
mat AS (SELECT CAST(floor(l_orderkey / 256) AS BIGINT) AS m_id, l_partkey % 32 AS i, l_suppkey % 32 AS j, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY ALL),
vec AS (SELECT m_id, i, CAST((m_id * 7 + i * 3) % 11 AS DOUBLE) AS v FROM (SELECT DISTINCT m_id, i FROM mat UNION SELECT DISTINCT m_id, j FROM mat)),
chain AS (SELECT CAST(o_custkey AS BIGINT) AS problem_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS var_id, CAST((o_orderkey * 37) % 50 AS DOUBLE) AS desired FROM orders)
"""


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = WITH + sql
        return f

    return add


def r(c: Column | str, n: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, n) + F.lit(0.0)


def bordered(spark, d) -> DataFrame:
    return T.part_rects(spark, d).withColumns({"x_border": F.lit(1.0), "y_border": F.lit(0.5)})


@query("SELECT group_id, rect_id, min_x - 1 AS low_x, max_x + 1 AS high_x, min_y - 0.5 AS low_y, max_y + 0.5 AS high_y, w + 2 AS width, h + 1 AS height, cx AS centre_x, cy AS centre_y, true AS valid FROM rects")
def rect_measures(spark, d):
    return bordered(spark, d).select("group_id", "rect_id", R.low(0).alias("low_x"), R.high(0).alias("high_x"), R.low(1).alias("low_y"), R.high(1).alias("high_y"), R.extent(0).alias("width"), R.extent(1).alias("height"), R.centre(0).alias("centre_x"), R.centre(1).alias("centre_y"), R.is_valid().alias("valid"))


@query("SELECT rect_id, dim, CASE dim WHEN 0 THEN min_x WHEN 1 THEN min_y ELSE 0 END AS low, CASE dim WHEN 0 THEN w WHEN 1 THEN h ELSE 0 END AS extent, CASE dim WHEN 0 THEN cx WHEN 1 THEN cy ELSE 0 END AS centre, CASE dim WHEN 0 THEN 1 ELSE 0 END AS conjugate FROM rects, (VALUES (0), (1), (2)) t(dim)")
def rect_dim_accessors(spark, d):
    rects = T.part_rects(spark, d).withColumn("dim", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    return rects.select("rect_id", "dim", R.by_dim(F.col("dim"), R.low).alias("low"), R.by_dim(F.col("dim"), R.extent).alias("extent"), R.by_dim(F.col("dim"), R.centre).alias("centre"), R.conjugate(F.col("dim")).alias("conjugate"))


@query("SELECT rect_id, 100 - w / 2 AS min_x, 100 - w / 2 + 20 AS max_x, min_y + 3 AS min_y, min_y + 8 AS max_y FROM rects")
def rect_moves(spark, d):
    out = R.resized(R.centred(T.part_rects(spark, d), x=F.lit(100.0)), width=F.lit(20.0))
    out = R.moved(out, F.lit(0.0), F.lit(3.0))
    return R.with_axis(out, R.Y, F.col("min_y"), F.col("min_y") + 5).select("rect_id", "min_x", "max_x", "min_y", "max_y")


@query("SELECT group_id, min(min_x) - 5 AS min_x, max(max_x) AS max_x, min(min_y) - 2 AS min_y, max(max_y) + 1 AS max_y FROM rects GROUP BY group_id")
def rect_union_box(spark, d):
    return R.expanded(T.part_rects(spark, d).groupBy("group_id").agg(*R.union_bounds()), 5, -3, 2, 1)


@query("SELECT rect_id, dim, CASE dim WHEN 0 THEN m WHEN 1 THEN m ELSE 0 END::DOUBLE AS low_side, CASE dim WHEN 0 THEN m WHEN 1 THEN m ELSE 0 END::DOUBLE AS high_side, m = 0 AS empty FROM (SELECT rect_id, greatest(0, rect_id % 5 - 2) AS m FROM rects), (VALUES (0), (1), (2)) t(dim)")
def rect_boxes(spark, d):
    rects = R.checked(T.part_rects(spark, d)).withColumn("dim", F.explode(F.array(*map(F.lit, (0, 1, 2))))).withColumn("box", R.uniform_box(F.col("rect_id") % 5 - 2))
    side = lambda high: R.box_side(F.col("box"), F.col("dim"), high)
    return rects.select("rect_id", "dim", side(False).alias("low_side"), side(True).alias("high_side"), R.box_is_empty(F.col("box")).alias("empty"))


_PAIRS = """, hit AS (SELECT a.group_id, a.rect_id AS a, b.rect_id AS b, a.cx AS ax, b.cx AS bx, a.cy AS ay, b.cy AS by_, a.min_x AS a0, a.max_x AS a1, b.min_x AS b0, b.max_x AS b1, a.min_y AS a2, a.max_y AS a3, b.min_y AS b2, b.max_y AS b3
  FROM rects a JOIN rects b ON a.group_id = b.group_id AND a.rect_id < b.rect_id AND a.min_x < b.max_x AND b.min_x < a.max_x AND a.min_y < b.max_y AND b.min_y < a.max_y)"""


@query(_PAIRS + " SELECT group_id, a, b, CASE WHEN ax <= bx AND b0 < a1 THEN a1 - b0 WHEN bx <= ax AND a0 < b1 THEN b1 - a0 ELSE 0 END AS overlap_x, CASE WHEN ay <= by_ AND b2 < a3 THEN a3 - b2 WHEN by_ <= ay AND a2 < b3 THEN b3 - a2 ELSE 0 END AS overlap_y FROM hit")
def rect_overlap_pairs(spark, d):
    return R.overlap_pairs(T.part_rects(spark, d))


@query(_PAIRS + " SELECT g.group_id, NOT EXISTS (SELECT 1 FROM hit WHERE hit.group_id = g.group_id) AS no_overlaps FROM (SELECT DISTINCT group_id FROM rects) g")
def rect_no_overlaps_flag(spark, d):
    rects = T.part_rects(spark, d)
    hit = R.overlap_pairs(rects).select("group_id").distinct().withColumn("hit", F.lit(True))
    return rects.select("group_id").distinct().join(hit, "group_id", "left").select("group_id", F.col("hit").isNull().alias("no_overlaps"))


@query(_PAIRS.replace("rects", "wide") + " SELECT group_id, a, b, CASE WHEN ax <= bx AND b0 < a1 THEN a1 - b0 WHEN bx <= ax AND a0 < b1 THEN b1 - a0 ELSE 0 END AS overlap_x, CASE WHEN ay <= by_ AND b2 < a3 THEN a3 - b2 WHEN by_ <= ay AND a2 < b3 THEN b3 - a2 ELSE 0 END AS overlap_y FROM hit")
def rect_overlap_pairs_wide(spark, d):
    """Few large groups, one with a third of all rows."""
    return R.overlap_pairs(T.wide_rects(spark, d))


@query("SELECT q.group_id, q.rect_id AS point_id, s.rect_id FROM wide q JOIN wide s ON q.group_id = s.group_id AND q.min_x + 1 > s.min_x AND q.min_x + 1 < s.max_x AND q.cy > s.min_y AND q.cy < s.max_y")
def rect_point_inside(spark, d):
    """Points right of the low edges, in their own and other rectangles."""
    rects = T.wide_rects(spark, d)
    points = rects.select("group_id", F.col("rect_id").alias("point_id"), (F.col("min_x") + 1).alias("x"), R.centre(1).alias("y"))
    return R.points_inside(points, rects)


@query("SELECT rect_id, printf('Rect(%.2f, %.2f, %.2f, %.2f)', min_x, max_x, min_y, max_y) AS short, 'Rectangle[(' || regexp_replace((min_x - 1)::VARCHAR, '\\.0$', '') || ',' || regexp_replace((min_y - 0.5)::VARCHAR, '\\.0$', '') || '),(' || regexp_replace((max_x + 1)::VARCHAR, '\\.0$', '') || ',' || regexp_replace((max_y + 0.5)::VARCHAR, '\\.0$', '') || ')]' AS long FROM rects")
def rect_text(spark, d):
    return bordered(spark, d).select("rect_id", R.short_text().alias("short"), R.text().alias("long"))


@query("SELECT rect_id, cx AS min_x, cx + w AS max_x, cy AS min_y, cy + 2 * h AS max_y FROM rects")
def rect_resize_target(spark, d):
    """Targets of a resize: the old centre is the new low corner, the height doubles."""
    return T.part_rects(spark, d).select("rect_id", *R.from_corner(R.centre(0), R.centre(1), R.extent(0), 2 * R.extent(1)))


def _graph(spark, d):
    return T.customer_edges(spark, d), T.customer_nodes(spark, d)


@query("SELECT * FROM clean")
def edge_sanitise(spark, d):
    return G.sanitised(*_graph(spark, d))


@query("SELECT graph_id, u, v, arg_max(length, edge_idx) AS weight FROM (SELECT graph_id, src AS u, dst AS v, length, edge_idx FROM both_ways) GROUP BY ALL")
def adjacency_matrix(spark, d):
    return G.adjacency(G.sanitised(*_graph(spark, d)))


@query("SELECT n.graph_id, n.node_id, count(e.src) AS degree, coalesce(string_agg(DISTINCT e.dst::VARCHAR, ',' ORDER BY e.dst::VARCHAR), '') AS neighbours FROM nodes n LEFT JOIN both_ways e ON e.graph_id = n.graph_id AND e.src = n.node_id GROUP BY ALL")
def degree(spark, d):
    e, n = _graph(spark, d)
    out = G.degrees(G.sanitised(e, n), n)
    return out.withColumn("neighbours", F.array_join(F.array_sort(F.transform("neighbours", lambda v: v.cast("string"))), ","))


@query("SELECT graph_id, u, v, d FROM apsp")
def apsp_weighted(spark, d):
    return G.all_pairs(*_graph(spark, d))


_HOPS = ", h1 AS (SELECT graph_id, src AS u, dst AS v, min(d) AS d FROM (SELECT graph_id, src, dst, 1.0::DOUBLE AS d FROM both_ways UNION ALL SELECT graph_id, node_id, node_id, 0.0 FROM nodes) GROUP BY ALL)" + "".join(
    f", h{2 * k} AS (SELECT a.graph_id, a.u, b.v, min(a.d + b.d) AS d FROM h{k} a JOIN h{k} b ON a.graph_id = b.graph_id AND a.v = b.u GROUP BY ALL)" for k in (1, 2, 4, 8, 16)
)


@query(_HOPS + " SELECT graph_id, u, v, d FROM h32")
def apsp_hops(spark, d):
    """Edges counted, not measured."""
    e, n = _graph(spark, d)
    return G.all_pairs(e.withColumn("length", F.lit(1.0)), n)


@query("SELECT graph_id, u, v, d FROM apsp")
def apsp_frontier(spark, d):
    return G.all_pairs_by_frontier(*_graph(spark, d))


@query("SELECT graph_id, u, v, d FROM apsp")
def apsp_tiles(spark, d):
    """Tiles of 8 nodes, so that every graph has several."""
    return K.all_pairs_by_tiles(*_graph(spark, d), side=8)


@query("SELECT graph_id, u AS source, v AS node_id, d FROM apsp WHERE u = 1")
def sssp_frontier(spark, d):
    e, n = _graph(spark, d)
    return G.single_source(e, n, n.filter("node_id = 1").select("graph_id", F.col("node_id").alias("source")))


@query("SELECT graph_id, u, v, d, g FROM pairs")
def dg_matrix(spark, d):
    return G.pair_classes(*_graph(spark, d), IDEAL)


@query("SELECT graph_id, coalesce(min(d) FILTER (d > 0), 1) AS min_d FROM (SELECT DISTINCT graph_id FROM nodes) LEFT JOIN pairs USING (graph_id) GROUP BY graph_id")
def min_d(spark, d):
    e, n = _graph(spark, d)
    return G.least_distance(G.pair_classes(e, n, IDEAL), n)


@query("SELECT * FROM labels")
def connected_components(spark, d):
    return G.components(*_graph(spark, d))


@query("SELECT e.graph_id, a.component_id, edge_idx, a.local_idx AS src, b.local_idx AS dst FROM clean e JOIN labels a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN labels b ON b.graph_id = e.graph_id AND b.node_id = e.dst")
def component_edges_local(spark, d):
    e, n = _graph(spark, d)
    return G.component_edges(e, n, G.components(e, n))


@query("SELECT graph_id, component_id, min(x - w / 2) AS min_x, max(x + w / 2) AS max_x, min(y - h / 2) AS min_y, max(y + h / 2) AS max_y FROM nodes JOIN labels USING (graph_id, node_id) GROUP BY ALL")
def component_bbox(spark, d):
    e, n = _graph(spark, d)
    return n.join(G.components(e, n), ["graph_id", "node_id"]).groupBy("graph_id", "component_id").agg(F.min(F.col("x") - F.col("w") / 2).alias("min_x"), F.max(F.col("x") + F.col("w") / 2).alias("max_x"), F.min(F.col("y") - F.col("h") / 2).alias("min_y"), F.max(F.col("y") + F.col("h") / 2).alias("max_y"))


def _strip(spark, d):
    """Triangles of three customers in a row."""
    n = T.customer_nodes(spark, d)
    at = lambda k, c: n.select("graph_id", (F.col("node_id") - k).alias("a"), F.col("node_id").alias(c))
    return n.select("graph_id", F.col("node_id").alias("a")).join(at(1, "b"), ["graph_id", "a"]).join(at(2, "c"), ["graph_id", "a"]).withColumn("face_idx", F.col("a")), n


_STRIP = ", face AS (SELECT a.graph_id, a.node_id AS a, b.node_id AS b, c.node_id AS c, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz FROM nodes a JOIN nodes b ON b.graph_id = a.graph_id AND b.node_id = a.node_id + 1 JOIN nodes c ON c.graph_id = a.graph_id AND c.node_id = a.node_id + 2)"


@query(_STRIP + " SELECT graph_id, a AS src, b AS dst FROM face UNION SELECT graph_id, b, c FROM face UNION SELECT graph_id, a, c FROM face")
def mesh_unique_edges(spark, d):
    return M.face_edges(_strip(spark, d)[0])


@query(_STRIP + """, n AS (SELECT graph_id, a AS face_idx, uy * vz - uz * vy AS x, uz * vx - ux * vz AS y, ux * vy - uy * vx AS z FROM face), s AS (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM n)
SELECT graph_id, face_idx, round(CASE WHEN l > 0 THEN x / l ELSE 0 END, 6) + 0.0 AS nx, round(CASE WHEN l > 0 THEN y / l ELSE 0 END, 6) + 0.0 AS ny, round(CASE WHEN l > 0 THEN z / l ELSE 0 END, 6) + 0.0 AS nz FROM s""")
def mesh_face_normals(spark, d):
    return M.face_normals(*_strip(spark, d)).select("graph_id", "face_idx", r("nx").alias("nx"), r("ny").alias("ny"), r("nz").alias("nz"))


@query("SELECT e.graph_id, round(avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))), 6) + 0.0 AS mean_length FROM clean e JOIN nodes a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN nodes b ON b.graph_id = e.graph_id AND b.node_id = e.dst GROUP BY 1")
def mesh_mean_edge(spark, d):
    e, n = _graph(spark, d)
    return M.mean_edge_length(G.sanitised(e, n), n).select("graph_id", r("mean_length").alias("mean_length"))


@query("SELECT graph_id, node_id AS idx, dense_rank() OVER (PARTITION BY graph_id ORDER BY first) - 1 AS vertex FROM (SELECT graph_id, node_id, min(node_id) OVER (PARTITION BY graph_id, floor(x / 25), floor(y / 25), floor(z / 50)) AS first FROM nodes)")
def mesh_merged_vertices(spark, d):
    """Coordinates in cells, moved apart by less than the precision."""
    n = T.customer_nodes(spark, d)
    near = (F.col("node_id") % 3) * 1e-8
    return M.merged_vertices(n.select("graph_id", F.col("node_id").alias("idx"), (F.floor(F.col("x") / 25) + near).alias("x"), (F.floor(F.col("y") / 25) - near).alias("y"), F.floor(F.col("z") / 50).alias("z")))


@query(_STRIP + """, n AS (SELECT graph_id, a AS face_idx, uy * vz - uz * vy AS x, uz * vx - ux * vz AS y, ux * vy - uy * vx AS z FROM face), s AS (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM n), t AS (SELECT graph_id, face_idx, (CASE WHEN l > 0 THEN y / l ELSE 0 END) * 0.5 + 0.5 AS t FROM s)
SELECT graph_id, face_idx, round(0.2 * (1 - t) + 0.9 * t, 6) + 0.0 AS red, round(0.4 * (1 - t) + 0.5 * t, 6) + 0.0 AS green, round(0.8 * (1 - t) + 0.1 * t, 6) + 0.0 AS blue FROM t""")
def mesh_face_colours(spark, d):
    c = M.face_colours(M.face_normals(*_strip(spark, d)), (0.2, 0.4, 0.8), (0.9, 0.5, 0.1))
    return c.select("graph_id", "face_idx", r("red").alias("red"), r("green").alias("green"), r("blue").alias("blue"))


@query("SELECT graph_id, node_id, unnest([2.0, 0, 0, 0, 0, 2, 0, 0, 0, 0, 2, 0, x, y, z, 1, 0.5, 0.25, 0.75, 1]::DOUBLE[]) AS v, generate_subscripts([2.0, 0, 0, 0, 0, 2, 0, 0, 0, 0, 2, 0, x, y, z, 1, 0.5, 0.25, 0.75, 1]::DOUBLE[], 1)::INT - 1 AS pos FROM nodes")
def mesh_node_instances(spark, d):
    return M.node_instances(T.customer_nodes(spark, d), 2.0, (0.5, 0.25, 0.75, 1.0)).select("graph_id", "node_id", F.posexplode("data").alias("pos", "v"))


@query(""", ends AS (SELECT e.graph_id, e.edge_idx, a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM clean e JOIN nodes a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN nodes b ON b.graph_id = e.graph_id AND b.node_id = e.dst),
len AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS l FROM ends), u AS (SELECT *, dx / l AS yx, dy / l AS yy, dz / l AS yz FROM len), f AS (SELECT *, CASE WHEN abs(yy) < 0.99 THEN yz ELSE 0 END AS px, CASE WHEN abs(yy) < 0.99 THEN 0 ELSE -yz END AS py, CASE WHEN abs(yy) < 0.99 THEN -yx ELSE yy END AS pz FROM u),
g AS (SELECT *, px / sqrt(px * px + py * py + pz * pz) AS xx, py / sqrt(px * px + py * py + pz * pz) AS xy, pz / sqrt(px * px + py * py + pz * pz) AS xz FROM f)
SELECT graph_id, edge_idx, round(xx + 2 * xy + 3 * xz, 5) + 0.0 AS across, round(dx + 2 * dy + 3 * dz, 5) + 0.0 AS along, round((xy * yz - xz * yy) + 2 * (xz * yx - xx * yz) + 3 * (xx * yy - xy * yx), 5) + 0.0 AS third, ax + 2 * ay + 3 * az AS origin FROM g""")
def mesh_edge_instances(spark, d):
    """The four columns of each matrix, each as one weighted sum; the rod has a radius of 1."""
    e, n = _graph(spark, d)
    data = F.col("data")
    column = lambda k: data[4 * k] + 2 * data[4 * k + 1] + 3 * data[4 * k + 2]
    return M.edge_instances(G.sanitised(e, n), n, 1.0, (0.0, 0.0, 0.0, 1.0)).select("graph_id", "edge_idx", r(column(0), 5).alias("across"), r(column(1), 5).alias("along"), r(column(2), 5).alias("third"), column(3).alias("origin"))


_TURN = lambda p, q, s: f"sign(({q}.x - {p}.x) * ({s}.y - {p}.y) - ({q}.y - {p}.y) * ({s}.x - {p}.x))"


@query(f""", ends AS (SELECT e.graph_id, e.edge_idx, e.src, e.dst, {{'x': a.x, 'y': a.y}} AS p, {{'x': b.x, 'y': b.y}} AS q FROM clean e JOIN nodes a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN nodes b ON b.graph_id = e.graph_id AND b.node_id = e.dst),
hits AS (SELECT a.graph_id, count(*) AS n FROM ends a JOIN ends b ON a.graph_id = b.graph_id AND a.edge_idx < b.edge_idx AND a.src <> b.src AND a.src <> b.dst AND a.dst <> b.src AND a.dst <> b.dst
  WHERE {_TURN('a.p', 'a.q', 'b.p')} * {_TURN('a.p', 'a.q', 'b.q')} < 0 AND {_TURN('b.p', 'b.q', 'a.p')} * {_TURN('b.p', 'b.q', 'a.q')} < 0 GROUP BY 1)
SELECT graph_id, coalesce(n, 0) AS crossings FROM (SELECT DISTINCT graph_id FROM nodes) LEFT JOIN hits USING (graph_id)""")
def edge_crossings(spark, d):
    return G.edge_crossings(*_graph(spark, d))


def _placed(spark, d, axes=("x", "y")):
    e, n = _graph(spark, d)
    return S.placed_pairs(G.pair_classes(e, n, IDEAL), n, axes), n


_STRESS = "SELECT graph_id, round(coalesce(s, 0), 6) + 0.0 AS stress FROM (SELECT DISTINCT graph_id FROM nodes) LEFT JOIN (SELECT graph_id, sum((d - {l}) * (d - {l}) / (d * d)) AS s FROM {t} WHERE u < v GROUP BY 1) USING (graph_id)"


@query(_STRESS.format(l="l", t="used"))
def stress_total(spark, d):
    p, n = _placed(spark, d)
    return S.stress(S.counted(p), n).select("graph_id", r("stress").alias("stress"))


@query(_STRESS.format(l="l", t="(SELECT * FROM pos2 WHERE g = 1)"))
def stress_neighbour_only(spark, d):
    p, n = _placed(spark, d)
    return S.stress(S.counted(p, neighbours_only=True), n).select("graph_id", r("stress").alias("stress"))


@query(_STRESS.format(l="l3", t="pos2"))
def stress_skip_off(spark, d):
    p, n = _placed(spark, d, S.AXES)
    return S.stress(S.counted(p, skip_distant=False), n, axes=S.AXES).select("graph_id", r("stress").alias("stress"))


@query("""SELECT graph_id, round(coalesce(s, 0) + coalesce(t, 0), 4) + 0.0 AS stress FROM (SELECT DISTINCT graph_id FROM nodes) LEFT JOIN (SELECT graph_id, sum((d - l) * (d - l) / (d * d)) AS s FROM used WHERE u < v GROUP BY 1) USING (graph_id)
LEFT JOIN (SELECT graph_id, sum(CASE WHEN node_id = 0 THEN 10000 * (1 + 4) WHEN node_id = 1 THEN 0.5 * 3 * (9 + 0) ELSE 0 END) AS t FROM nodes GROUP BY 1) USING (graph_id)""")
def stress_locks_desired(spark, d):
    p, n = _placed(spark, d)
    locks = n.filter("node_id = 0").select("graph_id", "node_id", (F.col("x") + 1).alias("x"), (F.col("y") - 2).alias("y"))
    wish = n.filter("node_id = 1").select("graph_id", "node_id", (F.col("x") + 3).alias("x"), "y", F.lit(3.0).alias("weight"))
    return S.stress(S.counted(p), n, locks, wish).select("graph_id", r("stress", 4).alias("stress"))


_GRAD = "grad AS (SELECT graph_id, u, sum(CASE WHEN l > 0 THEN dx * (l - d) / (d * d * l) ELSE 0 END) AS grad FROM used GROUP BY ALL), off AS (SELECT graph_id, u AS i, v AS j, CASE WHEN l > 0 THEN (d * (l * l - dx * dx) / (l * l * l) - 1) / (d * d) ELSE 0 END AS v FROM used), hess AS (SELECT * FROM off UNION ALL SELECT graph_id, i, i, -sum(v) FROM off GROUP BY ALL)"


@query(f", {_GRAD} SELECT graph_id, u, round(grad, 8) + 0.0 AS grad FROM grad")
def forces_gradient_x(spark, d):
    p, _ = _placed(spark, d)
    return S.gradient(S.counted(p), "x").select("graph_id", "u", r("grad", 8).alias("grad"))


_ALONG = "SELECT graph_id, u, round(sum(CASE WHEN l > 0 THEN dy * (l - d) / (d * d * l) ELSE 0 END), 8) + 0.0 AS grad FROM used GROUP BY ALL"


@query(_ALONG)
def forces_gradient_y(spark, d):
    p, _ = _placed(spark, d)
    return S.gradient(S.counted(p), "y").select("graph_id", "u", r("grad", 8).alias("grad"))


@query(", g AS (" + _ALONG + ") SELECT graph_id, max(abs(grad)) AS largest FROM g GROUP BY 1")
def largest_force(spark, d):
    return S.largest(forces_gradient_y(spark, d))


def _wish(n):
    return n.filter("node_id % 5 = 1").select("graph_id", "node_id", (F.col("x") + 3).alias("x"), F.lit(0.25).alias("weight"))


@query(", g AS (SELECT graph_id, u, sum(CASE WHEN l > 0 THEN dx * (l - d) / (d * d * l) ELSE 0 END) AS g FROM used GROUP BY ALL UNION ALL SELECT graph_id, node_id, -0.75 FROM nodes WHERE node_id % 5 = 1) SELECT graph_id, u, round(sum(g), 8) + 0.0 AS grad FROM g GROUP BY ALL")
def forces_desired_x(spark, d):
    p, n = _placed(spark, d)
    return S.with_desired(S.gradient(S.counted(p), "x"), n, _wish(n), "x").select("graph_id", "u", r("grad", 8).alias("grad"))


@query("SELECT graph_id, u, round(sum(CASE WHEN l3 > 0 THEN dz * (l3 - d) / (d * d * l3) ELSE 0 END), 8) + 0.0 AS grad FROM pos2 GROUP BY ALL")
def forces_gradient_z(spark, d):
    p, _ = _placed(spark, d, S.AXES)
    return S.gradient(p, "z").select("graph_id", "u", r("grad", 8).alias("grad"))


@query(f", {_GRAD} SELECT graph_id, i, j, round(v, 8) + 0.0 AS v FROM hess")
def hessian_x(spark, d):
    p, _ = _placed(spark, d)
    return S.hessian(S.counted(p), "x").select("graph_id", "i", "j", r("v", 8).alias("v"))


@query(f", {_GRAD}, more AS (SELECT * FROM hess UNION ALL SELECT graph_id, node_id, node_id, 0.25 FROM nodes WHERE node_id % 5 = 1) SELECT graph_id, i, j, round(sum(v), 8) + 0.0 AS v FROM more GROUP BY ALL")
def hessian_desired_x(spark, d):
    p, n = _placed(spark, d)
    return S.hessian(S.counted(p), "x", _wish(n)).select("graph_id", "i", "j", r("v", 8).alias("v"))


_HESS = ", off AS (SELECT graph_id, u AS i, v AS j, CASE WHEN {l} > 0 THEN (d * ({l} * {l} - {a} * {a}) / ({l} * {l} * {l}) - 1) / (d * d) ELSE 0 END AS v FROM {t}) SELECT graph_id, i, j, round(v, 8) + 0.0 AS v FROM off UNION ALL SELECT graph_id, i, i, round(-sum(v), 8) + 0.0 FROM off GROUP BY ALL"


@query(_HESS.format(l="l", a="dy", t="used"))
def hessian_y(spark, d):
    p, _ = _placed(spark, d)
    return S.hessian(S.counted(p), "y").select("graph_id", "i", "j", r("v", 8).alias("v"))


@query(_HESS.format(l="l3", a="dz", t="pos2"))
def hessian_z(spark, d):
    p, _ = _placed(spark, d, S.AXES)
    return S.hessian(p, "z").select("graph_id", "i", "j", r("v", 8).alias("v"))


@query(f", {_GRAD}, num AS (SELECT graph_id, sum(grad * grad) AS num FROM grad GROUP BY 1), den AS (SELECT h.graph_id, sum(h.v * a.grad * b.grad) AS den FROM hess h JOIN grad a ON a.graph_id = h.graph_id AND a.u = h.i JOIN grad b ON b.graph_id = h.graph_id AND b.u = h.j GROUP BY 1) SELECT graph_id, round(CASE WHEN abs(den) < 1e-30 THEN 0 ELSE num / den END, 3) + 0.0 AS step FROM num JOIN den USING (graph_id)")
def step_size(spark, d):
    p, _ = _placed(spark, d)
    p = S.counted(p)
    return S.step_size(S.gradient(p, "x"), S.hessian(p, "x")).select("graph_id", r("step", 3).alias("step"))


@query("""SELECT o_custkey AS graph_id, n AS iteration, s AS stress, CASE WHEN n = 1 THEN false ELSE (old - s) / (s + 1e-30) < 0.0001 OR n > 5 END AS done FROM
(SELECT o_custkey, row_number() OVER w AS n, CAST(o_totalprice AS DOUBLE) AS s, lag(CAST(o_totalprice AS DOUBLE)) OVER w AS old FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))""")
def convergence_trace(spark, d):
    from pyspark.sql import Window

    o = T.read(spark, d, "orders")
    t = o.select(F.col("o_custkey").alias("graph_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("iteration"), F.col("o_totalprice").cast("double").alias("stress"))
    return S.converged(t, max_iterations=5)


@query("SELECT o_custkey AS graph_id, CASE WHEN count(*) > 1 AND arg_min(o_totalprice, o_orderkey) > 0 THEN round(CAST((arg_min(o_totalprice, o_orderkey) - arg_max(o_totalprice, o_orderkey)) AS DOUBLE) / CAST(arg_min(o_totalprice, o_orderkey) AS DOUBLE) * 100, 6) + 0.0 END AS percent FROM orders GROUP BY 1")
def stress_reduction(spark, d):
    o = T.read(spark, d, "orders").select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("iteration"), F.col("o_totalprice").cast("double").alias("stress"))
    return S.reduction(o).select("graph_id", r("percent").alias("percent"))


@query("SELECT graph_id, node_id, round((x + 2 * y + 2 * z + w) / 6, 6) + 0.0 AS x FROM nodes")
def rk4_combine(spark, d):
    return T.customer_nodes(spark, d).select("graph_id", "node_id", r(S.runge_kutta(F.col("x"), F.col("y"), F.col("z"), F.col("w"))).alias("x"))


def _matrix(spark, d):
    """A sparse matrix of 32 rows and columns for every 256 order keys, so that matrices grow in number with the table."""
    li = T.read(spark, d, "lineitem")
    m = li.groupBy(F.floor(F.col("l_orderkey") / 256).alias("m_id"), (F.col("l_partkey") % 32).alias("i"), (F.col("l_suppkey") % 32).alias("j")).agg(F.sum("l_quantity").cast("double").alias("v"))
    ids = m.select("m_id", "i").union(m.select("m_id", "j")).distinct()
    return m, ids.select("m_id", "i", ((F.col("m_id") * 7 + F.col("i") * 3) % 11).cast("double").alias("v"))


_MV = "mv AS (SELECT x.m_id, x.i, coalesce(sum(m.v * y.v), 0) AS v FROM vec x LEFT JOIN mat m ON m.m_id = x.m_id AND m.i = x.i LEFT JOIN vec y ON y.m_id = m.m_id AND y.i = m.j GROUP BY ALL)"


@query(f", {_MV} SELECT m_id, i, round(v, 4) + 0.0 AS v FROM mv")
def sparse_matvec(spark, d):
    return L.times_vector(*_matrix(spark, d)).select("m_id", "i", r("v", 4).alias("v"))


@query("SELECT m_id, round(sum(v * v), 4) + 0.0 AS v FROM vec GROUP BY 1")
def inner_product(spark, d):
    _, x = _matrix(spark, d)
    return L.inner(x, x).select("m_id", r("v", 4).alias("v"))


@query(f", {_MV} SELECT m_id, round(2 * sum(x.v * x.v) - sum(x.v * mv.v), 3) + 0.0 AS v FROM vec x JOIN mv USING (m_id, i) GROUP BY 1")
def quadratic_cost(spark, d):
    m, x = _matrix(spark, d)
    return L.quadratic_cost(m, x, x).select("m_id", r("v", 3).alias("v"))


@query("SELECT m_id, i, row_number() OVER (PARTITION BY m_id, i ORDER BY j) - 1 AS pos, j, v FROM mat")
def matrix_rows(spark, d):
    rows = L.rows_of(_matrix(spark, d)[0])
    return rows.select("m_id", "i", F.posexplode(F.arrays_zip("columns", "values")).alias("pos", "e")).select("m_id", "i", F.col("pos").cast("long").alias("pos"), F.col("e.columns").alias("j"), F.col("e.values").alias("v"))


@query("SELECT m_id, count(*) AS stored, count(DISTINCT i) AS row_count FROM mat GROUP BY 1")
def nnz(spark, d):
    m, _ = _matrix(spark, d)
    return L.rows_of(m).groupBy("m_id").agg(F.sum(F.size("columns")).alias("stored"), F.count("*").alias("row_count"))


@query("SELECT CAST(floor(l_orderkey / 256) AS BIGINT) AS m_id, l_partkey % 32 AS i, l_suppkey % 32 AS j, arg_max(CAST(l_quantity AS DOUBLE), l_orderkey * 10000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY ALL")
def sparse_upsert(spark, d):
    li = T.read(spark, d, "lineitem")
    return L.last_set(li.select(F.floor(F.col("l_orderkey") / 256).alias("m_id"), (F.col("l_partkey") % 32).alias("i"), (F.col("l_suppkey") % 32).alias("j"), F.col("l_quantity").cast("double").alias("v"), (F.col("l_orderkey") * 10000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("long")).alias("seq")))


def _diagonal(spark, d):
    p = T.read(spark, d, "part").select(F.floor(F.col("p_partkey") / 16).alias("m_id"), (F.col("p_partkey") % 16).alias("i"), (F.col("p_size") + 1).cast("double").alias("q"), (F.col("p_partkey") % 13).cast("double").alias("b"))
    return p.select("m_id", "i", F.col("i").alias("j"), F.col("q").alias("v")), p.select("m_id", "i", F.col("b").alias("v"))


@query("SELECT CAST(floor(p_partkey / 16) AS BIGINT) AS m_id, p_partkey % 16 AS i, round(CAST(p_partkey % 13 AS DOUBLE) / (p_size + 1), 5) + 0.0 AS v FROM part")
def cg_diagonal(spark, d):
    return L.conjugate_gradient(*_diagonal(spark, d)).select("m_id", "i", r("v", 5).alias("v"))


@query(", x AS (SELECT CAST(floor(p_partkey / 16) AS BIGINT) AS m_id, p_partkey % 16 AS i, CAST(p_size + 1 AS DOUBLE) AS q FROM part) SELECT m_id, i, i AS j, 1.0::DOUBLE AS v FROM x UNION ALL SELECT a.m_id, a.i, b.i, round(0.5 / sqrt(a.q * b.q), 6) + 0.0 FROM x a JOIN x b ON a.m_id = b.m_id AND abs(a.i - b.i) = 1")
def effective_q_scaled(spark, d):
    """A diagonal matrix, to which a sparse one of neighbours is added before scaling."""
    q = _diagonal(spark, d)[0]
    n = q.select("m_id", "i")
    near = n.join(n.withColumnRenamed("i", "j"), "m_id").filter("abs(i - j) = 1").withColumn("v", F.lit(0.5))
    return L.scaled(q, near).select("m_id", "i", "j", r("v", 6).alias("v"))


def _coupled(spark, d):
    """Systems of two variables: [[q + 2, 1], [1, 3]]."""
    p = T.read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("m_id"), (F.col("p_size") + 2).cast("double").alias("q"), (F.col("p_partkey") % 13).cast("double").alias("b"))
    cell = lambda i, j, v: F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), v.alias("v"))
    m = p.select("m_id", F.explode(F.array(cell(0, 0, F.col("q")), cell(0, 1, F.lit(1.0)), cell(1, 0, F.lit(1.0)), cell(1, 1, F.lit(3.0)))).alias("c")).select("m_id", "c.i", "c.j", "c.v")
    return m, p.select("m_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("i"), F.col("b").alias("v")), F.struct(F.lit(1).cast("long").alias("i"), F.lit(2.0).alias("v")))).alias("c")).select("m_id", "c.i", "c.v")


_COUPLED = ", s AS (SELECT CAST(p_partkey AS BIGINT) AS m_id, CAST(p_size + 2 AS DOUBLE) AS q, CAST(p_partkey % 13 AS DOUBLE) AS b, 3 * CAST(p_size + 2 AS DOUBLE) - 1 AS det FROM part), x AS (SELECT *, (3 * b - 2) / det AS x0, (2 * q - b) / det AS x1, -4 / det AS p0, (1 + q) / det AS p1 FROM s) "
#: Added before rounding, so that no exact value lies between two rounded ones.
OFF_TIE = 3.7e-6


@query(_COUPLED + f"SELECT m_id, 0::BIGINT AS i, round(x0 + {OFF_TIE}, 5) + 0.0 AS v FROM x UNION ALL SELECT m_id, 1, round(x1 + {OFF_TIE}, 5) + 0.0 FROM x")
def cg_coupled(spark, d):
    return L.conjugate_gradient(*_coupled(spark, d)).select("m_id", "i", r(F.col("v") + OFF_TIE, 5).alias("v"))


@query("SELECT graph_id AS m_id, node_id AS i, x::DOUBLE AS v FROM nodes")
def cg_laplacian(spark, d):
    """Graph Laplacians plus the identity, all side by side by rounds over tables; the right sides are made from known solutions."""
    e, n = _graph(spark, d)
    both = G.both_ways(G.sanitised(e, n))
    off = both.groupBy(F.col("graph_id").alias("m_id"), F.col("src").alias("i"), F.col("dst").alias("j")).agg((-F.count("*")).cast("double").alias("v"))
    ones = n.select(F.col("graph_id").alias("m_id"), F.col("node_id").alias("i"), F.col("node_id").alias("j"), F.lit(1.0).alias("v"))
    a = ones.unionByName(off).unionByName(off.select("m_id", "i", F.col("i").alias("j"), (-F.col("v")).alias("v"))).groupBy("m_id", "i", "j").agg(F.sum("v").alias("v"))
    x = n.select(F.col("graph_id").alias("m_id"), F.col("node_id").alias("i"), F.col("x").alias("v"))
    return L.conjugate_gradient(a, L.times_vector(a, x), tolerance=1e-8, small=0).select("m_id", "i", r("v", 5).alias("v"))


@query(_COUPLED + f", y AS (SELECT m_id, x0, x1, p0, p1, greatest(0, 1 - (x1 - x0)) / (p1 - p0) AS k FROM x) SELECT m_id, 0::BIGINT AS i, round(x0 + k * p0 + {OFF_TIE}, 5) + 0.0 AS v FROM y UNION ALL SELECT m_id, 1, round(x1 + k * p1 + {OFF_TIE}, 5) + 0.0 FROM y")
def gp_coupled(spark, d):
    """Coupled variables, the second at least 1 beyond the first."""
    m, b = _coupled(spark, d)
    apart = b.filter("i = 0").select("m_id", F.lit(0).alias("left"), F.lit(1).alias("right"), F.lit(1.0).alias("gap"), F.lit(False).alias("equality"))
    return D.gradient_projection(m, b, apart).select("m_id", "i", r(F.col("v") + OFF_TIE, 5).alias("v"))


@query(f"SELECT CAST(floor(p_partkey / 16) AS BIGINT) AS m_id, p_partkey % 16 AS i, round(CAST(p_partkey % 13 AS DOUBLE) / (p_size + 1) + {OFF_TIE}, 5) + 0.0 AS v FROM part")
def gp_diag_unconstrained(spark, d):
    return D.gradient_projection(*_diagonal(spark, d)).select("m_id", "i", r(F.col("v") + OFF_TIE, 5).alias("v"))


@query(_COUPLED + f"SELECT m_id, 0::BIGINT AS i, round((b - 4) / q + {OFF_TIE}, 5) + 0.0 AS v FROM x UNION ALL SELECT m_id, 1, 4.0 FROM x")
def gp_fixed(spark, d):
    """Coupled variables, the second held at 4."""
    m, b = _coupled(spark, d)
    return D.gradient_projection(m, b, fixed=b.filter("i = 1").withColumn("v", F.lit(4.0))).select("m_id", "i", F.when(F.col("i") == 1, F.round("v", 4)).otherwise(r(F.col("v") + OFF_TIE, 5)).alias("v"))


@query("SELECT graph_id AS m_id, node_id AS i, x::DOUBLE AS v FROM nodes")
def gp_laplacian(spark, d):
    """Graph Laplacians plus four times the identity under separations along the edges, all side by side by rounds over tables.

    Every fourth edge is an equality, every third leaves room, the others are tight; node 0 is
    held. The right sides are made from known positions and the edges' multipliers.
    """
    e, n = _graph(spark, d)
    clean = G.sanitised(e, n)
    off = G.both_ways(clean).groupBy(F.col("graph_id").alias("m_id"), F.col("src").alias("i"), F.col("dst").alias("j")).agg((-F.count("*")).cast("double").alias("v"))
    ones = n.select(F.col("graph_id").alias("m_id"), F.col("node_id").alias("i"), F.col("node_id").alias("j"), F.lit(4.0).alias("v"))
    a = ones.unionByName(off).unionByName(off.select("m_id", "i", F.col("i").alias("j"), (-F.col("v")).alias("v")))
    x = n.select(F.col("graph_id").alias("m_id"), F.col("node_id").alias("i"), F.col("x").alias("v"))
    at = lambda end: x.select(F.col("m_id").alias("graph_id"), F.col("i").alias(end), F.col("v").alias(f"x_{end}"))
    up, k = F.col("x_src") <= F.col("x_dst"), F.col("edge_idx")
    rules = clean.join(at("src"), ["graph_id", "src"]).join(at("dst"), ["graph_id", "dst"]).select(
        F.col("graph_id").alias("m_id"), F.when(up, F.col("src")).otherwise(F.col("dst")).alias("left"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("right"),
        (F.abs(F.col("x_src") - F.col("x_dst")) - F.when((k % 4 != 1) & (k % 3 == 0), 5.0).otherwise(0.0)).alias("gap"), (k % 4 == 1).alias("equality"), F.when(k % 4 == 1, -3.0).when(k % 3 == 0, 0.0).otherwise((k % 5).cast("double")).alias("force"))
    pull = rules.select("m_id", F.col("right").alias("i"), (-F.col("force") / 2).alias("v")).unionByName(rules.select("m_id", F.col("left").alias("i"), (F.col("force") / 2).alias("v")))
    b = L.times_vector(a, x).unionByName(pull).groupBy("m_id", "i").agg(F.sum("v").alias("v"))
    b = b.withColumn("v", F.when(F.col("i") == 0, 0.0).otherwise(F.col("v")))
    return D.gradient_projection(a, b, rules, fixed=x.filter("i = 0"), tolerance=1e-17, small=0).select("m_id", "i", r("v", 4).alias("v"))


@query("SELECT w.m_id, w.i, w.j, coalesce(v, 0) AS v FROM (SELECT m_id, i, (i * 5 + 1) % 32 AS j FROM vec) w LEFT JOIN mat USING (m_id, i, j)")
def matrix_cells(spark, d):
    m, x = _matrix(spark, d)
    return L.cells(m, x.select("m_id", "i", ((F.col("i") * 5 + 1) % 32).alias("j")))


@query(", g AS (SELECT CAST(floor(p_partkey / 16) AS BIGINT) AS m_id, CAST(p_partkey % 13 AS DOUBLE) - (p_size + 1) * CAST(p_partkey % 13 AS DOUBLE) AS g, CAST(p_size + 1 AS DOUBLE) AS q FROM part) SELECT m_id, round(CASE WHEN sum(g * g) < 1e-30 THEN 0 ELSE sum(g * g) / (2 * sum(g * g * q)) END, 8) + 0.0 AS alpha FROM g GROUP BY 1")
def gp_alpha(spark, d):
    m, b = _diagonal(spark, d)
    return L.steepest_step(m, b, b).select("m_id", r("alpha", 8).alias("alpha"))


@query(""", v AS (SELECT CAST(floor(p_partkey / 16) AS BIGINT) AS m_id, CAST(p_partkey % 16 AS BIGINT) AS i, CAST(p_size + 1 AS DOUBLE) AS q, (p_partkey % 13) / CAST(p_size + 1 AS DOUBLE) AS x FROM part),
pair AS (SELECT a.m_id, a.i, a.q, a.x, b.i AS i2, b.q AS q2, b.x AS x2, greatest(0, 3 - (b.x - a.x)) AS s FROM v a LEFT JOIN v b ON b.m_id = a.m_id AND b.i = a.i + 1 WHERE a.i % 2 = 0)
SELECT m_id, i, round(CASE WHEN i2 IS NULL THEN x ELSE x - s * q2 / (q + q2) END + 3.7e-6, 5) + 0.0 AS v FROM pair UNION ALL SELECT m_id, i2, round(x2 + s * q / (q + q2) + 3.7e-6, 5) + 0.0 FROM pair WHERE i2 IS NOT NULL
UNION ALL SELECT m_id, i, round(x + 3.7e-6, 5) + 0.0 FROM v WHERE i % 2 = 1 AND NOT EXISTS (SELECT 1 FROM v a WHERE a.m_id = v.m_id AND a.i = v.i - 1)""")
def gp_separation(spark, d):
    """Each even variable at least 3 below the next odd one."""
    m, b = _diagonal(spark, d)
    pairs = b.filter("i % 2 = 0").select("m_id", F.col("i").alias("left"), (F.col("i") + 1).alias("right"), F.lit(3.0).alias("gap"), F.lit(False).alias("equality"))
    return D.gradient_projection(m, b, pairs).select("m_id", "i", r(F.col("v") + OFF_TIE, 5).alias("v"))


def _chain(spark, d, gap=2.0):
    v = T.order_chains(spark, d)
    last = v.groupBy("problem_id").agg(F.max("var_id").alias("last"))
    c = v.join(last, "problem_id").filter("var_id < last").select("problem_id", F.col("var_id").alias("c_id"), F.col("var_id").alias("left"), (F.col("var_id") + 1).alias("right"), F.lit(gap).alias("gap"), F.lit(False).alias("equality"))
    return v, c


_CHAIN = """, z AS (SELECT *, desired - 2.0 * var_id AS z, sum(desired - 2.0 * var_id) OVER (PARTITION BY problem_id ORDER BY var_id) AS c FROM chain),
m AS (SELECT a.problem_id, a.var_id AS a, b.var_id AS b, (b.c - a.c + a.z) / (b.var_id - a.var_id + 1) AS mean FROM z a JOIN z b ON a.problem_id = b.problem_id AND a.var_id <= b.var_id),
lo AS (SELECT *, min(mean) OVER (PARTITION BY problem_id, a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM m),
px AS (SELECT problem_id, b AS var_id, max(low) + 2.0 * b AS position FROM lo GROUP BY problem_id, b)"""


@query(_CHAIN + " SELECT problem_id, var_id, round(position, 5) + 0.0 AS position, 0::BIGINT AS unsatisfied FROM px")
def qp_chain_projection(spark, d):
    return Q.project(*_chain(spark, d)).select("problem_id", "var_id", r("position", 5).alias("position"), "unsatisfied")


@query(_CHAIN + " SELECT problem_id, var_id, round(position, 5) + 0.0 AS position FROM px")
def qp_chain_runs(spark, d):
    """Chains in segments of four, whose pools are dealt anew until they ascend."""
    return Q.chain_projection(T.order_chains(spark, d), 2.0, segment=4).select("problem_id", "var_id", r("position", 5).alias("position"))


@query(_CHAIN + " SELECT problem_id, var_id, round(position, 5) + 0.0 AS position FROM px")
def qp_chain_windows(spark, d):
    return Q.chain_projection(T.order_chains(spark, d), 2.0).select("problem_id", "var_id", r("position", 5).alias("position"))


@query(_CHAIN + " SELECT problem_id, round(sum((position - desired) * (position - desired)), 3) + 0.0 AS cost FROM px JOIN chain USING (problem_id, var_id) GROUP BY 1")
def qp_cost(spark, d):
    v, c = _chain(spark, d)
    return Q.projection_cost(Q.chain_projection(v, 2.0).join(v, ["problem_id", "var_id"])).select("problem_id", r("cost", 3).alias("cost"))


@query("SELECT a.problem_id, a.var_id AS c_id, round(b.desired - 2.0 - a.desired, 6) + 0.0 AS slack FROM chain a JOIN chain b ON a.problem_id = b.problem_id AND b.var_id = a.var_id + 1")
def constraint_slack(spark, d):
    v, c = _chain(spark, d)
    return Q.slacks(v.withColumnRenamed("desired", "position"), c).select("problem_id", "c_id", r("slack").alias("slack"))


@query(f""", leaf AS (SELECT problem_id, var_id, desired - 3.0 AS t FROM chain WHERE var_id > 0), hub AS (SELECT problem_id, desired AS h FROM chain WHERE var_id = 0),
run AS (SELECT problem_id, (h + sum(t) OVER w) / (1 + count(*) OVER w) AS mean FROM leaf JOIN hub USING (problem_id) WINDOW w AS (PARTITION BY problem_id ORDER BY t, var_id ROWS UNBOUNDED PRECEDING)),
top AS (SELECT problem_id, least(h, coalesce((SELECT min(mean) FROM run WHERE run.problem_id = hub.problem_id), h)) AS x FROM hub)
SELECT problem_id, var_id, round(CASE WHEN var_id = 0 THEN x ELSE greatest(desired, x + 3) END + {OFF_TIE}, 5) + 0.0 AS position FROM chain JOIN top USING (problem_id)""")
def qp_star_fanout(spark, d):
    """The first variable of a problem at least 3 below each of the others."""
    v = T.order_chains(spark, d)
    c = v.filter("var_id > 0").select("problem_id", F.col("var_id").alias("c_id"), F.lit(0).alias("left"), F.col("var_id").alias("right"), F.lit(3.0).alias("gap"), F.lit(False).alias("equality"))
    return Q.project(v, c).select("problem_id", "var_id", r(F.col("position") + OFF_TIE, 5).alias("position"))


def _contradicted(spark, d):
    """Chains whose first two variables are also told to be 5 apart exactly, after they are 2 apart exactly."""
    v, c = _chain(spark, d)
    first = c.filter("c_id = 0").withColumn("equality", F.lit(True))
    more = first.withColumns({"c_id": F.lit(1000000).cast("long"), "gap": F.lit(5.0)})
    return v, c.filter("c_id > 0").unionByName(first).unionByName(more)


@query('SELECT problem_id, 1000000::BIGINT AS c_id, 0::BIGINT AS "left", 1::BIGINT AS "right", 5.0::DOUBLE AS gap, true AS equality, \'v0 + 5.0 == v1\' AS text FROM chain WHERE var_id = 1')
def unsatisfiable_rules(spark, d):
    return Q.described(Q.unsatisfiable(*_contradicted(spark, d)))


def _too_short(spark, d):
    """Chains of fixed gaps with links over two variables, and for each even problem one that its last variable stay below its first."""
    v, c = _chain(spark, d, 3.0)
    last = v.groupBy("problem_id").agg(F.max("var_id").alias("last"))
    two = c.join(last, "problem_id").filter("left % 3 = 0 AND left + 2 <= last").select("problem_id", (F.col("c_id") + 1000).alias("c_id"), "left", (F.col("left") + 2).alias("right"), F.lit(6.0).alias("gap"), F.lit(False).alias("equality"))
    limit = last.filter("problem_id % 2 = 0 AND last > 0").select("problem_id", F.lit(5000).cast("long").alias("c_id"), F.col("last").alias("left"), F.lit(0).cast("long").alias("right"), F.lit(0.0).alias("gap"), F.lit(False).alias("equality"))
    return v, c.withColumn("equality", F.lit(True)).unionByName(two).unionByName(limit)


@query(""", ends AS (SELECT problem_id, max(var_id) AS last FROM chain GROUP BY 1 HAVING problem_id % 2 = 0 AND max(var_id) > 0),
way AS (SELECT problem_id, last, 0::BIGINT AS v, 0::BIGINT AS steps, []::BIGINT[] AS path FROM ends
  UNION ALL SELECT problem_id, last, v + hop, steps + 1, list_append(path, CASE hop WHEN 1 THEN v ELSE v + 1000 END) FROM way, (VALUES (1::BIGINT), (2)) h(hop) WHERE v + hop <= last AND (hop = 1 OR v % 3 = 0)),
best AS (SELECT problem_id, path, row_number() OVER (PARTITION BY problem_id ORDER BY steps, list_reverse(path)) AS k FROM way WHERE v = last)
SELECT problem_id, 5000::BIGINT AS failed, generate_subscripts(path, 1)::BIGINT AS step, unnest(path) AS c_id FROM best WHERE k = 1""")
def unsatisfiable_paths(spark, d):
    """The constraints that prove a contradiction: of the equally long paths through a chain the one of the fewest steps."""
    return Q.unsatisfiable_paths(*_too_short(spark, d))


@query(", p AS (SELECT a.problem_id, a.desired AS x, b.desired AS y FROM chain a JOIN chain b ON a.problem_id = b.problem_id AND a.var_id = 0 AND b.var_id = 1) SELECT problem_id, 0::BIGINT AS var_id, (x + y - s) / 2 AS position FROM (SELECT *, CASE WHEN problem_id % 2 = 0 THEN greatest(30.0, y - x) ELSE greatest(2.0, y - x) END AS s FROM p) UNION ALL SELECT problem_id, 1, (x + y + s) / 2 FROM (SELECT *, CASE WHEN problem_id % 2 = 0 THEN greatest(30.0, y - x) ELSE greatest(2.0, y - x) END AS s FROM p)")
def qp_added_constraint(spark, d):
    """Pairs that are solved; then those of even problems get a wider gap."""
    v, c = _chain(spark, d)
    v, c = v.filter("var_id < 2").join(c.select("problem_id").distinct(), "problem_id", "left_semi"), c.filter("c_id = 0")
    added = c.filter("problem_id % 2 = 0").withColumns({"c_id": F.lit(9).cast("long"), "gap": F.lit(30.0)})
    return Q.with_added(v, Q.project(v, c), c, added).select("problem_id", "var_id", F.col("position"))


@query(_CHAIN + " SELECT problem_id, var_id, round(2 * (position - desired), 5) + 0.0 AS pull FROM px JOIN chain USING (problem_id, var_id)")
def qp_pulls(spark, d):
    v, _ = _chain(spark, d)
    return Q.pulls(Q.chain_projection(v, 2.0).join(v, ["problem_id", "var_id"])).select("problem_id", "var_id", r("pull", 5).alias("pull"))


@query(_CHAIN + " SELECT problem_id, var_id, round(position, 5) + 0.0 AS position FROM px")
def sql_separated_chain(spark, d):
    """The chain projection as a table function of SQL."""
    register(spark)
    chains = T.order_chains(spark, d).withColumn("gap", F.lit(2.0))
    out = spark.sql("SELECT * FROM separated_chain(TABLE(SELECT problem_id, var_id, desired, weight, gap FROM {chains}) PARTITION BY problem_id ORDER BY var_id)", chains=chains)
    return out.select("problem_id", "var_id", r("position", 5).alias("position"))


@query(""", lone AS (SELECT problem_id, var_id, desired, (var_id - var_id % 2) AS head FROM chain), pr AS (SELECT problem_id, head, max(desired) FILTER (var_id % 2 = 0) AS a, max(desired) FILTER (var_id % 2 = 1) AS b FROM lone GROUP BY ALL), s AS (SELECT *, greatest(0, 2 - (b - a)) / 2 AS s FROM pr)
SELECT problem_id, head AS var_id, round(coalesce(a - s, a), 5) + 0.0 AS position FROM s UNION ALL SELECT problem_id, head + 1, round(b + s, 5) + 0.0 FROM s WHERE b IS NOT NULL""")
def qp_parts(spark, d):
    """Chains with every second link, so that they fall apart; each part is a problem of its own."""
    v, c = _chain(spark, d)
    return Q.project_parts(v, c.filter("c_id % 2 = 0")).select("problem_id", "var_id", r("position", 5).alias("position"))


def _two(spark, d, equality):
    p = T.read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("problem_id"), (F.col("p_size") % 7).cast("double").alias("a"), (F.col("p_partkey") % 5).cast("double").alias("b"), (F.col("p_size") % 3 + 1).cast("double").alias("w"))
    v = p.select("problem_id", F.lit(0).alias("var_id"), F.col("a").alias("desired"), F.col("w").alias("weight"), F.lit(1.0).alias("scale")).unionByName(p.select("problem_id", F.lit(1).alias("var_id"), F.col("b").alias("desired"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("scale")))
    return v, p.select("problem_id", F.lit(0).alias("c_id"), F.lit(0).alias("left"), F.lit(1).alias("right"), F.lit(2.0).alias("gap"), F.lit(equality).alias("equality"))


_TWO = """, p AS (SELECT CAST(p_partkey AS BIGINT) AS problem_id, CAST(p_size % 7 AS DOUBLE) AS a, CAST(p_partkey % 5 AS DOUBLE) AS b, CAST(p_size % 3 + 1 AS DOUBLE) AS w FROM part), q AS (SELECT *, {v} AS s FROM p)
SELECT problem_id, 0::BIGINT AS var_id, round(a - s / (w + 1), 6) + 0.0 AS position FROM q UNION ALL SELECT problem_id, 1, round(b + s * w / (w + 1), 6) + 0.0 FROM q"""


@query(_TWO.format(v="greatest(0, 2 - (b - a))"))
def qp_two_var_weighted(spark, d):
    return Q.project(*_two(spark, d, False)).select("problem_id", "var_id", r("position").alias("position"))


@query(_TWO.format(v="2 - (b - a)"))
def qp_unknown_variables(spark, d):
    """Constraints on variables that are not there are left out."""
    v, c = _two(spark, d, True)
    more = c.withColumns({"c_id": F.lit(1), "right": F.lit(7), "gap": F.lit(500.0)})
    return Q.project(v, c.unionByName(more)).select("problem_id", "var_id", r("position").alias("position"))


@query(_TWO.format(v="2 - (b - a)"))
def qp_equality_pairs(spark, d):
    return Q.project(*_two(spark, d, True)).select("problem_id", "var_id", r("position").alias("position"))


@query("SELECT o_custkey AS problem_id, o_orderkey % 3 AS block, CAST(sum(0.5 * (o_orderkey % 4)) AS DOUBLE) AS ab, round(sum(CAST(o_orderkey % 11 AS DOUBLE)), 6) AS ad, CAST(count(*) AS DOUBLE) AS a2, round((sum(CAST(o_orderkey % 11 AS DOUBLE)) - CAST(sum(0.5 * (o_orderkey % 4)) AS DOUBLE)) / count(*), 6) + 0.0 AS position FROM orders GROUP BY ALL")
def block_position_stats(spark, d):
    o = T.read(spark, d, "orders").select(F.col("o_custkey").alias("problem_id"), (F.col("o_orderkey") % 3).alias("block"), (F.col("o_orderkey") % 11).cast("double").alias("desired"), F.lit(1.0).alias("weight"), F.lit(2.0).alias("scale"), F.lit(2.0).alias("block_scale"), (F.col("o_orderkey") % 4).cast("double").alias("offset"))
    return Q.block_positions(o).select("problem_id", "block", r("ab").alias("ab"), r("ad").alias("ad"), r("a2").alias("a2"), r("position").alias("position"))


@query("SELECT problem_id, var_id * 2 AS c_id FROM chain c WHERE EXISTS (SELECT 1 FROM chain b WHERE b.problem_id = c.problem_id AND b.var_id = c.var_id + 1) UNION ALL SELECT problem_id, 1000000 FROM chain WHERE var_id = 2 UNION ALL SELECT problem_id, 1000002 FROM chain WHERE var_id = 2")
def redundant_equalities(spark, d):
    """A chain of equalities stays; of three more between its first and third variable the implied one goes, the contradicting equality and the inequality stay."""
    v, c = _chain(spark, d)
    third = v.filter("var_id = 2").select("problem_id", F.explode(F.array(F.struct(F.lit(1000000).alias("c_id"), F.lit(5.0).alias("gap"), F.lit(True).alias("equality")), F.struct(F.lit(1000001).alias("c_id"), F.lit(4.0).alias("gap"), F.lit(True).alias("equality")), F.struct(F.lit(1000002).alias("c_id"), F.lit(4.0).alias("gap"), F.lit(False).alias("equality")))).alias("e")).select("problem_id", "e.c_id", F.lit(0).alias("left"), F.lit(2).alias("right"), "e.gap", "e.equality")
    eq = c.select("problem_id", (F.col("c_id") * 2).alias("c_id"), "left", "right", "gap", F.lit(True).alias("equality"))
    return Q.without_redundant(eq.unionByName(third))


def _sweep_sql(axis: str, other: str, size: str) -> str:
    c = f"c{axis}"
    return f""", op AS (SELECT v.group_id, v.rect_id AS id, v.{size} AS size, v.{c} AS c, o.rect_id AS o_id, o.{c} AS o_c, o.{size} AS o_size FROM rects v JOIN rects o ON v.group_id = o.group_id AND v.rect_id <> o.rect_id AND o.min_{other} <= v.max_{other} AND (o.max_{other} > v.max_{other} OR (o.max_{other} = v.max_{other} AND o.rect_id > v.rect_id))),
a AS (SELECT group_id, id, size, max({{'c': o_c, 'id': o_id, 's': o_size}}) AS o FROM op WHERE o_c < c OR (o_c = c AND o_id < id) GROUP BY ALL), b AS (SELECT group_id, id, size, min({{'c': o_c, 'id': o_id, 's': o_size}}) AS o FROM op WHERE NOT (o_c < c OR (o_c = c AND o_id < id)) GROUP BY ALL)
SELECT group_id, o.id AS "left", id AS "right", (size + o.s) / 2 AS gap FROM a UNION ALL SELECT group_id, id, o.id, (size + o.s) / 2 FROM b"""


@query(_sweep_sql("x", "y", "w"))
def scanline_x(spark, d):
    return O.sweep_constraints(T.part_rects(spark, d), R.X)


@query(_sweep_sql("y", "x", "h"))
def scanline_y(spark, d):
    return O.sweep_constraints(T.part_rects(spark, d), R.Y)


@query(_sweep_sql("x", "y", "w").replace("rects", "wide"))
def scanline_x_wide(spark, d):
    """Few large groups, one with a third of all rows."""
    return O.sweep_constraints(T.wide_rects(spark, d), R.X)


@query("""SELECT group_id, a AS "left", b AS "right", (wa + wb) / 2 AS gap FROM (SELECT *, min(CASE WHEN ox <= 0 THEN {'c': cb, 'id': b} END) OVER (PARTITION BY group_id, a) AS stop, max(CASE WHEN ox <= 0 THEN {'c': ca, 'id': a} END) OVER (PARTITION BY group_id, b) AS back FROM
(SELECT p.group_id, p.rect_id AS a, q.rect_id AS b, p.w AS wa, q.w AS wb, p.cx AS ca, q.cx AS cb, CASE WHEN q.min_x < p.max_x THEN p.max_x - q.min_x ELSE 0 END AS ox, CASE WHEN p.cy <= q.cy AND q.min_y < p.max_y THEN p.max_y - q.min_y WHEN q.cy <= p.cy AND p.min_y < q.max_y THEN q.max_y - p.min_y ELSE 0 END AS oy
FROM rects p JOIN rects q ON p.group_id = q.group_id AND (p.cx < q.cx OR (p.cx = q.cx AND p.rect_id < q.rect_id)) AND p.min_y <= q.max_y AND q.min_y <= p.max_y)) WHERE (ox <= 0 OR ox <= oy) AND (stop IS NULL OR cb < stop.c OR (cb = stop.c AND b <= stop.id)) AND (back IS NULL OR ca > back.c OR (ca = back.c AND a >= back.id))""")
def neighbour_lists_x(spark, d):
    return O.neighbour_constraints(T.part_rects(spark, d))


#: Two rectangles of a group, of which every fifth is fixed; and the passes of overlap removal in closed form.
_PAIR_RECTS = """, r0 AS (SELECT CAST(floor(k / 2) AS BIGINT) AS g, k, CAST(k * 7 % 20 AS DOUBLE) AS cx, CAST(k * 3 % 10 AS DOUBLE) AS cy, w, h, CASE WHEN k % 5 = 0 THEN 10000.0 ELSE 1.0 END AS wt FROM rects0)"""
_APART = """,
p AS (SELECT a.g, a.k AS ka, b.k AS kb, a.cx AS ax, b.cx AS bx, a.cy AS ay, b.cy AS by_, a.w AS aw, b.w AS bw, a.h AS ah, b.h AS bh, b.wt / (a.wt + b.wt) AS fa, a.wt / (a.wt + b.wt) AS fb FROM r0 a JOIN r0 b ON a.g = b.g AND a.k < b.k),
q AS (SELECT *, abs(bx - ax) AS dx, abs(by_ - ay) AS dy, (aw + bw) / 2 AS sx, (ah + bh) / 2 AS sy, CASE WHEN ax <= bx THEN 1 ELSE -1 END AS ux, CASE WHEN ay <= by_ THEN 1 ELSE -1 END AS uy FROM p),
m1 AS (SELECT *, dy <= sy AND dx < sx + 0.001 AND sx + 0.001 - dx <= greatest(0, sy - dy) AS first FROM q),
m2 AS (SELECT *, CASE WHEN NOT first AND dx <= sx AND dy < sy + 0.001 THEN sy + 0.001 - dy ELSE 0 END AS my FROM m1),
m3 AS (SELECT *, CASE WHEN dy + my <= sy AND dx < sx + 0.001 THEN sx + 0.001 - dx ELSE 0 END AS mx FROM m2)
SELECT g AS group_id, ka AS rect_id, round(ax - ux * mx * fa, 6) + 0.0 AS x, round(ay - uy * my * fa, 6) + 0.0 AS y FROM m3 UNION ALL SELECT g, kb, round(bx + ux * mx * fb, 6) + 0.0, round(by_ + uy * my * fb, 6) + 0.0 FROM m3
UNION ALL SELECT g, k, cx, cy FROM r0 WHERE (SELECT count(*) FROM r0 o WHERE o.g = r0.g) = 1"""


@query(_PAIR_RECTS + _APART)
def remove_overlaps_pairs(spark, d):
    k = F.col("p_partkey").cast("long")
    at = lambda c, half: [(c - half).cast("double"), (c + half).cast("double")]
    (x0, x1), (y0, y1) = at(k * 7 % 20, F.col("p_size") / 2), at(k * 3 % 10, (F.col("p_size") % 10 + 1) / 2)
    rects = T.read(spark, d, "part").select(F.floor(k / 2).alias("group_id"), k.alias("rect_id"), x0.alias("min_x"), x1.alias("max_x"), y0.alias("min_y"), y1.alias("max_y"), F.lit(0.0).alias("x_border"), F.lit(0.0).alias("y_border"))
    out = O.remove_overlaps(rects, rects.filter("rect_id % 5 = 0"))
    return out.select("group_id", "rect_id", r((F.col("min_x") + F.col("max_x")) / 2).alias("x"), r((F.col("min_y") + F.col("max_y")) / 2).alias("y"))


@query("SELECT DISTINCT group_id, true AS no_overlaps, true AS sizes_kept, true AS near FROM rects")
def remove_overlaps_flag(spark, d):
    """Whole canvases: nothing overlaps afterwards, sizes stay, and no rectangle moves by more than the extents of all together."""
    rects = T.part_rects(spark, d)
    out = O.remove_overlaps(rects)
    tight = out.select("group_id", "rect_id", (F.col("min_x") + 1e-6).alias("min_x"), (F.col("max_x") - 1e-6).alias("max_x"), (F.col("min_y") + 1e-6).alias("min_y"), (F.col("max_y") - 1e-6).alias("max_y"), F.lit(0.0).alias("x_border"), F.lit(0.0).alias("y_border"))
    hit = R.overlap_pairs(tight).select("group_id").distinct().withColumn("hit", F.lit(True))
    kept = out.join(rects.select("rect_id", (F.col("max_x") - F.col("min_x")).alias("w"), (F.col("max_y") - F.col("min_y")).alias("h"), F.col("min_x").alias("x0"), F.col("min_y").alias("y0")), "rect_id").groupBy("group_id").agg(F.every((F.abs(F.col("max_x") - F.col("min_x") - F.col("w")) < 1e-4) & (F.abs(F.col("max_y") - F.col("min_y") - F.col("h")) < 1e-4)).alias("sizes_kept"), (F.max(F.abs(F.col("min_x") - F.col("x0")) + F.abs(F.col("min_y") - F.col("y0"))) <= F.sum(F.col("w") + F.col("h"))).alias("near"))
    return kept.join(hit, "group_id", "left").select("group_id", F.col("hit").isNull().alias("no_overlaps"), "sizes_kept", "near")


#: Rectangles that all share the y axis: chains along x in the order of their centres, as an isotonic regression of the centres less the gaps before them.
_LINED = """, r0 AS (SELECT k % 7 AS g, k, CAST(k * 37 % 500 AS DOUBLE) AS c, w FROM rects0), o AS (SELECT *, row_number() OVER s AS i, coalesce(sum(w) OVER (s ROWS UNBOUNDED PRECEDING), 0) AS ws, first_value(w) OVER s AS w0 FROM r0 WINDOW s AS (PARTITION BY g ORDER BY c, k)),
z AS (SELECT *, ws - w / 2 - w0 / 2 + 0.001 * (i - 1) AS off_, c - (ws - w / 2 - w0 / 2 + 0.001 * (i - 1)) AS z, sum(c - (ws - w / 2 - w0 / 2 + 0.001 * (i - 1))) OVER (PARTITION BY g ORDER BY i) AS run FROM o),
m AS (SELECT a.g, a.i AS a, b.i AS b, (b.run - a.run + a.z) / (b.i - a.i + 1) AS mean FROM z a JOIN z b ON a.g = b.g AND a.i <= b.i),
lo AS (SELECT *, min(mean) OVER (PARTITION BY g, a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM m), px AS (SELECT g, b AS i, max(low) AS x FROM lo GROUP BY ALL)
SELECT g AS group_id, k AS rect_id, round(x + off_, 5) + 0.0 AS x, 50.0::DOUBLE AS y FROM px JOIN z USING (g, i)"""


@query(_LINED)
def remove_overlaps_rows(spark, d):
    """Large groups by passes over tables: every rectangle crosses the same line, so they end up side by side."""
    k = F.col("p_partkey").cast("long")
    c, w, h = (k * 37 % 500).cast("double"), F.col("p_size").cast("double"), (2000 + k % 11 * 2).cast("double")
    rects = T.read(spark, d, "part").select((k % 7).alias("group_id"), k.alias("rect_id"), (c - w / 2).alias("min_x"), (c + w / 2).alias("max_x"), (50 - h / 2).alias("min_y"), (50 + h / 2).alias("max_y"), F.lit(0.0).alias("x_border"), F.lit(0.0).alias("y_border"))
    out = O.remove_overlaps(rects, small=0)
    return out.select("group_id", "rect_id", r((F.col("min_x") + F.col("max_x")) / 2, 5).alias("x"), r((F.col("min_y") + F.col("max_y")) / 2, 5).alias("y"))


def remove_overlaps_wide(spark, d):
    """Few large groups, one with a third of all rows, by passes over tables; tests hold it against the solution in memory."""
    out = O.remove_overlaps(T.wide_rects(spark, d), small=0)
    return out.select("group_id", "rect_id", *[r(c, 5).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])


QUERIES["remove_overlaps_wide"] = remove_overlaps_wide


#: Components of nodes 0 to 6 and 7 to 13 as rectangles, and where their nodes go.
_TWO_BOXES = """, own AS (SELECT graph_id, node_id, x, y, CASE WHEN node_id < 7 THEN 0 ELSE 7 END AS c FROM nodes WHERE node_id < 14),
r0 AS (SELECT graph_id AS g, c AS k, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, max(x) - min(x) + 12 AS w, max(y) - min(y) + 8 AS h, 1.0 AS wt FROM own GROUP BY ALL)"""


@query(_TWO_BOXES + _APART.replace("SELECT g AS group_id, ka", ", gone AS (SELECT g AS group_id, ka", 1) + """)
SELECT graph_id, node_id, c::BIGINT AS component_id, round(own.x + gone.x - cx, 5) + 0.0 AS x, round(own.y + gone.y - cy, 5) + 0.0 AS y FROM own JOIN r0 ON r0.g = graph_id AND r0.k = c JOIN gone ON gone.group_id = graph_id AND rect_id = c""")
def separate_components_rows(spark, d):
    """Graphs of two components: where each node goes."""
    n = T.customer_nodes(spark, d).filter("node_id < 14")
    nxt = n.filter("node_id % 7 <> 6").select("graph_id", F.col("node_id").alias("edge_idx"), F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"), F.lit(1.0).alias("length"))
    return O.separate_components(n, G.components(nxt, n)).select("graph_id", "node_id", "component_id", r("x", 5).alias("x"), r("y", 5).alias("y"))


@query("SELECT DISTINCT graph_id, component_id, true AS whole FROM comp")
def separate_components_whole(spark, d):
    """All nodes of a component move by the same."""
    e, n = _graph(spark, d)
    out = O.separate_components(n, G.components(e, n)).join(n.select("graph_id", "node_id", F.col("x").alias("x0"), F.col("y").alias("y0")), ["graph_id", "node_id"])
    spread = lambda a: F.max(F.col(a) - F.col(a + "0")) - F.min(F.col(a) - F.col(a + "0")) < 1e-9
    return out.groupBy("graph_id", "component_id").agg((spread("x") & spread("y")).alias("whole"))


@query("SELECT DISTINCT graph_id, true AS apart FROM nodes")
def separate_components_flag(spark, d):
    e, n = _graph(spark, d)
    out = O.separate_components(n, G.components(e, n))
    box = out.groupBy(F.col("graph_id").alias("group_id"), F.col("component_id").alias("rect_id")).agg(F.min(F.col("x") - F.col("w") / 2 + 1e-6).alias("min_x"), F.max(F.col("x") + F.col("w") / 2 - 1e-6).alias("max_x"), F.min(F.col("y") - F.col("h") / 2 + 1e-6).alias("min_y"), F.max(F.col("y") + F.col("h") / 2 - 1e-6).alias("max_y")).withColumns({"x_border": F.lit(0.0), "y_border": F.lit(0.0)})
    hit = R.overlap_pairs(box).select(F.col("group_id").alias("graph_id")).distinct().withColumn("hit", F.lit(True))
    return n.select("graph_id").distinct().join(hit, "graph_id", "left").select("graph_id", F.col("hit").isNull().alias("apart"))


def _shapes(spark, d):
    n = T.customer_nodes(spark, d)
    return n.select(F.col("graph_id").alias("problem_id"), F.lit(0).alias("dim"), F.lit(1000).cast("long").alias("guide"), F.lit(1001).cast("long").alias("high_guide"), F.lit(1000).cast("long").alias("low_guide"), F.col("node_id").alias("node"), (F.col("node_id") % 5 - 2).cast("double").alias("offset"), (F.col("w") / 2).alias("half"), "x", "y")


_RULE = 'problem_id, 0 AS dim, {l} AS "left", {r} AS "right", {g} AS gap, {e} AS equality'
_SHAPES = ", s AS (SELECT graph_id AS problem_id, node_id AS node, CAST(node_id % 5 - 2 AS DOUBLE) AS o, x, y FROM nodes) "


@query(_SHAPES + "SELECT " + _RULE.format(l="CASE WHEN o < 0 THEN node ELSE 1000 END", r="CASE WHEN o < 0 THEN 1000 ELSE node END", g="abs(o)", e="false") + " FROM s")
def cc_boundary(spark, d):
    return P.boundary(_shapes(spark, d))


@query(_SHAPES + "SELECT " + _RULE.format(l="1000", r="node", g="o", e="true") + " FROM s")
def cc_alignment(spark, d):
    return P.alignment(_shapes(spark, d))


@query("SELECT DISTINCT graph_id AS problem_id, 0 AS dim, 1000::BIGINT AS var_id, 50.0::DOUBLE AS desired, CASE WHEN graph_id % 2 = 0 THEN 1e5 ELSE 1e-4 END AS weight, graph_id % 2 = 0 AS fixed FROM nodes")
def cc_guides(spark, d):
    s = _shapes(spark, d).select("problem_id", "dim", "guide", F.lit(50.0).alias("position")).distinct()
    return P.guide_variables(s, F.col("problem_id") % 2 == 0)


def _edge_pairs(spark, d):
    e, n = _graph(spark, d)
    return G.sanitised(e, n).select(F.col("graph_id").alias("problem_id"), F.lit(0).alias("dim"), F.col("src").alias("left"), F.col("dst").alias("right"), (F.col("length") * 3).alias("gap"), (F.col("edge_idx") % 2 == 1).alias("equality"))


@query('SELECT graph_id AS problem_id, 0 AS dim, src AS "left", dst AS "right", length * 3 AS gap, edge_idx % 2 = 1 AS equality FROM clean')
def cc_separation(spark, d):
    return P.separation(_edge_pairs(spark, d))


@query('SELECT graph_id AS problem_id, 0 AS dim, src AS "left", dst AS "right", 0.0::DOUBLE AS gap, true AS equality FROM clean')
def cc_orthogonal(spark, d):
    return P.orthogonal_edges(_edge_pairs(spark, d))


def _multi(spark, d):
    return _edge_pairs(spark, d).groupBy("problem_id", "dim").agg(F.collect_list(F.struct("left", "right")).alias("pairs")).withColumns({"sep": F.lit(15.0), "equality": F.lit(False)})


@query('SELECT graph_id AS problem_id, 0 AS dim, src AS "left", dst AS "right", 15.0::DOUBLE AS gap, false AS equality FROM clean')
def cc_multisep(spark, d):
    return P.multi_separation(_multi(spark, d))


@query('SELECT graph_id AS problem_id, 0 AS dim, src AS "left", dst AS "right", 15.0::DOUBLE AS gap, true AS equality FROM clean')
def cc_distribution(spark, d):
    return P.distribution(_multi(spark, d))


@query(""", m AS (SELECT graph_id AS problem_id, node_id AS node, x, y, lead(node_id) OVER w AS n2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM nodes WHERE node_id % 3 = 0 WINDOW w AS (PARTITION BY graph_id ORDER BY node_id))
SELECT problem_id, 0 AS dim, node AS "left", n2 AS "right", x2 - x AS gap, true AS equality FROM m WHERE n2 IS NOT NULL UNION ALL SELECT problem_id, 1, node, n2, y2 - y, true FROM m WHERE n2 IS NOT NULL""")
def cc_fixed_relative(spark, d):
    s = _shapes(spark, d)
    return P.fixed_relative(s.filter("node % 3 = 0"), s.select("problem_id", "node", "x", "y"))


@query("SELECT graph_id AS problem_id, nth, max(id) FILTER (pos % 2 = 0) AS \"left\", max(id) FILTER (pos % 2 = 1) AS \"right\" FROM (SELECT graph_id, node_id AS id, row_number() OVER w - 1 AS pos, CAST(floor((row_number() OVER w - 1) / 2) AS BIGINT) AS nth FROM nodes WHERE node_id % 3 < 2 WINDOW w AS (PARTITION BY graph_id ORDER BY node_id)) GROUP BY ALL HAVING count(*) = 2")
def cc_flat_pairs(spark, d):
    n = T.customer_nodes(spark, d).filter("node_id % 3 < 2").groupBy(F.col("graph_id").alias("problem_id")).agg(F.sort_array(F.collect_list("node_id")).alias("ids"))
    return P.pairs_of(n).withColumn("nth", F.col("nth").cast("long"))


@query(_SHAPES + "SELECT " + _RULE.format(l="1000", r="node", g="o", e="true") + ", 'alignment' AS kind FROM s UNION ALL SELECT graph_id, 0, src, dst, length * 3, edge_idx % 2 = 1, 'separation' FROM clean UNION ALL SELECT graph_id, 0, src, dst, 15.0, true, 'distribution' FROM clean")
def cc_mixed_kinds(spark, d):
    return P.rules_of({"alignment": _shapes(spark, d), "separation": _edge_pairs(spark, d), "distribution": _multi(spark, d)})


@query("SELECT DISTINCT graph_id AS problem_id, dim, 2000 + k AS var_id, CASE k WHEN 0 THEN -10.0 ELSE 150.0 END::DOUBLE AS desired, 1.0::DOUBLE AS weight, false AS fixed FROM nodes, (VALUES (0), (1)) a(dim), (VALUES (0::BIGINT), (1)) b(k)")
def cc_page_guides(spark, d):
    pages = T.customer_nodes(spark, d).select(F.col("graph_id").alias("problem_id")).distinct().withColumn("dim", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumns({"low": F.lit(-10.0), "high": F.lit(150.0)})
    return P.page_guides(pages, 2000)


@query(_SHAPES + ", g AS (SELECT problem_id, sum(x - o) AS s, count(*) AS n FROM s WHERE node % 4 = 0 GROUP BY 1), p AS (SELECT problem_id, (s + 1e-4 * 50) / (n + 1e-4) AS line FROM g) SELECT problem_id, node AS var_id, round(CASE WHEN node % 4 = 0 THEN line + o ELSE x END, 6) + 0.0 AS position, 0 AS error_level FROM s LEFT JOIN p USING (problem_id) UNION ALL SELECT DISTINCT problem_id, 1000, round(coalesce(line, 50), 6) + 0.0, 0 FROM s LEFT JOIN p USING (problem_id)")
def project_onto_guides(spark, d):
    """Every fourth node level with a guide line that is free to move."""
    s = _shapes(spark, d)
    guides = P.guide_variables(s.select("problem_id", "dim", "guide", F.lit(50.0).alias("position")).distinct())
    return P.project_onto(T.customer_nodes(spark, d), P.alignment(s.filter("node % 4 = 0")), 0, guides).select("problem_id", "var_id", r("position").alias("position"), "error_level")


def _prioritised(spark, d):
    """Node 1 is 30 right of node 0, exactly (priority 2), and 50 (priority 1); node 2 is level with node 1."""
    n = T.customer_nodes(spark, d).select(F.col("graph_id").alias("problem_id")).distinct()
    rule = lambda dim, i, j, gap, pr, cc: F.struct(F.lit(dim).alias("dim"), F.lit(i).cast("long").alias("left"), F.lit(j).cast("long").alias("right"), F.lit(gap).alias("gap"), F.lit(True).alias("equality"), F.lit(pr).alias("priority"), F.lit(cc).alias("cc_id"))
    return n.select("problem_id", F.explode(F.array(rule(0, 0, 1, 30.0, 2, 1), rule(0, 0, 1, 50.0, 1, 2), rule(1, 1, 2, 0.0, None, 3))).alias("r")).select("problem_id", "r.*")


@query("SELECT DISTINCT graph_id AS problem_id, cc_id, CASE cc_id WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rank FROM nodes, (VALUES (1), (2), (3)) t(cc_id)")
def cc_by_priority(spark, d):
    return P.by_priority(_prioritised(spark, d)).select("problem_id", "cc_id", "rank")


_FEASIBLE = ", f AS (SELECT graph_id, max(x) FILTER (node_id = 0) AS x0, max(x) FILTER (node_id = 1) AS x1, max(y) FILTER (node_id = 1) AS y1, max(y) FILTER (node_id = 2) AS y2 FROM nodes GROUP BY 1) "


@query(_FEASIBLE + "SELECT n.graph_id, node_id, CASE WHEN node_id = 0 AND x1 IS NOT NULL THEN (x0 + x1 - 50) / 2 WHEN node_id = 1 AND x0 IS NOT NULL THEN (x0 + x1 + 50) / 2 ELSE x END AS x, CASE WHEN node_id IN (1, 2) AND y1 IS NOT NULL AND y2 IS NOT NULL THEN (y1 + y2) / 2 ELSE y END AS y, w, h FROM nodes n JOIN f USING (graph_id)")
def feasible_positions(spark, d):
    return P.make_feasible(T.customer_nodes(spark, d), _prioritised(spark, d))


@query(_FEASIBLE + 'SELECT graph_id AS problem_id, 0 AS dim, 0::BIGINT AS "left", 1::BIGINT AS "right", 30.0::DOUBLE AS gap, true AS equality FROM f WHERE x0 IS NOT NULL AND x1 IS NOT NULL')
def feasible_failures(spark, d):
    """The rule of a larger priority number that a smaller one contradicts."""
    return P.unsatisfied_rules(T.customer_nodes(spark, d), _prioritised(spark, d), 0)


@query("SELECT graph_id AS problem_id, node_id AS var_id, 1e5::DOUBLE AS weight FROM nodes WHERE node_id % 3 = 0")
def cc_var_modifications(spark, d):
    return P.fixed_members(_shapes(spark, d).filter("node % 3 = 0"))


@query(_SHAPES + "SELECT " + _RULE.format(l="1000", r="node", g="6.0::DOUBLE", e="false") + " FROM s UNION ALL SELECT " + _RULE.format(l="node", r="1001", g="6.0::DOUBLE", e="false") + " FROM s")
def cc_page_boundary(spark, d):
    return P.page_boundary(_shapes(spark, d))


@query('SELECT c_custkey AS id, coalesce(m, c_custkey) AS mapped FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey')
def variable_id_map(spark, d):
    return P.mapped_ids(T.read(spark, d, "customer").select(F.col("c_custkey").alias("id")), T.read(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("from"), F.col("o_orderkey").alias("to")))


#: The hull of points pt (set_id, id, x, y), in order around its lowest, then leftmost point.
_HULL = """, hull AS (SELECT set_id, id AS idx, x, y FROM pt p WHERE (SELECT count(*) FROM pt q WHERE q.set_id = p.set_id) = 1 OR EXISTS (SELECT 1 FROM pt q WHERE q.set_id = p.set_id AND q.id <> p.id AND NOT EXISTS (SELECT 1 FROM pt r WHERE r.set_id = p.set_id AND r.id <> p.id AND r.id <> q.id
  AND ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0 OR ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) = 0 AND (r.x - p.x) * (r.x - q.x) + (r.y - p.y) * (r.y - q.y) > 0))))),
low AS (SELECT set_id, min({'y': y, 'x': x}) AS p FROM hull GROUP BY 1)
SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY CASE WHEN hull.x = p.x AND hull.y = p.y THEN -1 ELSE atan2(hull.y - p.y, hull.x - p.x) END) - 1 AS ord, idx, hull.x, hull.y FROM hull JOIN low USING (set_id)"""


@query(", pt AS (SELECT graph_id AS set_id, x, y, min(node_id) AS id FROM nodes GROUP BY ALL)" + _HULL)
def convex_hull_vertices(spark, d):
    n = T.customer_nodes(spark, d)
    return G.convex_hulls(n.select(F.col("graph_id").alias("set_id"), F.col("node_id").alias("idx"), "x", "y"))


@query(", pt AS (SELECT graph_id AS set_id, x, y, min(node_id) AS id FROM nodes GROUP BY ALL)" + _HULL)
def sql_convex_hull(spark, d):
    """The hull as a table function of SQL."""
    register(spark)
    return spark.sql("SELECT * FROM convex_hull(TABLE(SELECT graph_id AS set_id, node_id AS idx, x, y FROM {points}) PARTITION BY set_id)", points=T.customer_nodes(spark, d))


def _tree(spark, d):
    reg = T.read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("cluster_id"), F.lit(-1).cast("long").alias("parent_id"))
    nat = T.read(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("cluster_id"), F.col("n_regionkey").cast("long").alias("parent_id"))
    k = F.col("c_custkey").cast("long")
    root = reg.select(F.lit(-1).cast("long").alias("cluster_id"), F.lit(None).cast("long").alias("parent_id")).distinct()
    m = T.read(spark, d, "customer").select((F.col("c_nationkey") + 100).cast("long").alias("cluster_id"), k.alias("node_id"), (k * 37 % 101).cast("double").alias("min_x"), (k * 37 % 101 + 12).cast("double").alias("max_x"), (k * 91 % 103).cast("double").alias("min_y"), (k * 91 % 103 + 8).cast("double").alias("max_y"))
    return reg.unionByName(nat).unionByName(root), m


_TREE = ", tree AS (SELECT CAST(r_regionkey AS BIGINT) AS cluster_id, -1::BIGINT AS parent_id FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey FROM nation UNION ALL SELECT -1, NULL), mem AS (SELECT CAST(c_nationkey + 100 AS BIGINT) AS cluster_id, CAST((c_custkey * 37) % 101 AS DOUBLE) AS x, CAST((c_custkey * 91) % 103 AS DOUBLE) AS y FROM customer), clo AS (SELECT cluster_id AS anc, cluster_id, 1 AS n FROM tree UNION ALL SELECT t.parent_id, c.cluster_id, c.n + 1 FROM clo c JOIN tree t ON t.cluster_id = c.anc WHERE t.parent_id IS NOT NULL) "
_BOUNDS = ", bnd AS (SELECT t.cluster_id, min(x - 3 * n) AS min_x, max(x + 12 + 3 * n) AS max_x, min(y - 3 * n) AS min_y, max(y + 8 + 3 * n) AS max_y FROM tree t LEFT JOIN clo c ON c.anc = t.cluster_id LEFT JOIN mem m ON m.cluster_id = c.cluster_id GROUP BY 1) "


@query(_TREE + "SELECT t.cluster_id, coalesce(sum(CASE WHEN m.cluster_id IS NOT NULL THEN 96.0 END), 0)::DOUBLE AS area FROM tree t LEFT JOIN clo c ON c.anc = t.cluster_id LEFT JOIN mem m ON m.cluster_id = c.cluster_id GROUP BY 1")
def cluster_area(spark, d):
    """Every node is given twice to its cluster and counts once."""
    t, m = _tree(spark, d)
    return C.areas(t, m.unionByName(m))


@query(_TREE + _BOUNDS + "SELECT * FROM bnd")
def cluster_bounds(spark, d):
    return C.bounds(*_tree(spark, d), padding=3)


@query(_TREE + _BOUNDS + "SELECT cluster_id, ord, CASE WHEN ord IN (0, 3) THEN min_x - 5 ELSE max_x + 5 END AS x, CASE WHEN ord < 2 THEN min_y - 5 ELSE max_y + 5 END AS y FROM bnd, (VALUES (0::BIGINT), (1), (2), (3)) o(ord) WHERE min_x IS NOT NULL")
def cluster_boundary_hull(spark, d):
    return C.boundary(C.bounds(*_tree(spark, d), padding=3), margin=5)


#: Clusters by their paths from the root, each path ended so that it sorts after those below it: children first.
_VARS = ", paths AS (SELECT cluster_id AS id, [cluster_id] AS path FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.cluster_id, list_append(p.path, t.cluster_id) FROM paths p JOIN tree t ON t.parent_id = p.id), vars AS (SELECT cluster_id, dim, side, (2 * (row_number() OVER (PARTITION BY dim, side ORDER BY path) - 1) + side + 1000)::BIGINT AS var_id, CASE WHEN dim = 0 AND side = 0 THEN min_x WHEN dim = 0 THEN max_x WHEN side = 0 THEN min_y ELSE max_y END AS desired, 1e-7::DOUBLE AS weight FROM (SELECT bnd.*, list_append(path, 9223372036854775807) AS path FROM bnd JOIN paths ON id = cluster_id), (VALUES (0), (1)) a(dim), (VALUES (0), (1)) b(side) WHERE min_x IS NOT NULL) "


@query(_TREE + _BOUNDS + _VARS + "SELECT * FROM vars")
def cluster_vars(spark, d):
    t, m = _tree(spark, d)
    return C.boundary_variables(C.bounds(t, m, padding=3).join(C.post_order(t), "cluster_id"), "post", 1000)


@query(_TREE + _BOUNDS + _VARS + "SELECT cluster_id, dim, side, var_id, CASE WHEN cluster_id % 2 = 1 THEN dim * 100 + side * 10 ELSE desired END AS desired, CASE WHEN cluster_id % 2 = 1 THEN 2.5 ELSE weight END AS weight FROM vars")
def cluster_vars_desired(spark, d):
    """Odd clusters aim for bounds of their own."""
    t, m = _tree(spark, d)
    b = C.bounds(t, m, padding=3).join(C.post_order(t), "cluster_id")
    own = b.filter("cluster_id % 2 = 1").select("cluster_id", F.lit(0.0).alias("min_x"), F.lit(10.0).alias("max_x"), F.lit(100.0).alias("min_y"), F.lit(110.0).alias("max_y"), F.lit(2.5).alias("weight"))
    return C.boundary_variables(b, "post", 1000, own)


@query(_TREE + _BOUNDS + "SELECT cluster_id, min_x + 1 AS min_x, max_x + 1 AS max_x, min_y + 1 AS min_y, max_y + 1 AS max_y FROM bnd WHERE min_x IS NOT NULL")
def cluster_bounds_update(spark, d):
    """Bounds read back from boundary variables that have all moved by 1."""
    return C.bounds_of_variables(cluster_vars(spark, d).withColumn("position", F.col("desired") + 1))


#: Bottom-up, a level at a time: a given cluster is its rectangle; any other unites its nodes and the bounds of its children and pads them.
_GIVEN = """, given AS (SELECT cluster_id, cluster_id * 10.0 AS min_x, cluster_id * 10.0 + 5 AS max_x, 0.0 AS min_y, 7.0 AS max_y FROM tree WHERE cluster_id % 4 = 1),
own AS (SELECT cluster_id, min(x) - 3 AS min_x, max(x) + 15 AS max_x, min(y) - 3 AS min_y, max(y) + 11 AS max_y FROM mem GROUP BY 1),
low AS (SELECT t.cluster_id, parent_id, CASE WHEN g.cluster_id IS NULL THEN o.min_x ELSE g.min_x END AS min_x, CASE WHEN g.cluster_id IS NULL THEN o.max_x ELSE g.max_x END AS max_x, CASE WHEN g.cluster_id IS NULL THEN o.min_y ELSE g.min_y END AS min_y, CASE WHEN g.cluster_id IS NULL THEN o.max_y ELSE g.max_y END AS max_y
  FROM tree t LEFT JOIN own o USING (cluster_id) LEFT JOIN given g ON g.cluster_id = t.cluster_id WHERE t.cluster_id >= 100),
over_ AS (SELECT parent_id AS cluster_id, min(min_x) - 3 AS min_x, max(max_x) + 3 AS max_x, min(min_y) - 3 AS min_y, max(max_y) + 3 AS max_y FROM low GROUP BY 1),
mid AS (SELECT t.cluster_id, CASE WHEN g.cluster_id IS NULL THEN o.min_x ELSE g.min_x END AS min_x, CASE WHEN g.cluster_id IS NULL THEN o.max_x ELSE g.max_x END AS max_x, CASE WHEN g.cluster_id IS NULL THEN o.min_y ELSE g.min_y END AS min_y, CASE WHEN g.cluster_id IS NULL THEN o.max_y ELSE g.max_y END AS max_y
  FROM tree t LEFT JOIN over_ o USING (cluster_id) LEFT JOIN given g ON g.cluster_id = t.cluster_id WHERE t.cluster_id BETWEEN 0 AND 99)
SELECT cluster_id, min_x::DOUBLE AS min_x, max_x::DOUBLE AS max_x, min_y::DOUBLE AS min_y, max_y::DOUBLE AS max_y FROM (SELECT cluster_id, min_x, max_x, min_y, max_y FROM low UNION ALL SELECT * FROM mid UNION ALL SELECT -1, min(min_x) - 3, max(max_x) + 3, min(min_y) - 3, max(max_y) + 3 FROM mid)"""


@query(_TREE + _GIVEN)
def cluster_bounds_fixed(spark, d):
    """Some clusters are given rectangles, which count for the clusters above them."""
    t, m = _tree(spark, d)
    own = t.filter("cluster_id % 4 = 1").select("cluster_id", (F.col("cluster_id") * 10.0).alias("min_x"), (F.col("cluster_id") * 10.0 + 5).alias("max_x"), F.lit(0.0).alias("min_y"), F.lit(7.0).alias("max_y"))
    return C.bounds(t, m, 3, own)


@query(_TREE + ", corner AS (SELECT c_nationkey + 100 AS set_id, c_custkey * 4 + k AS id, (c_custkey * 37) % 101 + CASE WHEN k < 2 THEN 12 ELSE 0 END AS x, (c_custkey * 91) % 103 + CASE WHEN k IN (1, 2) THEN 8 ELSE 0 END AS y FROM customer, (VALUES (0), (1), (2), (3)) t(k)), edge AS (SELECT set_id, x, min(y) AS lo, max(y) AS hi FROM corner GROUP BY ALL), pt AS (SELECT CAST(set_id AS BIGINT) AS set_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(min(id) AS BIGINT) AS id FROM corner JOIN edge USING (set_id, x) WHERE y = lo OR y = hi GROUP BY ALL)" + _HULL)
def cluster_convex_hulls(spark, d):
    """Hulls of hulls: a cluster's points are dealt to small parts first."""
    return G.convex_hulls(C.corner_points(_tree(spark, d)[1]), part_points=50)


@query(", lcg AS (SELECT CAST(c_custkey AS BIGINT) AS node_id, 1 AS k, (c_custkey::BIGINT * 214013 + 2531011) % 2147483648 AS s FROM customer UNION ALL SELECT node_id, k + 1, (s * 214013 + 2531011) % 2147483648 FROM lcg WHERE k < 5) SELECT node_id, k AS pos, round((s >> 16) / 32767.0, 8) AS u FROM lcg")
def lcg_sequence(spark, d):
    c = T.read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("node_id"))
    return c.select("node_id", F.posexplode(prng.draws(F.col("node_id"), 5)).alias("pos", "u")).select("node_id", (F.col("pos") + 1).alias("pos"), F.round("u", 8).alias("u"))


@query("SELECT CAST(c_custkey AS BIGINT) AS node_id, round(5 + 4 * ((((c_custkey::BIGINT * 214013 + 2531011) % 2147483648) >> 16) / 32767.0), 7) AS u FROM customer")
def lcg_between(spark, d):
    c = T.read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("node_id"))
    return c.select("node_id", F.round(prng.between(prng.draws(F.col("node_id"), 1)[0], F.lit(5.0), F.lit(9.0)), 7).alias("u"))


@query("SELECT graph_id, node_id, dim, CASE dim WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS position FROM nodes, (VALUES (0), (1), (2)) t(dim) WHERE node_id % 4 = 0")
def lock_positions(spark, d):
    n = T.customer_nodes(spark, d).filter("node_id % 4 = 0").withColumn("dim", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    return n.select("graph_id", "node_id", "dim", S.lock_position(F.col("dim")).alias("position"))


SPEC = LayoutSpec(ideal_length=40.0, max_iterations=30)


def layout_2d(spark, d):
    e, n = _graph(spark, d)
    return layout(n, e, SPEC)


def layout_3d(spark, d):
    e, n = _graph(spark, d)
    return layout(n, e, LayoutSpec(ideal_length=40.0, max_iterations=15, dims=3, runge_kutta=False))


def layout_trace(spark, d):
    e, n = _graph(spark, d)
    return layout(n, e, SPEC, trace=True)


QUERIES |= {f.__name__: f for f in (layout_2d, layout_3d, layout_trace)}
_FLAG = "SELECT DISTINCT graph_id, true AS holds FROM nodes"


@query(_FLAG)
def layout_stress_falls(spark, d):
    return layout_2d(spark, d).groupBy("graph_id").agg(F.every(F.col("stress_after") <= F.col("stress_before") + 1e-9).alias("holds"))


@query(_FLAG)
def layout_separation_holds(spark, d):
    """Node 1 at least 30 right of node 0, node 2 level with node 1, in every graph that has them."""
    e, n = _graph(spark, d)
    out = layout(n, e, LayoutSpec(ideal_length=40.0, max_iterations=15, runge_kutta=False, separations=((0, 0, 1, 30.0, False), (1, 1, 2, 0.0, True))))
    at = out.groupBy("graph_id").agg(*[F.max(F.when(F.col("node_id") == k, F.struct("x", "y"))).alias(f"n{k}") for k in range(3)])
    full = out.groupBy("graph_id").agg((F.min("node_id") == 0).alias("zero"))
    ok = F.coalesce((F.col("n1.x") - F.col("n0.x") >= 30 - 1e-6), F.lit(True)) & F.coalesce(F.abs(F.col("n1.y") - F.col("n2.y")) < 1e-6, F.lit(True))
    return at.join(full, "graph_id").select("graph_id", (ok | ~F.col("zero")).alias("holds"))
