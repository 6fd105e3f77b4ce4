"""Graphs, rectangles and other inputs of the operators, derived from the given tables.

Every table has a group: a graph, a canvas of rectangles or a problem. Groups have a bounded
size, so work grows with the tables and spreads over groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts on one canvas, customers in one graph.
CANVAS, GRAPH = 250, 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, rect_id, min_x, max_x, min_y, max_y, x_border, y_border."""
    k = F.col("p_partkey").cast("long")
    cx, cy = (k * 37 % 500).cast("double"), (k * 91 % 500).cast("double")
    w, h = F.col("p_size").cast("double"), (F.col("p_size") % 10 + 1).cast("double")
    p = read(spark, sf_dir, "part").select(F.floor(k / CANVAS).alias("group_id"), k.alias("rect_id"), cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))
    return p.select("group_id", "rect_id", (F.col("cx") - F.col("w") / 2).alias("min_x"), (F.col("cx") + F.col("w") / 2).alias("max_x"), (F.col("cy") - F.col("h") / 2).alias("min_y"), (F.col("cy") + F.col("h") / 2).alias("max_y"), F.lit(0.0).alias("x_border"), F.lit(0.0).alias("y_border"))


def wide_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of part_rects in few large groups, of which group 0 has a third of all rows: a group is a strip of tiles of 500 by 500 that grows with the table."""
    k = F.col("p_partkey").cast("long")
    cx, cy = (k * 37 % 500 + 500 * F.floor(k / 2500)).cast("double"), (k * 91 % 500).cast("double")
    w, h = F.col("p_size").cast("double"), (F.col("p_size") % 10 + 1).cast("double")
    group = F.when(k % 3 == 0, F.lit(0)).otherwise(1 + k % 7).cast("long")
    p = read(spark, sf_dir, "part").select(group.alias("group_id"), k.alias("rect_id"), cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))
    return p.select("group_id", "rect_id", (F.col("cx") - F.col("w") / 2).alias("min_x"), (F.col("cx") + F.col("w") / 2).alias("max_x"), (F.col("cy") - F.col("h") / 2).alias("min_y"), (F.col("cy") + F.col("h") / 2).alias("max_y"), F.lit(0.0).alias("x_border"), F.lit(0.0).alias("y_border"))


def customer_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, node_id (0 to GRAPH - 1), x, y, z, w, h."""
    k = F.col("c_custkey").cast("long")
    return read(spark, sf_dir, "customer").select(F.floor(k / GRAPH).alias("graph_id"), (k % GRAPH).alias("node_id"), (k * 37 % 101).cast("double").alias("x"), (k * 91 % 103).cast("double").alias("y"), (k * 53 % 97).cast("double").alias("z"), F.lit(12.0).alias("w"), F.lit(8.0).alias("h"))


def customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, edge_idx, src, dst, length: a customer to the next but at every seventh, and to a chord; with parallel edges and self-loops."""
    n = customer_nodes(spark, sf_dir)
    here = F.col("node_id")
    chain = n.filter((here % 7 != 6) & (here < GRAPH - 1)).select("graph_id", (here * 2).alias("edge_idx"), here.alias("src"), (here + 1).alias("dst"), (here % 3 + 1).cast("double").alias("length"))
    chord = n.filter(here % 4 == 1).select("graph_id", (here * 2 + 1).alias("edge_idx"), here.alias("src"), (here * 3 % 7).alias("dst"), F.when(here % 8 == 1, F.lit(2.0)).alias("length"))
    edges = chain.unionByName(chord)
    # Both ends must be rows of the table (a graph may lack customers).
    ids = n.select("graph_id", F.col("node_id"))
    return edges.join(ids.withColumnRenamed("node_id", "src"), ["graph_id", "src"]).join(ids.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"]).select("graph_id", "edge_idx", "src", "dst", "length")


def order_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """problem_id (a customer), var_id (0, 1, ...), desired, weight: a customer's orders by date number."""
    from pyspark.sql import Window

    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("problem_id"), F.col("o_orderkey").cast("long").alias("k"))
    place = F.row_number().over(Window.partitionBy("problem_id").orderBy("k")) - 1
    return o.select("problem_id", place.cast("long").alias("var_id"), (F.col("k") * 37 % 50).cast("double").alias("desired"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("scale"))
