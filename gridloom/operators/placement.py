"""Compound placement constraints as rows: new variables (problem_id, dim, var_id, desired, weight, fixed) and separations (problem_id, dim, left, right, gap, equality). Guide lines take ids after the nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .overlap import remove_overlaps
from .projection import project, unsatisfiable

#: Weights of free and fixed guide lines, and the default priority.
FREE_WEIGHT, FIXED_WEIGHT, PRIORITY = 1e-4, 1e5, 30_000
RULE = ("problem_id", "dim", "left", "right", "gap", "equality")


def rule(left: Column, right: Column, gap: Column, equality) -> list[Column]:
    eq = F.lit(equality) if isinstance(equality, bool) else equality
    return [F.col("problem_id"), F.col("dim"), left.alias("left"), right.alias("right"), gap.cast("double").alias("gap"), eq.alias("equality")]


def guide_variables(specs: DataFrame, fixed: Column | bool = False) -> DataFrame:
    """A guide line for each row of specs (problem_id, dim, guide, position); fixed ones weigh more."""
    f = F.lit(fixed) if isinstance(fixed, bool) else fixed
    return specs.select("problem_id", "dim", F.col("guide").alias("var_id"), F.col("position").alias("desired"), F.when(f, FIXED_WEIGHT).otherwise(FREE_WEIGHT).alias("weight"), f.alias("fixed"))


def boundary(shapes: DataFrame) -> DataFrame:
    """shapes: problem_id, dim, guide, node, offset. A negative offset keeps the node below the line, any other above it."""
    o = F.col("offset")
    return shapes.select(*rule(F.when(o < 0, F.col("node")).otherwise(F.col("guide")), F.when(o < 0, F.col("guide")).otherwise(F.col("node")), F.abs(o), False))


def alignment(shapes: DataFrame) -> DataFrame:
    """guide + offset == node."""
    return shapes.select(*rule(F.col("guide"), F.col("node"), F.col("offset"), True))


def separation(pairs: DataFrame) -> DataFrame:
    """pairs: problem_id, dim, left, right, gap, equality; each row a separation."""
    return pairs.select(*rule(F.col("left"), F.col("right"), F.col("gap"), F.col("equality")))


def orthogonal_edges(pairs: DataFrame) -> DataFrame:
    """left == right."""
    return pairs.select(*rule(F.col("left"), F.col("right"), F.lit(0.0), True))


def multi_separation(specs: DataFrame) -> DataFrame:
    """specs: problem_id, dim, sep, equality, pairs array<struct<left, right>>."""
    return specs.select("problem_id", "dim", "sep", "equality", F.explode("pairs").alias("p")).select(*rule(F.col("p.left"), F.col("p.right"), F.col("sep"), F.col("equality")))


def distribution(specs: DataFrame) -> DataFrame:
    """As multi_separation, always equal."""
    return multi_separation(specs.withColumn("equality", F.lit(True)))


def pairs_of(flat: DataFrame) -> DataFrame:
    """Flat arrays of ids (problem_id, ids) as pairs: problem_id, nth, left, right; an id that is left over makes none."""
    at = flat.select("problem_id", F.posexplode("ids").alias("pos", "id")).groupBy("problem_id", F.expr("pos div 2").alias("nth"))
    both = at.agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("id"))).alias("left"), F.max(F.when(F.col("pos") % 2 == 1, F.col("id"))).alias("right"))
    return both.filter("right IS NOT NULL").select("problem_id", "nth", "left", "right")


def fixed_relative(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """members: problem_id, node; nodes: problem_id, node, x, y. Each member keeps its distance to the next by id, in both dimensions."""
    m = members.select("problem_id", "node").distinct().join(nodes, ["problem_id", "node"])
    by = Window.partitionBy("problem_id").orderBy("node")
    nxt = m.select("problem_id", "node", "x", "y", F.lead(F.struct("node", "x", "y")).over(by).alias("n")).filter("n IS NOT NULL")
    both = nxt.select("problem_id", "node", "n", F.explode(F.array(F.struct(F.lit(0).alias("dim"), (F.col("n.x") - F.col("x")).alias("gap")), F.struct(F.lit(1).alias("dim"), (F.col("n.y") - F.col("y")).alias("gap")))).alias("a"))
    return both.select("problem_id", F.col("a.dim").alias("dim"), "node", "n", F.col("a.gap").alias("gap")).select(*rule(F.col("node"), F.col("n.node"), F.col("gap"), True))


def fixed_members(members: DataFrame) -> DataFrame:
    """Weights of the members of a fixed-position group."""
    return members.select("problem_id", F.col("node").alias("var_id"), F.lit(FIXED_WEIGHT).alias("weight")).distinct()


def page_boundary(shapes: DataFrame) -> DataFrame:
    """shapes: problem_id, dim, low_guide, high_guide, node, half. Nothing for depth."""
    s = shapes.filter("dim < 2")
    return s.select(*rule(F.col("low_guide"), F.col("node"), F.col("half"), False)).unionByName(s.select(*rule(F.col("node"), F.col("high_guide"), F.col("half"), False)))


def mapped_ids(ids: DataFrame, mapping: DataFrame, reverse: bool = False) -> DataFrame:
    """ids (id) through mapping (seq, from, to): the first mapping of an id counts; an id without one stays."""
    key, value = ("to", "from") if reverse else ("from", "to")
    first = mapping.groupBy(F.col(key).alias("id")).agg(F.min_by(value, "seq").alias("other"))
    return ids.join(first, "id", "left").select("id", F.coalesce("other", "id").alias("mapped"))


def by_priority(specs: DataFrame) -> DataFrame:
    """Numbered by ascending priority, then by order."""
    return specs.withColumn("rank", F.row_number().over(Window.partitionBy("problem_id").orderBy(F.coalesce("priority", F.lit(PRIORITY)), "cc_id")))


def rules_of(parts: dict[str, DataFrame]) -> DataFrame:
    """The rules of compound constraints of mixed kinds in one table, with their kind: parts maps a kind to its input. fixed_relative has members with their places: problem_id, node, x, y."""
    make = {"boundary": boundary, "alignment": alignment, "separation": separation, "orthogonal": orthogonal_edges, "multi_separation": multi_separation, "distribution": distribution, "page_boundary": page_boundary, "fixed_relative": lambda df: fixed_relative(df, df.select("problem_id", "node", "x", "y").distinct())}
    out = [make[kind](df).select(*RULE).withColumn("kind", F.lit(kind)) for kind, df in parts.items()]
    total = out[0]
    for more in out[1:]:
        total = total.unionByName(more)
    return total


def page_guides(pages: DataFrame, first_id: int, weight: float = 1.0) -> DataFrame:
    """The two margin variables of a page (problem_id, dim, low, high) for each dimension: ids first_id and first_id + 1, which every dimension has of its own."""
    side = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("low").alias("desired")), F.struct(F.lit(1).alias("k"), F.col("high").alias("desired")))).alias("s")
    return pages.filter("dim < 2").select("problem_id", "dim", side).select("problem_id", "dim", (F.col("s.k") + first_id).cast("long").alias("var_id"), F.col("s.desired").alias("desired"), F.lit(weight).alias("weight"), F.lit(False).alias("fixed"))


def _problem(nodes: DataFrame, rules: DataFrame, dim: int, guides: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    v = nodes.select(F.col("graph_id").alias("problem_id"), F.col("node_id").alias("var_id"), F.col("xyz"[dim]).alias("desired"), F.lit(1.0).alias("weight"))
    if guides is not None:
        v = v.unionByName(guides.filter(F.col("dim") == dim).select("problem_id", "var_id", "desired", "weight"))
    order = [F.coalesce(F.col("priority"), F.lit(PRIORITY))] if "priority" in rules.columns else []
    number = F.row_number().over(Window.partitionBy("problem_id").orderBy(*order, *(["cc_id"] if "cc_id" in rules.columns else []), "left", "right", "gap", "equality"))
    c = rules.filter(F.col("dim") == dim).withColumn("c_id", number).select("problem_id", "c_id", "left", "right", "gap", "equality")
    return v.withColumn("scale", F.lit(1.0)), c


def project_onto(nodes: DataFrame, rules: DataFrame, dim: int, guides: DataFrame | None = None) -> DataFrame:
    """problem_id, var_id, position, error_level: the positions nearest to those of nodes (graph_id, node_id, x, y, z) along an axis that keep the rules; guide lines are variables of their own. error_level is 1 where rules contradict each other: then those of a later number (by priority, default 30000, then cc_id) are left out, which unsatisfied_rules names."""
    return project(*_problem(nodes, rules, dim, guides)).select("problem_id", "var_id", "position", (F.col("unsatisfied") > 0).cast("int").alias("error_level"))


def unsatisfied_rules(nodes: DataFrame, rules: DataFrame, dim: int, guides: DataFrame | None = None) -> DataFrame:
    """problem_id, dim, left, right, gap, equality of the rules that project_onto leaves out."""
    return unsatisfiable(*_problem(nodes, rules, dim, guides)).select("problem_id", F.lit(dim).alias("dim"), "left", "right", "gap", "equality")


def make_feasible(nodes: DataFrame, rules: DataFrame, guides: DataFrame | None = None, avoid_overlaps: bool = False) -> DataFrame:
    """graph_id, node_id, x, y, w, h: nodes moved as little as possible so that all rules hold, in both axes; of rules that contradict each other those of a smaller priority hold. With avoid_overlaps, rectangles that still overlap are then moved apart."""
    at = lambda dim, name: project_onto(nodes, rules, dim, guides).select(F.col("problem_id").alias("graph_id"), F.col("var_id").alias("node_id"), F.col("position").alias(name))
    out = nodes.select("graph_id", "node_id", "w", "h").join(at(0, "x"), ["graph_id", "node_id"]).join(at(1, "y"), ["graph_id", "node_id"])
    if not avoid_overlaps:
        return out.select("graph_id", "node_id", "x", "y", "w", "h")
    rects = out.select(F.col("graph_id").alias("group_id"), F.col("node_id").alias("rect_id"), (F.col("x") - F.col("w") / 2).alias("min_x"), (F.col("x") + F.col("w") / 2).alias("max_x"), (F.col("y") - F.col("h") / 2).alias("min_y"), (F.col("y") + F.col("h") / 2).alias("max_y"), F.lit(0.0).alias("x_border"), F.lit(0.0).alias("y_border"))
    moved = remove_overlaps(rects).select(F.col("group_id").alias("graph_id"), F.col("rect_id").alias("node_id"), ((F.col("min_x") + F.col("max_x")) / 2).alias("x"), ((F.col("min_y") + F.col("max_y")) / 2).alias("y"))
    return moved.join(nodes.select("graph_id", "node_id", "w", "h"), ["graph_id", "node_id"])
