"""Matrices (m_id, i, j, v) and vectors (m_id, i, v) as relations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import written

#: Unknowns of a system that is solved whole in a task.
SMALL = 20_000


def last_set(entries: DataFrame) -> DataFrame:
    """Of several settings (m_id, i, j, v, seq) of a cell the last counts."""
    return entries.groupBy("m_id", "i", "j").agg(F.max_by("v", "seq").alias("v"))


def cells(matrix: DataFrame, wanted: DataFrame) -> DataFrame:
    """m_id, i, j, v of the wanted cells (m_id, i, j); 0 where none is stored."""
    return wanted.select("m_id", "i", "j").join(matrix, ["m_id", "i", "j"], "left").select("m_id", "i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def rows_of(matrix: DataFrame) -> DataFrame:
    """Compressed rows: m_id, i, columns and values in column order."""
    r = matrix.groupBy("m_id", "i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r"))
    return r.select("m_id", "i", F.col("r.j").alias("columns"), F.col("r.v").alias("values"))


def times_vector(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """Matrix times vector; a row without entries gives 0."""
    x = vector.select("m_id", F.col("i").alias("j"), F.col("v").alias("x"))
    got = matrix.join(x, ["m_id", "j"]).groupBy("m_id", "i").agg(F.sum(F.col("v") * F.col("x")).alias("got"))
    return vector.select("m_id", "i").join(got, ["m_id", "i"], "left").select("m_id", "i", F.coalesce("got", F.lit(0.0)).alias("v"))


def inner(a: DataFrame, b: DataFrame) -> DataFrame:
    """m_id, v."""
    return a.join(b.withColumnRenamed("v", "w"), ["m_id", "i"]).groupBy("m_id").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def quadratic_cost(matrix: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """m_id, v: 2 b'x - x'Ax."""
    bx, xax = inner(b, x).withColumnRenamed("v", "bx"), inner(x, times_vector(matrix, x)).withColumnRenamed("v", "xax")
    return bx.join(xax, "m_id").select("m_id", (2 * F.col("bx") - F.col("xax")).alias("v"))


def steepest_step(matrix: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """m_id, alpha: g'g / (2 g'Qg) with g = b - Qx; 0 for a vanishing g, null where g'Qg vanishes."""
    g = b.join(times_vector(matrix, x).withColumnRenamed("v", "q"), ["m_id", "i"]).select("m_id", "i", (F.col("v") - F.col("q")).alias("v"))
    gg, gqg = inner(g, g).withColumnRenamed("v", "gg"), inner(g, times_vector(matrix, g)).withColumnRenamed("v", "gqg")
    return gg.join(gqg, "m_id").select("m_id", F.when(F.col("gg") < 1e-30, F.lit(0.0)).when(F.abs("gqg") < 1e-30, F.lit(None)).otherwise(F.try_divide("gg", 2 * F.col("gqg"))).alias("alpha"))


def scaled(matrix: DataFrame, sparse: DataFrame | None = None) -> DataFrame:
    """S (Q + sparse) S with S the inverse roots of the diagonal's absolute values (1 where it vanishes)."""
    full = matrix.select("m_id", "i", "j", "v")
    if sparse is not None:
        full = full.unionByName(sparse.select("m_id", "i", "j", "v")).groupBy("m_id", "i", "j").agg(F.sum("v").alias("v"))
    s = matrix.filter("i = j").select("m_id", "i", F.when(F.abs("v") > 1e-30, F.try_divide(F.lit(1.0), F.sqrt(F.abs("v")))).otherwise(F.lit(1.0)).alias("s"))
    two = full.join(s, ["m_id", "i"]).join(s.select("m_id", F.col("i").alias("j"), F.col("s").alias("t")), ["m_id", "j"])
    return two.select("m_id", "i", "j", (F.col("v") * F.col("s") * F.col("t")).alias("v"))


def gradient_rounds(matrix: DataFrame, b: DataFrame, tolerance: float, max_iterations: int) -> DataFrame:
    """m_id, i, v: conjugate gradients of all systems side by side. A round is one product of the matrices with the directions of the systems that have not stopped, and two sums for each; no system has to fit a task."""
    a = written(matrix.select("m_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")), "matrix")
    start = b.select("m_id", F.col("i").cast("long").alias("i"), F.lit(0.0).alias("x"), F.col("v").cast("double").alias("r"), F.col("v").cast("double").alias("p"))
    state, limit = written(start, "state"), tolerance * tolerance
    rr = written(state.groupBy("m_id").agg(F.sum(F.col("r") * F.col("r")).alias("rr")), "residuals")
    for _ in range(max_iterations):
        live = rr.filter(F.col("rr") > limit)
        if live.isEmpty():
            return state.select("m_id", "i", F.col("x").alias("v"))
        p = state.join(live, "m_id").select("m_id", "i", F.col("p").alias("v"))
        ap = times_vector(a.join(live.select("m_id"), "m_id", "left_semi"), p).withColumnRenamed("v", "ap")
        moved = written(state.join(ap, ["m_id", "i"], "left").withColumn("ap", F.coalesce("ap", F.lit(0.0))), "products")
        step = moved.groupBy("m_id").agg(F.sum(F.col("p") * F.col("ap")).alias("pap")).join(rr, "m_id")
        # A system that has stopped stays; a direction without curvature too.
        step = step.select("m_id", "rr", F.when((F.col("rr") > limit) & (F.abs("pap") > 1e-300), F.try_divide("rr", "pap")).otherwise(F.lit(0.0)).alias("step"))
        next_ = written(moved.join(step, "m_id").select("m_id", "i", "p", (F.col("x") + F.col("step") * F.col("p")).alias("x"), (F.col("r") - F.col("step") * F.col("ap")).alias("r")), "steps", instead_of=moved)
        new = written(next_.groupBy("m_id").agg(F.sum(F.col("r") * F.col("r")).alias("new")).join(rr, "m_id").select("m_id", F.col("new").alias("rr"), F.when(F.col("rr") > 0, F.try_divide("new", "rr")).otherwise(F.lit(0.0)).alias("turn")), "residuals", instead_of=None)
        state = written(next_.join(new, "m_id").select("m_id", "i", "x", "r", (F.col("r") + F.col("turn") * F.col("p")).alias("p")), "state", instead_of=state)
        rr = new.select("m_id", "rr")
    raise ArithmeticError("a system was not solved within its iterations")


def conjugate_gradient(matrix: DataFrame, b: DataFrame, tolerance: float = 1e-10, max_iterations: int = 1000, small: int = SMALL) -> DataFrame:
    """Solve Ax = b for many symmetric positive definite systems: m_id, i, v. A system stops when its squared residual is at most tolerance squared; raises if one does not within max_iterations. Systems of at most small unknowns are solved whole, each in a task; larger ones by rounds over tables (gradient_rounds)."""

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, rhs = right.column("b_i").to_numpy(), right.column("b_v").to_numpy()
        order = np.argsort(ids)
        ids, rhs = ids[order], rhs[order]
        i, j, v = np.searchsorted(ids, left.column("a_i").to_numpy()), np.searchsorted(ids, left.column("a_j").to_numpy()), left.column("a_v").to_numpy()
        x, r = np.zeros(len(ids)), rhs.copy()
        p, rr = r.copy(), float(r @ r)
        for _ in range(max_iterations):
            if rr <= tolerance * tolerance:
                break
            ap = np.bincount(i, v * p[j], len(ids))
            den = float(p @ ap)
            if abs(den) < 1e-300:
                break
            x, r = x + rr / den * p, r - rr / den * ap
            new = float(r @ r)
            p, rr = r + new / rr * p, new
        else:
            raise ArithmeticError("the system was not solved within its iterations")
        return pa.table({"m_id": pa.array([right.column("m_id")[0].as_py()] * len(ids), pa.int64()), "i": pa.array(ids, pa.int64()), "v": x})

    many = written(b.groupBy("m_id").agg(F.count("*").alias("n")).filter(F.col("n") > small).select("m_id"), "large")
    large = None if many.isEmpty() else gradient_rounds(matrix.join(many, "m_id", "left_semi"), b.join(many, "m_id", "left_semi"), tolerance, max_iterations)
    matrix, b = matrix.join(many, "m_id", "left_anti"), b.join(many, "m_id", "left_anti")
    # New names on both sides: they may stem from one table.
    own = lambda df, p, names: df.select(F.col("m_id").cast("long").alias("m_id"), *[F.col(c).cast(t).alias(p + c) for c, t in names])
    m = own(matrix, "a_", (("i", "long"), ("j", "long"), ("v", "double"))).groupBy("m_id")
    whole = m.cogroup(own(b, "b_", (("i", "long"), ("v", "double"))).groupBy("m_id")).applyInArrow(solve, "m_id long, i long, v double")
    return whole if large is None else whole.unionByName(large)
