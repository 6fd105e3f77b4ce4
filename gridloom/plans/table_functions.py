"""Kernels as table functions of SQL. register(spark) adds them to a session; each takes a table, dealt out and ordered by the statement:

    SELECT * FROM separated_chain(TABLE(SELECT problem_id, var_id, desired, weight, gap FROM v) PARTITION BY problem_id ORDER BY var_id)
    SELECT * FROM convex_hull(TABLE(SELECT set_id, idx, x, y FROM p) PARTITION BY set_id)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from ..operators.graph import _hull
from ..operators.projection import pooled


class Gathered:
    """The batches of a partition, which stay in Arrow."""

    def __init__(self):
        self.batches: list[pa.RecordBatch] = []

    def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
        self.batches.append(table)
        return iter(())

    def whole(self) -> pa.Table | None:
        return pa.Table.from_batches(self.batches) if sum(b.num_rows for b in self.batches) else None


@arrow_udtf(returnType="problem_id bigint, var_id bigint, position double")
class SeparatedChain(Gathered):
    """Positions of a chain whose next variable is at least gap beyond each."""

    def terminate(self) -> Iterator[pa.Table]:
        t = self.whole()
        if t is not None:
            desired, weight, gap = (t.column(c).cast(pa.float64()).to_numpy() for c in ("desired", "weight", "gap"))
            offset = np.r_[0.0, np.cumsum(gap[:-1])]
            mean, count = pooled(desired - offset, weight)
            yield t.select(["problem_id", "var_id"]).append_column("position", pa.array(np.repeat(mean, count) + offset))


@arrow_udtf(returnType="set_id bigint, ord bigint, idx bigint, x double, y double")
class ConvexHull(Gathered):
    """The hull of a set of points, counter-clockwise from the lowest, then leftmost one."""

    def terminate(self) -> Iterator[pa.Table]:
        t = self.whole()
        if t is not None:
            yield _hull(t.select(["set_id", "idx", "x", "y"]))


def register(spark: SparkSession) -> None:
    spark.udtf.register("separated_chain", SeparatedChain)
    spark.udtf.register("convex_hull", ConvexHull)
