"""Cut lineage in iterative plans by a written table in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about.
PART_ROWS = 1_000_000


def written(df: DataFrame, tag: str, instead_of: DataFrame | None = None) -> DataFrame:
    """df as a written table. instead_of: an earlier result of written that nothing needs from now on; its files are deleted."""
    spark = df.sparkSession
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    path = f"{place.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if instead_of is not None:
        forget(instead_of)
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a result of written that nothing needs from now on."""
    spark = df.sparkSession
    old = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def dealt(df: DataFrame, *order: str, rows: int = PART_ROWS) -> DataFrame:
    """df as a written table in ranges of the order columns, with part, the number of a row's range; about rows to a range."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // rows)
    return written(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")


def counts_before(ranges: DataFrame, keys: list[str], order: list[str], counted: Column) -> DataFrame:
    """ranges (of dealt, in the order of keys, then order) with before: how many rows of the same keys that are counted come earlier."""
    return sums_before(ranges, keys, order, counted.cast("long"))


def sums_before(ranges: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """As counts_before, with before the sum of a value."""
    ones, none = F.sum(value), F.lit(0)
    inside = F.coalesce(ones.over(Window.partitionBy("part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), none)
    # A row for each range of a key.
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier_rows = ranges.groupBy(*keys, "part").agg(ones.alias("n")).select(*keys, "part", F.coalesce(F.sum("n").over(earlier), none).alias("rows_before_part"))
    return ranges.withColumn("before", inside).join(earlier_rows, [*keys, "part"]).withColumn("before", F.col("before") + F.col("rows_before_part")).drop("rows_before_part")


def neighbours(ranges: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """ranges (of dealt, in the order of keys, then order) with prev and next: the nearest value of the same keys that is not null, before and after a row.

    A key may reach over many ranges, so none has to fit a task: what a range lacks at its ends comes from the ends of the others, a row each.
    """
    # Frames that end at the last row are computed anew for each row; so what comes next is what came before in the reverse order.
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    at = Window.partitionBy("part", *keys)
    out = ranges.withColumn("prev", F.last(value, True).over(before(at.orderBy(*order)))).withColumn("next", F.last(value, True).over(before(at.orderBy(*[F.desc(c) for c in order]))))
    key = F.struct(*keys)
    ends = ranges.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    edge = ranges.join(F.broadcast(ends), "part").filter(key.eqNullSafe(F.col("low")) | key.eqNullSafe(F.col("high")))
    has = F.when(F.col(value).isNotNull(), F.struct(*order, value))
    edge = edge.groupBy(*keys, "part").agg(F.min(has)[value].alias("first"), F.max(has)[value].alias("last"))
    by = Window.partitionBy(*keys)
    carried = edge.select(*keys, "part", F.last("last", True).over(before(by.orderBy("part"))).alias("from_low"), F.last("first", True).over(before(by.orderBy(F.desc("part")))).alias("from_high"))
    out = out.join(carried, [*keys, "part"], "left")
    return out.withColumn("prev", F.coalesce("prev", "from_low")).withColumn("next", F.coalesce("next", "from_high")).drop("from_low", "from_high")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with rank (from 0) by a column of distinct values: rows are dealt by ranges of it, ranked in each range, and the ranges' sizes give each range's first rank."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()), "ranges")
    # A row for each range.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return dealt.withColumn("rank", rank).join(first, "part").withColumn("rank", F.col("rank") + F.col("first")).drop("part", "first")
