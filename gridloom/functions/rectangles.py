"""Rectangle functions on columns min_x, max_x, min_y, max_y, x_border, y_border. Depth (dim 2) has no extent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

X, Y, DEPTH = 0, 1, 2
_NAMES = ("min_x", "max_x", "min_y", "max_y", "x_border", "y_border")


def _c(name: str, prefix: str = "") -> Column:
    return F.col(prefix + name)


def low(dim: int, p: str = "") -> Column:
    return F.lit(0.0) if dim == DEPTH else _c("min_x", p) - _c("x_border", p) if dim == X else _c("min_y", p) - _c("y_border", p)


def high(dim: int, p: str = "") -> Column:
    return F.lit(0.0) if dim == DEPTH else _c("max_x", p) + _c("x_border", p) if dim == X else _c("max_y", p) + _c("y_border", p)


def extent(dim: int, p: str = "") -> Column:
    return high(dim, p) - low(dim, p)


def centre(dim: int, p: str = "") -> Column:
    return low(dim, p) + extent(dim, p) / 2


def is_valid(p: str = "") -> Column:
    return (_c("min_x", p) <= _c("max_x", p)) & (_c("min_y", p) <= _c("max_y", p))


def conjugate(dim: Column) -> Column:
    return F.when(dim == X, Y).otherwise(X)


def by_dim(dim: Column, of) -> Column:
    """of(dim) for a column of dims."""
    return F.when(dim == X, of(X)).when(dim == Y, of(Y)).otherwise(of(DEPTH))


def with_axis(df: DataFrame, dim: int, lo: Column, hi: Column) -> DataFrame:
    """Replace an axis by raw bounds (reset, set_min, set_max); depth changes nothing."""
    if dim == DEPTH:
        return df
    a, b = ("min_x", "max_x") if dim == X else ("min_y", "max_y")
    return df.withColumns({a: lo, b: hi})


def moved(df: DataFrame, dx: Column, dy: Column) -> DataFrame:
    return df.withColumns({"min_x": F.col("min_x") + dx, "max_x": F.col("max_x") + dx, "min_y": F.col("min_y") + dy, "max_y": F.col("max_y") + dy})


def centred(df: DataFrame, x: Column | None = None, y: Column | None = None) -> DataFrame:
    """Move centres to x and y; an axis without a target stays."""
    zero = F.lit(0.0)
    return moved(df, zero if x is None else x - centre(X), zero if y is None else y - centre(Y))


def resized(df: DataFrame, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """Keep the low edge; the given extents include both borders."""
    out = df
    if width is not None:
        out = out.withColumn("max_x", F.col("min_x") + width - 2 * F.col("x_border"))
    if height is not None:
        out = out.withColumn("max_y", F.col("min_y") + height - 2 * F.col("y_border"))
    return out


def overlap(dim: int, a: str, b: str) -> Column:
    """How far the rectangle of the lower centre reaches past the other's low edge, where the other begins before it ends; else 0. For containment this is more than the common extent."""
    if dim == DEPTH:
        return F.lit(0.0)
    ca, cb = centre(dim, a), centre(dim, b)
    return F.when((ca <= cb) & (low(dim, b) < high(dim, a)), high(dim, a) - low(dim, b)).when((cb <= ca) & (low(dim, a) < high(dim, b)), high(dim, b) - low(dim, a)).otherwise(F.lit(0.0))


def holds_point(x: Column, y: Column, p: str = "") -> Column:
    """Strictly inside."""
    return (x > low(X, p)) & (x < high(X, p)) & (y > low(Y, p)) & (y < high(Y, p))


def union_bounds() -> list[Column]:
    """Aggregates: the bounding rectangle; null for no rows."""
    return [F.min(low(X)).alias("min_x"), F.max(high(X)).alias("max_x"), F.min(low(Y)).alias("min_y"), F.max(high(Y)).alias("max_y")]


def expanded(df: DataFrame, left: float, right: float, bottom: float, top: float) -> DataFrame:
    """Grow by margins, negative ones counting as 0."""
    m = [max(0.0, float(v)) for v in (left, right, bottom, top)]
    return df.withColumns({"min_x": F.col("min_x") - m[0], "max_x": F.col("max_x") + m[1], "min_y": F.col("min_y") - m[2], "max_y": F.col("max_y") + m[3]})


def prefixed(df: DataFrame, prefix: str, keep: str = "group_id") -> DataFrame:
    return df.select(*[F.col(c).alias(c if c == keep else prefix + c) for c in df.columns])


def meeting_boxes(a: DataFrame, b: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of boxes of a and b (group_id, id, lo_x, hi_x, lo_y, hi_y) of one group that meet, borders included: group_id, a_id, b_id and the carried columns with the prefixes a_ and b_.

    A box lies in few cells of the grid whose cells are as large as itself (a power of two). A
    pair is met once: on the grid of the larger box, in the cell that holds the low corner of
    their intersection. So a huge box does not fall into many small cells.
    """
    size = F.greatest(F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y"))
    level = F.when(size > 0, F.ceil(F.log2(size)))
    # Boxes without extent take the smallest size of the group, or its mean spacing; no cell is so small that its number is no exact double.
    sides = [F.abs(F.col(c)) for c in ("lo_x", "hi_x", "lo_y", "hi_y")]
    own = a.select("group_id", "lo_x", "hi_x", "lo_y", "hi_y").unionByName(b.select("group_id", "lo_x", "hi_x", "lo_y", "hi_y"))
    stat = own.groupBy("group_id").agg(F.min(level).alias("least"), F.max(F.greatest(*sides)).alias("far"), F.greatest(F.max("hi_x") - F.min("lo_x"), F.max("hi_y") - F.min("lo_y")).alias("span"), F.count("*").alias("n"))
    stat = stat.select("group_id", F.coalesce("least", F.when(F.col("span") > 0, F.ceil(F.log2(F.col("span") / F.col("n")))), F.lit(0)).alias("least"), F.when(F.col("far") > 0, F.ceil(F.log2("far")) - 48).otherwise(F.lit(-1000)).alias("floor"))
    levelled = lambda df: df.join(stat, "group_id").withColumn("level", F.greatest(F.coalesce(level, "least"), "floor").cast("int")).drop("least", "floor")
    a, b = levelled(a), levelled(b)
    levels = a.select("group_id", "level").unionByName(b.select("group_id", "level")).distinct().groupBy("group_id").agg(F.collect_set("level").alias("levels"))

    def gridded(df: DataFrame, prefix: str) -> DataFrame:
        # One row for each grid of the same or a larger size that occurs in the group.
        up = df.join(levels, "group_id").withColumn("at", F.explode(F.expr("filter(levels, k -> k >= level)"))).withColumn("edge", F.pow(F.lit(2.0), F.col("at")))
        cells = lambda d: F.explode(F.sequence(F.floor(F.col(f"lo_{d}") / F.col("edge")), F.floor(F.col(f"hi_{d}") / F.col("edge"))))
        up = up.withColumn("gx", cells("x")).withColumn("gy", cells("y"))
        return up.select("group_id", "at", "gx", "gy", *[F.col(c).alias(prefix + c) for c in ("id", "level", "lo_x", "hi_x", "lo_y", "hi_y", *carry)], *(["edge"] if prefix == "a_" else []))

    met = gridded(a, "a_").join(gridded(b, "b_"), ["group_id", "at", "gx", "gy"]).filter(F.col("at") == F.greatest("a_level", "b_level"))
    touch = [(F.col(f"a_lo_{d}") <= F.col(f"b_hi_{d}")) & (F.col(f"b_lo_{d}") <= F.col(f"a_hi_{d}")) & (F.floor(F.greatest(f"a_lo_{d}", f"b_lo_{d}") / F.col("edge")) == F.col(f"g{d}")) for d in ("x", "y")]
    return met.filter(touch[0] & touch[1]).select("group_id", "a_id", "b_id", *[p + c for p in ("a_", "b_") for c in carry])


def boxes(rects: DataFrame, carry: tuple[str, ...] = _NAMES) -> DataFrame:
    """Rectangles with their borders as boxes for meeting_boxes."""
    return rects.select("group_id", F.col("rect_id").alias("id"), low(X).alias("lo_x"), high(X).alias("hi_x"), low(Y).alias("lo_y"), high(Y).alias("hi_y"), *carry)


def overlap_pairs(rects: DataFrame) -> DataFrame:
    """Pairs of a group that overlap on both axes, by meeting_boxes."""
    b = boxes(rects)
    hit = (F.col("a_id") < F.col("b_id")) & (low(X, "a_") < high(X, "b_")) & (low(X, "b_") < high(X, "a_")) & (low(Y, "a_") < high(Y, "b_")) & (low(Y, "b_") < high(Y, "a_"))
    return meeting_boxes(b, b, _NAMES).filter(hit).select("group_id", F.col("a_id").alias("a"), F.col("b_id").alias("b"), overlap(X, "a_", "b_").alias("overlap_x"), overlap(Y, "a_", "b_").alias("overlap_y"))


def points_inside(points: DataFrame, rects: DataFrame) -> DataFrame:
    """group_id, point_id, rect_id: points (group_id, point_id, x, y) strictly inside rectangles of their group."""
    p = points.select("group_id", F.col("point_id").alias("id"), F.col("x").alias("lo_x"), F.col("x").alias("hi_x"), F.col("y").alias("lo_y"), F.col("y").alias("hi_y"), *[F.lit(0.0).alias(c) for c in _NAMES], "x", "y")
    r = boxes(rects).withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    return meeting_boxes(p, r, (*_NAMES, "x", "y")).filter(holds_point(F.col("a_x"), F.col("a_y"), "b_")).select("group_id", F.col("a_id").alias("point_id"), F.col("b_id").alias("rect_id"))


def short_text(p: str = "") -> Column:
    """Raw bounds with two decimals, such as "Rect(0.00, 1.00, 2.00, 3.00)"."""
    return F.format_string("Rect(%.2f, %.2f, %.2f, %.2f)", *[_c(n, p) for n in _NAMES[:4]])


def text(p: str = "") -> Column:
    """Corners with borders, such as "Rectangle[(0,2),(1,3.5)]"; whole numbers have no decimals."""
    plain = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.concat(F.lit("Rectangle[("), plain(low(X, p)), F.lit(","), plain(low(Y, p)), F.lit("),("), plain(high(X, p)), F.lit(","), plain(high(Y, p)), F.lit(")]"))


def from_corner(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    """The bounds of a rectangle whose low corner and extents are given, as a resize does."""
    return [x.alias("min_x"), (x + w).alias("max_x"), y.alias("min_y"), (y + h).alias("max_y")]


def checked(df: DataFrame) -> DataFrame:
    """The same rows; one whose low edge lies beyond its high edge ends the job with an error."""
    ok = (F.col("min_x") <= F.col("max_x")) & (F.col("min_y") <= F.col("max_y"))
    return df.filter(F.assert_true(ok, F.lit("a rectangle's low edge lies beyond its high edge")).isNull())


def uniform_box(size: Column) -> Column:
    """Margins or padding of a box, the same on all four sides; negative ones count as 0."""
    side = F.greatest(size.cast("double"), F.lit(0.0))
    return F.struct(*[side.alias(n) for n in _NAMES[:4]])


def box_side(box: Column, dim: Column, high_side: bool) -> Column:
    """The side of a box along a dim; depth has none."""
    x, y = ("max_x", "max_y") if high_side else ("min_x", "min_y")
    return F.when(dim == X, box[x]).when(dim == Y, box[y]).otherwise(F.lit(0.0))


def box_is_empty(box: Column) -> Column:
    return (box["min_x"] == 0) & (box["max_x"] == 0) & (box["min_y"] == 0) & (box["max_y"] == 0)
