"""Non-overlap constraints from a sweep, and overlap removal."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rectangles import X, Y, extent, high, low, meeting_boxes
from ..plans.cut import counts_before, dealt, neighbours, sums_before, written
from .projection import chain_projection, project_forward, solve_forward

#: Extra gap, and weights of fixed and other rectangles.
EXTRA_GAP, FIXED_WEIGHT = 1e-3, 10_000.0
#: Rectangles of a group that is solved whole in a task, in arrays of their square.
SMALL = 1000
#: Rectangles of small groups that a task solves at once, about.
BATCH = 5000
#: Rectangles of a large group in the order of centres that one is held against on either side (in _next_apart, a chunk of them at once), and such chunks of a task.
CHUNK, RUN = 1000, 16
#: Rectangles without a neighbour among these that are held against their whole groups; more ask trees.
FEW = 1000
#: Rectangles that a task sweeps, and that it projects at first.
SWEPT, PLACED = 20_000, 10_000
#: A group goes through trees if its sweep would keep each rectangle open for more ranges than this, on average.
CROWDED = 8
SIDES = ("min_x", "max_x", "min_y", "max_y")


def _middle(dim: int) -> Column:
    """The centre without borders, whose rounding would part equal centres."""
    lo, hi = _sides(dim)
    return (F.col(lo) + F.col(hi)) / 2


def on_ranks(spans: DataFrame, keys: list[str]) -> DataFrame:
    """spans (keys, id, lo, hi) with t0 and t1, the ranks of their ends among all ends of the same keys. Of equal values those of low ends come first, so spans that touch share a rank in between; then smaller ids."""
    end = F.explode(F.array(F.struct(F.col("lo").alias("v"), F.lit(0).alias("kind")), F.struct(F.col("hi").alias("v"), F.lit(1).alias("kind")))).alias("e")
    ends = dealt(spans.select(*keys, "id", end).select(*keys, "e.v", "e.kind", "id"), *keys, "v", "kind", "id")
    ranked = counts_before(ends, keys, ["v", "kind", "id"], F.lit(1)).groupBy(*keys, "id").agg(F.max(F.when(F.col("kind") == 0, F.col("before"))).alias("t0"), F.max(F.when(F.col("kind") == 1, F.col("before"))).alias("t1"))
    return spans.join(ranked, [*keys, "id"])


def nodes_of(first: Column, end: Column) -> Column:
    """The nodes (level, place) of the binary tree over ranks that make up first, ..., end - 1: two to a level at most."""
    # At level k the ranks that no lower node has covered begin at ceil(first / 2^k) and end at floor(end / 2^k).
    k_range = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(end, F.lit(1)) + 1)).cast("int"))

    def level(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k).cast("long")
        a, b = F.ceil(first / size), F.floor(end / size)
        node = lambda ok, at: F.when(ok, F.struct(k.alias("level"), at.alias("place")))
        return F.array(node((a < b) & (a % 2 == 1), a), node((a < b) & (b % 2 == 1) & ((a % 2 == 0) | (a + 1 < b)), b - 1))

    return F.array_compact(F.flatten(F.transform(k_range, level)))


def nodes_above(at: Column, ranks: Column) -> Column:
    """The nodes (level, place) that hold the rank at, of a tree over so many ranks."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.log2(ranks + 1)).cast("int")), lambda k: F.struct(k.alias("level"), F.floor(at / F.pow(F.lit(2.0), k)).alias("place")))


def nearest_stabbed(spans: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, under, over: for each point (keys, id, at, c, o) the nearest of the spans that hold it, on either side of (c, o).

    spans: keys, first, end (ranks first, ..., end - 1), c, o, and value, a struct that begins with
    c and o. A span falls into O(log n) nodes of a binary tree over the ranks and a point looks into
    its O(log n) ancestors; in each node one pass in the order of (c, o) gives the nearest. So work
    grows as n log n, whatever overlaps.
    """
    ranks = spans.groupBy(*keys).agg(F.max("end").alias("ranks"))
    into = spans.filter("first < end").withColumn("node", F.explode(nodes_of(F.col("first"), F.col("end"))))
    return _nearest(into, points.join(ranks, keys).filter("at < ranks").withColumn("node", F.explode(nodes_above(F.col("at"), F.col("ranks")))), keys)


def nearest_within(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, under, over: as nearest_stabbed, for each span (keys, id, first, end, c, o) the nearest of the points (keys, at, c, o, value) that it holds."""
    ranks = spans.groupBy(*keys).agg(F.max("end").alias("ranks"))
    ask = spans.filter("first < end").withColumn("node", F.explode(nodes_of(F.col("first"), F.col("end"))))
    return _nearest(points.join(ranks, keys).filter("at < ranks").withColumn("node", F.explode(nodes_above(F.col("at"), F.col("ranks")))), ask, keys)


def _nearest(into: DataFrame, ask: DataFrame, keys: list[str]) -> DataFrame:
    into = into.select(*keys, "node.level", "node.place", "c", "o", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "value")
    ask = ask.select(*keys, "node.level", "node.place", "c", "o", F.lit(1).alias("kind"), "id", F.lit(None).cast(into.schema["value"].dataType).alias("value"))
    tree = dealt(into.unionByName(ask), *keys, "level", "place", "c", "o", "kind", "id")
    near = neighbours(tree, [*keys, "level", "place"], ["c", "o", "kind", "id"], "value").filter("kind = 1")
    return near.groupBy(*keys, "id").agg(F.max("prev").alias("under"), F.min("next").alias("over"))


def sweep_constraints(rects: DataFrame, dim: int) -> DataFrame:
    """group_id, left, right, gap: for each rectangle, its nearest neighbours on the axis among those open when its sweep over the other axis closes. Touching rectangles are open together. A group may be of any size.

    Rectangles are dealt in ranges of their closing; a task sweeps a range, with those of later ranges that are open in it.
    Groups in which these are too many go through trees (_swept_by_trees).
    """
    other = Y if dim == X else X
    r = rects.select(F.col("group_id").cast("long").alias("group_id"), F.col("rect_id").cast("long").alias("id"), low(other).alias("lo"), high(other).alias("hi"), _middle(dim).alias("c"), extent(dim).alias("size"))
    r = dealt(r, "group_id", "hi", "id", rows=SWEPT)
    # A row for each range of a group; only groups of several ranges have any that are open elsewhere.
    ends = written(r.groupBy("group_id", "part").agg(F.max("hi").alias("high"), F.count("*").alias("n")), "ends")
    split = ends.groupBy("group_id").agg(F.count("*").alias("parts"), F.sum("n").alias("n")).filter("parts > 1")
    ends = ends.join(split.select("group_id"), "group_id", "left_semi").select("group_id", F.col("part").alias("at"), "high")
    open_ = r.join(F.broadcast(ends), "group_id").filter((F.col("at") < F.col("part")) & (F.col("lo") <= F.col("high")) & (F.col("lo") <= F.col("hi"))).drop("high")
    crowded = written(open_.groupBy("group_id").agg(F.count("*").alias("open")).join(split, "group_id").filter(F.col("open") > CROWDED * F.col("n")).select("group_id"), "crowded")
    rows = r.withColumn("at", F.col("part")).unionByName(open_)

    def swept(t: pa.Table) -> pa.Table:
        t = t.sort_by("group_id")
        of, own = t.column("group_id").to_numpy(), t.column("part").to_numpy() == t.column("at").to_numpy()
        lo, hi, c, size, ids = (t.column(k).to_numpy() for k in ("lo", "hi", "c", "size", "id"))
        ends = [*np.flatnonzero(np.diff(of)) + 1, t.num_rows]
        got = [(i, *closed(lo[i:j], hi[i:j], c[i:j], ids[i:j], np.flatnonzero(own[i:j]))) for i, j in zip([0, *ends], ends)]
        left, right = (np.concatenate([g[k] + g[0] for g in got]) for k in (1, 2))
        return pa.table({"group_id": of[left], "left": ids[left], "right": ids[right], "gap": (size[left] + size[right]) / 2})

    spark = r.sparkSession
    n = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    sweep_all = lambda df: df.repartition(n, "at").groupBy("at").applyInArrow(swept, "group_id long, left long, right long, gap double")
    if crowded.isEmpty():
        return sweep_all(rows)
    large = _swept_by_trees(r.drop("part").join(crowded, "group_id", "left_semi"))
    return sweep_all(rows.join(crowded, "group_id", "left_anti")).unionByName(large)


def closed(lo: np.ndarray, hi: np.ndarray, c: np.ndarray, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some rectangles of one group, in the order in which they close, the neighbours on either side in the order of (c, id) that are open then: places of left and right ends. The others stay open until the last has closed."""
    order = np.lexsort((ids, c))
    place = np.empty(len(c), int)
    place[order] = np.arange(len(c))
    opens = np.argsort(lo, kind="stable")
    opens = opens[lo[opens] <= hi[opens]]
    closes = own[np.lexsort((ids[own], hi[own]))]
    opening, begun, line = place[opens].tolist(), 0, []
    left, right = [], []
    for v, to in zip(place[closes].tolist(), np.searchsorted(lo[opens], hi[closes], "right").tolist()):
        if to - begun > 64:
            line += opening[begun:to]
            line.sort()
        else:
            for p in opening[begun:to]:
                insort(line, p)
        begun = to
        at = bisect_left(line, v)
        after = at + 1 if at < len(line) and line[at] == v else at
        if at:
            left.append(line[at - 1])
            right.append(v)
        if after < len(line):
            left.append(v)
            right.append(line[after])
        del line[at:after]
    return order[np.array(left, int)], order[np.array(right, int)]


def _swept_by_trees(r: DataFrame) -> DataFrame:
    """sweep_constraints for groups of any overlap (see nearest_stabbed); r: group_id, id, lo, hi, c, size."""
    r = written(on_ranks(r, ["group_id"]), "open")
    # Open from the low end on, without its own closing.
    spans = r.select("group_id", F.col("t0").alias("first"), F.col("t1").alias("end"), "c", F.col("id").alias("o"), F.struct("c", F.col("id").alias("o"), "size").alias("value"))
    near = nearest_stabbed(spans, r.select("group_id", "id", F.col("t1").alias("at"), "c", F.col("id").alias("o")), ["group_id"])
    near = near.join(r.select("group_id", "id", "size"), ["group_id", "id"])
    side = lambda s, left, right: near.filter(F.col(s).isNotNull()).select("group_id", left.alias("left"), right.alias("right"), ((F.col("size") + F.col(s)["size"]) / 2).alias("gap"))
    return side("under", F.col("under.o"), F.col("id")).unionByName(side("over", F.col("id"), F.col("over.o")))


def neighbour_constraints(rects: DataFrame, small: int = SMALL) -> DataFrame:
    """group_id, left, right, gap along x from neighbour lists: of the rectangles that share a part of the y axis with one, the nearest on either side that does not overlap it in x, and before that those whose overlap in x is at most that in y.

    Groups of at most small rectangles are listed in arrays, many to a task; larger ones by _listed_by_tables.
    """
    r = rects.select(F.col("group_id").cast("long").alias("group_id"), F.col("rect_id").cast("long").alias("rect_id"), low(X).alias("min_x"), high(X).alias("max_x"), low(Y).alias("min_y"), high(Y).alias("max_y"))

    def lists(t: pa.Table) -> pa.Table:
        t = t.sort_by([("group_id", "ascending"), ("rect_id", "ascending")])
        box, ids, of = np.stack([t.column(c).to_numpy() for c in SIDES], 1), t.column("rect_id").to_numpy(), t.column("group_id").to_numpy()
        size = box[:, 1] - box[:, 0]
        c = box[:, 0] + size / 2
        ends = [*np.flatnonzero(np.diff(of)) + 1, t.num_rows]
        got = [(i, *listed(box[i:j], c[i:j], size[i:j], box[i:j, 2] + box[i:j, 3], True)) for i, j in zip([0, *ends], ends)]
        left, right = (np.concatenate([g[k] + g[0] for g in got]) for k in (1, 2))
        return pa.table({"group_id": of[left], "left": ids[left], "right": ids[right], "gap": np.concatenate([g[3] for g in got])})

    sizes = written(r.groupBy("group_id").agg(F.count("*").alias("n")), "sizes")
    many = sizes.filter(F.col("n") > small).select("group_id")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    spark = r.sparkSession
    batches = max(8, total // BATCH)
    # As many partitions as there are tasks to run, each of many batches.
    n = min(batches, 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    part = r.join(many, "group_id", "left_anti").withColumn("batch", F.pmod(F.xxhash64("group_id"), F.lit(batches))).repartition(n, "batch")
    few = part.groupBy("batch").applyInArrow(lists, "group_id long, left long, right long, gap double")
    if many.isEmpty():
        return few
    large = _listed_by_tables(rects.join(many, "group_id", "left_semi")).select([F.col(c).cast(t).alias(c) for c, t in few.dtypes])
    return large if sizes.filter(F.col("n") <= small).isEmpty() else few.unionByName(large)


def _next_apart(r: DataFrame) -> DataFrame:
    """group_id, id, stop, back, ahead, behind: of the rectangles that share a part of the y axis with one, the nearest that lies apart from it in x on either side, as far as it is among the next or the last CHUNK rectangles by their centres; ahead, behind: it may be farther away."""
    ranges = counts_before(dealt(r, "group_id", "c", "id"), ["group_id"], ["c", "id"], F.lit(1))
    ranges = ranges.join(r.groupBy("group_id").agg(F.count("*").alias("n")), "group_id").withColumn("chunk", F.floor(F.col("before") / CHUNK))
    rows = ranges.select("group_id", "id", "lo", "hi", "x0", "x1", "before", "n", "chunk", F.explode(F.sequence(F.col("chunk") - 1, F.col("chunk") + 1)).alias("at"))

    def seek(t: pa.Table) -> pa.Table:
        t = t.sort_by("before")
        lo, hi, x0, x1, ids, before = (t.column(c).to_numpy() for c in ("lo", "hi", "x0", "x1", "id", "before"))
        own = np.flatnonzero(t.column("chunk").to_numpy() == t.column("at").to_numpy())
        place, m = np.arange(len(ids))[None, :], len(ids)
        line = (lo[own, None] <= hi[None, :]) & (lo[None, :] <= hi[own, None])
        right = line & (place > own[:, None]) & (x1[own, None] <= x0[None, :])
        left = (line & (place < own[:, None]) & (x1[None, :] <= x0[own, None]))[:, ::-1]
        on, off = right.any(1), left.any(1)
        end, begin = m > 0 and before[-1] == t.column("n")[0].as_py() - 1, m > 0 and before[0] == 0
        stop, back = right.argmax(1), m - 1 - left.argmax(1)
        return pa.table({"group_id": t.column("group_id").take(own), "id": ids[own], "stop": pa.array(ids[stop], pa.int64(), mask=~on), "back": pa.array(ids[back], pa.int64(), mask=~off), "ahead": ~on & (not end), "behind": ~off & (not begin)})

    return written(rows.groupBy("group_id", "at").applyInArrow(seek, "group_id long, id long, stop long, back long, ahead boolean, behind boolean"), "stops")


def _listed_by_tables(rects: DataFrame) -> DataFrame:
    """neighbour_constraints for groups of any size.

    In the order of centres each is held against the next CHUNK. Who finds its nearest there has all its
    neighbours there. In a pair farther apart both are without a nearest on that side; if such
    are few, they are held against their whole groups.
    """
    r = rects.select(F.col("group_id").cast("long").alias("group_id"), F.col("rect_id").cast("long").alias("id"), low(Y).alias("lo"), high(Y).alias("hi"), _middle(X).alias("c"), extent(X).alias("size"), low(X).alias("x0"), high(X).alias("x1"))
    ranges = counts_before(dealt(r, "group_id", "c", "id"), ["group_id"], ["c", "id"], F.lit(1))
    ranges = ranges.join(r.groupBy("group_id").agg(F.count("*").alias("n")), "group_id")
    chunk, run = CHUNK, CHUNK * RUN
    at, halo = F.floor(F.col("before") / run), (F.col("before") % run < chunk) & (F.col("before") >= run)
    rows = ranges.withColumn("own", at).withColumn("at", F.explode(F.when(halo, F.array(at, at - 1)).otherwise(F.array(at))))

    def lists(t: pa.Table) -> pa.Table:
        t = t.sort_by("before")
        lo, hi, x0, x1, size, ids, before = (t.column(c).to_numpy() for c in ("lo", "hi", "x0", "x1", "size", "id", "before"))
        own = int((t.column("own").to_numpy() == t.column("at").to_numpy()).sum())
        left, right, stop, back = nearest_apart(lo, hi, x0, x1, own, chunk)
        # Without one in sight, though there are more.
        ahead = np.flatnonzero((stop[:own] == len(ids)) & (before[:own] + chunk < t.column("n")[0].as_py() - 1))
        behind = np.flatnonzero((back < 0) & (before > chunk) & (np.arange(len(ids)) >= chunk))
        n, one, other = len(left), len(ahead), len(behind)
        at = lambda have, none_first, none_last: pa.array(np.r_[np.zeros(none_first, int), ids[have], np.zeros(none_last, int)], pa.int64(), mask=np.r_[np.ones(none_first, bool), np.zeros(len(have), bool), np.ones(none_last, bool)])
        return pa.table({"group_id": t.column("group_id").take(pa.array(np.zeros(n + one + other, int))), "left": at(np.r_[left, ahead], 0, other), "right": pa.concat_arrays([at(right, 0, one), at(behind, 0, 0)]), "gap": np.r_[(size[left] + size[right]) / 2, np.zeros(one + other)]})

    spark = r.sparkSession
    tasks = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    got = written(rows.repartition(tasks, "group_id", "at").groupBy("group_id", "at").applyInArrow(lists, "group_id long, left long, right long, gap double"), "lists")
    rules = got.filter("left IS NOT NULL AND right IS NOT NULL")
    asks = got.filter("left IS NULL OR right IS NULL")
    few = asks.count()
    if not few:
        return rules
    if few > FEW:
        groups = written(asks.select("group_id").distinct(), "asking")
        return rules.join(groups, "group_id", "left_anti").unionByName(_listed_by_trees(rects.join(groups, "group_id", "left_semi")))
    place = ranges.select("group_id", "id", "before", "n", "lo", "hi", "c", "size", "x0", "x1")
    names = [c for c in place.columns if c != "group_id"]
    side = lambda p, end, none: written(place.join(F.broadcast(asks.filter(f"{none} IS NULL").select("group_id", F.col(end).alias("id"))), ["group_id", "id"]).select("group_id", *[F.col(c).alias(f"{p}_{c}") for c in names]), "asks")
    a, b = side("a", "left", "right"), side("b", "right", "left")
    line = lambda p, q: (F.col(f"{p}lo") <= F.col(f"{q}hi")) & (F.col(f"{q}lo") <= F.col(f"{p}hi"))
    # The nearest that lies apart, by its rank.
    a = place.join(F.broadcast(a), "group_id").filter(line("a_", "") & (F.col("a_before") < F.col("before")) & (F.col("a_x1") <= F.col("x0"))).groupBy("group_id", "a_id").agg(F.min("before").alias("stop")).join(a, ["group_id", "a_id"], "right")
    b = place.join(F.broadcast(b), "group_id").filter(line("b_", "") & (F.col("before") < F.col("b_before")) & (F.col("x1") <= F.col("b_x0"))).groupBy("group_id", "b_id").agg(F.max("before").alias("back")).join(b, ["group_id", "b_id"], "right")
    met = a.join(b, "group_id").filter(line("a_", "b_") & (F.col("b_before") > F.col("a_before") + chunk) & (F.col("b_before") <= F.coalesce("stop", "a_n")) & (F.col("a_before") >= F.coalesce("back", F.lit(-1))))
    ox = F.greatest(F.lit(0.0), F.col("a_x1") - F.col("b_x0"))
    oy = F.greatest(F.lit(0.0), F.when(F.col("a_lo") + F.col("a_hi") <= F.col("b_lo") + F.col("b_hi"), F.col("a_hi") - F.col("b_lo")).otherwise(F.col("b_hi") - F.col("a_lo")))
    met = met.filter((ox <= 0) | (ox <= oy)).select("group_id", F.col("a_id").alias("left"), F.col("b_id").alias("right"), ((F.col("a_size") + F.col("b_size")) / 2).alias("gap"))
    return rules.unionByName(met)


def nearest_apart(lo: np.ndarray, hi: np.ndarray, x0: np.ndarray, x1: np.ndarray, own: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rectangles of one group in the order of their centres, the pairs (places of left and right ends) of neighbour_constraints whose left end is among the first own; and of each the next that shares a part of the y axis and lies apart in x (their number if none does), and the last before it (-1). Only those at most reach places away are seen. Most find theirs nearby, so the others are looked at again by themselves."""
    m, step, wide = len(lo), 128, min(192, reach)
    stop, back, at = np.full(m, m), np.full(m, -1), np.arange(m)
    left, right = [], []

    def seen(rows: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the places to (a row of them for each of rows, or one for all; m and more: none) share a part of the y axis with rows, and which of those lie apart after them."""
        known = (to > rows[:, None]) & (to <= rows[:, None] + reach) & (to < m)
        t = np.minimum(to, m - 1)
        line = known & (lo[rows, None] <= hi[t]) & (lo[t] <= hi[rows, None])
        return line, line & (x1[rows, None] <= x0[t])

    def decide(rows: np.ndarray, to: np.ndarray, line: np.ndarray, apart: np.ndarray) -> None:
        first = apart.argmax(1)
        end = np.where(apart.any(1), to[first] if to.ndim == 1 else to[np.arange(len(rows)), first], m)
        stop[rows] = end
        i, k = np.nonzero(line & ~apart)
        b = to[k] if to.ndim == 1 else to[i, k]
        keep = b < end[i]
        left.append(rows[i[keep]])
        right.append(b[keep])

    for i in range(0, m, step):
        rows, to = at[i : i + step], at[i : i + step + wide]
        line, apart = seen(rows, to)
        has = apart.any(0)
        back[to[has]] = rows[-1] - apart[::-1].argmax(0)[has]
        found = apart.any(1)
        if not found.all():
            rows, line, apart = rows[found], line[found], apart[found]
        if len(rows):
            decide(rows, to, line, apart)
    far = np.arange(1, reach + 1)
    rest = np.flatnonzero(stop[:own] == m)
    for i in range(0, len(rest), step):
        rows = rest[i : i + step]
        to = rows[:, None] + far
        decide(rows, to, *seen(rows, to))
    rest = np.flatnonzero(back < 0)
    for i in range(0, len(rest), step):
        rows = rest[i : i + step]
        to = rows[:, None] - far
        t = np.maximum(to, 0)
        apart = (to >= 0) & (lo[rows, None] <= hi[t]) & (lo[t] <= hi[rows, None]) & (x1[t] <= x0[rows, None])
        back[rows] = np.where(apart.any(1), rows - 1 - apart.argmax(1), -1)
    a, b = (np.concatenate(p) if p else np.zeros(0, int) for p in (left, right))
    oy = np.where(lo[a] + hi[a] <= lo[b] + hi[b], hi[a] - lo[b], hi[b] - lo[a])
    near = (a < own) & (a >= back[b]) & (x1[a] - x0[b] <= np.maximum(0.0, oy))
    one = np.flatnonzero(stop[:own] < m)
    one = one[back[stop[one]] == one]
    return np.r_[a[near], one], np.r_[b[near], stop[one]], stop, back


def _listed_by_trees(rects: DataFrame) -> DataFrame:
    """neighbour_constraints for groups of any size and overlap.

    Rectangles are sized in powers of two. Within reach, the sum of a rectangle's half width and
    that of a size, rectangles of that size meet it on a grid; beyond it all are apart, and the
    nearest is found as in a sweep. So the pairs that meet are those that overlap, or nearly do. All
    this is asked only for those whose nearest is not among the next CHUNK rectangles.
    """
    r = rects.select("group_id", F.col("rect_id").alias("id"), low(Y).alias("lo"), high(Y).alias("hi"), _middle(X).alias("c"), extent(X).alias("size"), low(X).alias("x0"), high(X).alias("x1"))
    r = r.withColumn("class", F.when(F.col("size") > 0, F.ceil(F.log2("size"))).otherwise(F.lit(-1074)).cast("int"))
    r = written(on_ranks(r, ["group_id"]), "lines")
    classes = r.select("group_id", F.col("class").alias("of")).distinct()
    stops = _next_apart(r.select("group_id", "id", "lo", "hi", "c", "x0", "x1"))
    found = stops.select("group_id", F.col("id").alias("left"), F.col("stop").alias("right")).unionByName(stops.select("group_id", F.col("back").alias("left"), F.col("id").alias("right"))).filter("left IS NOT NULL AND right IS NOT NULL")
    open_ = stops.filter("ahead OR behind").select("group_id", "id", "ahead", "behind")
    asks = r.join(open_, ["group_id", "id"]).join(classes, "group_id").withColumn("reach", (F.col("size") + F.pow(F.lit(2.0), F.col("of"))) / 2)
    # Beyond reach: those whose line holds a rectangle's low end, and those whose low end its line holds.
    far = found
    keys = ["group_id", "of"]
    asks = written(asks, "asks")
    value = F.struct("c", F.col("id").alias("o"))
    for sign in () if asks.isEmpty() else (1, -1):
        asked = asks.filter("ahead" if sign > 0 else "behind")
        place = (F.col("c") + sign * F.col("reach")).alias("c")
        # Without a reach, equal centres go by their ids.
        o = F.when(F.col("reach") > 0, F.lit(-(2**63) if sign > 0 else 2**63 - 1)).otherwise(F.col("id")).alias("o")
        held = nearest_stabbed(r.select("group_id", F.col("class").alias("of"), (F.col("t0") + 1).alias("first"), (F.col("t1") + 1).alias("end"), "c", F.col("id").alias("o"), value.alias("value")), asked.select(*keys, "id", F.col("t0").alias("at"), place, o), keys)
        holds = nearest_within(r.select("group_id", F.col("class").alias("of"), F.col("t0").alias("at"), "c", F.col("id").alias("o"), value.alias("value")), asked.select(*keys, "id", (F.col("t0") + 1).alias("first"), (F.col("t1") + 1).alias("end"), place, o), keys)
        both = held.unionByName(holds).groupBy("group_id", "id").agg((F.min("over") if sign > 0 else F.max("under")).alias("stop")).filter("stop IS NOT NULL")
        one = both.select("group_id", *([F.col("id").alias("left"), F.col("stop.o").alias("right")] if sign > 0 else [F.col("stop.o").alias("left"), F.col("id").alias("right")]))
        far = far.unionByName(one)
    # Those that overlap, and within reach: boxes from the centre as far as the reach, against centres.
    boxes = r.select("group_id", "id", F.col("x0").alias("lo_x"), F.col("x1").alias("hi_x"), F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"), "c")
    over = meeting_boxes(boxes, boxes, ("c",)).filter("a_id <> b_id")
    mine = asks.select(F.struct("group_id", "of").alias("group_id"), "id", (F.col("c") - F.col("reach")).alias("lo_x"), (F.col("c") + F.col("reach")).alias("hi_x"), F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"), "c")
    theirs = r.select(F.struct("group_id", F.col("class").alias("of")).alias("group_id"), "id", F.col("c").alias("lo_x"), F.col("c").alias("hi_x"), F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"), "c")
    met = meeting_boxes(mine, theirs, ("c",)).filter("a_id <> b_id")
    ahead = F.expr("a_c < b_c OR (a_c = b_c AND a_id < b_id)")
    met = over.unionByName(met.withColumn("group_id", F.col("group_id.group_id")))
    near = met.select("group_id", F.when(ahead, F.col("a_id")).otherwise(F.col("b_id")).alias("left"), F.when(ahead, F.col("b_id")).otherwise(F.col("a_id")).alias("right"))
    own = lambda end: r.select("group_id", F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("c", "size", "x0", "x1", "lo", "hi")])
    pairs = far.unionByName(near).distinct().join(own("left"), ["group_id", "left"]).join(own("right"), ["group_id", "right"])
    ox = F.greatest(F.lit(0.0), F.col("left_x1") - F.col("right_x0"))
    mid = lambda e: F.col(f"{e}_lo") + F.col(f"{e}_hi")
    oy = F.greatest(F.lit(0.0), F.when(mid("left") <= mid("right"), F.col("left_hi") - F.col("right_lo")).otherwise(F.col("right_hi") - F.col("left_lo")))
    met = pairs.select("group_id", "left", "right", F.col("right_c").alias("c_right"), F.col("left_c").alias("c_left"), ((F.col("left_size") + F.col("right_size")) / 2).alias("gap"), ox.alias("ox"), oy.alias("oy"))
    # Of those apart in x the nearest counts, seen from either end; nearer ones count by their overlaps.
    apart = F.col("ox") <= 0
    met = written(met, "near")
    stop = met.filter(apart).groupBy("group_id", "left").agg(F.min(F.struct("c_right", "right")).alias("stop"))
    back = met.filter(apart).groupBy("group_id", "right").agg(F.max(F.struct("c_left", "left")).alias("back"))
    met = met.join(stop, ["group_id", "left"], "left").join(back, ["group_id", "right"], "left")
    ahead = F.col("stop").isNull() | (F.struct("c_right", "right") <= F.col("stop"))
    behind = F.col("back").isNull() | (F.struct("c_left", "left") >= F.col("back"))
    return met.filter((apart | (F.col("ox") <= F.col("oy"))) & ahead & behind).select("group_id", "left", "right", "gap")


def sweep(lo: np.ndarray, hi: np.ndarray, c: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The constraints of sweep_constraints for one group in memory."""
    n = len(c)
    if n < 2:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    order = np.lexsort((np.arange(n), c))
    place = np.empty(n, int)
    place[order] = np.arange(n)
    later = np.empty(n, int)
    later[np.lexsort((np.arange(n), hi))] = np.arange(n)
    left, right = [], []
    for v in range(n):
        at = place[(lo <= hi[v]) & (later > later[v])]
        under, over = at[at < place[v]], at[at > place[v]]
        if len(under):
            left.append(order[under.max()])
            right.append(v)
        if len(over):
            left.append(v)
            right.append(order[over.min()])
    left, right = np.array(left, int), np.array(right, int)
    return left, right, (size[left] + size[right]) / 2


def listed(box: np.ndarray, c: np.ndarray, size: np.ndarray, other: np.ndarray, borders: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The constraints of neighbour_constraints for one group in memory; other: centres on the y axis. borders: overlaps are told by the borders in box, else by c, size and other."""
    n = len(c)
    rank = np.empty(n, int)
    rank[np.lexsort((np.arange(n), c))] = np.arange(n)
    open_ = (box[:, None, 2] <= box[None, :, 3]) & (box[None, :, 2] <= box[:, None, 3])
    ahead = open_ & (rank[:, None] < rank[None, :])
    if borders:
        ox = np.maximum(0.0, box[:, None, 1] - box[None, :, 0])
        oy = np.maximum(0.0, np.where(other[:, None] <= other[None, :], box[:, None, 3] - box[None, :, 2], box[None, :, 3] - box[:, None, 2]))
    else:
        half, high_y = size / 2, (box[:, 3] - box[:, 2]) / 2
        ox = np.maximum(0.0, half[:, None] + half[None, :] - (c[None, :] - c[:, None]))
        oy = np.maximum(0.0, high_y[:, None] + high_y[None, :] - np.abs(other[None, :] - other[:, None]))
    apart = ahead & (ox <= 0)
    stop = np.where(apart, rank[None, :], n).min(1)
    stop_back = np.where(apart, rank[:, None], -1).max(0)
    left, right = np.nonzero(ahead & ((ox <= 0) | (ox <= oy)) & (rank[None, :] <= stop[:, None]) & (rank[:, None] >= stop_back[None, :]))
    return left, right, (size[left] + size[right]) / 2


def separated(box: np.ndarray, weight: np.ndarray, extra: float = EXTRA_GAP, third_pass: bool = True) -> np.ndarray:
    """Boxes (min_x, max_x, min_y, max_y in columns) after a pass over x, which parts what overlaps less there than in y, and one over y, which parts every overlap that is left. The third pass takes x anew from where it began, for the final y, so that no rectangle stays where only the first pass needed it."""
    start, box = box, box.copy()
    mid = lambda b, axis: (b[:, 2 * axis] + b[:, 2 * axis + 1]) / 2

    def along(axis: int, desired: np.ndarray, rules: tuple) -> None:
        x = solve_forward(desired, weight, *rules)
        half = (start[:, 2 * axis + 1] - start[:, 2 * axis]) / 2
        box[:, 2 * axis], box[:, 2 * axis + 1] = x - half, x + half

    width, height = start[:, 1] - start[:, 0] + extra, start[:, 3] - start[:, 2] + extra
    along(0, mid(start, 0), listed(box, mid(box, 0), width, mid(box, 1)))
    along(1, mid(start, 1), sweep(box[:, 0], box[:, 1], mid(box, 1), height))
    if third_pass:
        along(0, mid(start, 0), sweep(box[:, 2], box[:, 3], mid(box, 0), width))
    return box


def _sides(dim: int) -> tuple[str, str]:
    return ("min_x", "max_x") if dim == X else ("min_y", "max_y")


def in_line(rects: DataFrame, dim: int, near: bool) -> DataFrame:
    """group_id of the groups all of whose rectangles cross one line along the axis. near: a band as broad as the largest of them is long, so that no two overlap more on the axis than across it."""
    lo, hi = _sides(Y if dim == X else X)
    band = rects.groupBy("group_id").agg(F.min(hi).alias("top"), F.max(lo).alias("low"), F.max(extent(dim)).alias("long"))
    return written(band.filter((F.col("top") - F.col("low") > F.col("long") * (1 + 1e-9)) if near else (F.col("top") >= F.col("low"))).select("group_id"), "lines")


def side_by_side(rects: DataFrame, start: DataFrame, dim: int) -> DataFrame:
    """group_id, rect_id, position on the axis of rectangles of groups in line, where each is kept apart from the next one only: between others the gaps in between are as large as theirs. start has the positions to be near to."""
    lo, hi = _sides(dim)
    wish = start.select("group_id", "rect_id", ((F.col(lo) + F.col(hi)) / 2).alias("wish"), "weight")
    # Without borders, whose rounding would part equal centres.
    r = rects.select("group_id", "rect_id", ((F.col(lo) + F.col(hi)) / 2).alias("c"), extent(dim).alias("size")).join(wish, ["group_id", "rect_id"])
    keys, order = ["group_id"], ["c", "rect_id"]
    ranges = dealt(r, "group_id", *order)
    r = counts_before(ranges, keys, order, F.lit(1)).withColumnRenamed("before", "place")
    r = written(sums_before(r, keys, order, F.col("size")).withColumn("offset", F.col("before") + F.col("size") / 2), "places")
    v = r.select(F.col("group_id").alias("problem_id"), F.col("place").alias("var_id"), (F.col("wish") - F.col("offset")).alias("desired"), "weight")
    at = chain_projection(v, 0.0).select(F.col("problem_id").alias("group_id"), F.col("var_id").alias("place"), "position")
    return r.join(at, ["group_id", "place"]).select("group_id", "rect_id", (F.col("position") + F.col("offset")).alias("position"))


def along_axis(rects: DataFrame, start: DataFrame, dim: int, extra: float, near: bool) -> DataFrame:
    """rects with their positions on an axis as near to those of start as neighbour_constraints (near) or sweep_constraints allow, for rectangles grown by extra on the axis. Those of a part (a column of start) are solved together first, then those that push each other (project_forward). Groups in line are chains."""
    lo, hi = _sides(dim)
    wide = rects.withColumns({"x_border": F.lit(extra / 2 if dim == X else 0.0), "y_border": F.lit(extra / 2 if dim == Y else 0.0)})
    lines = in_line(wide, dim, near)
    chained = None if lines.isEmpty() else side_by_side(wide.join(lines, "group_id", "left_semi"), start, dim)
    rest = wide.join(lines, "group_id", "left_anti")
    if rest.isEmpty():
        at = chained
    else:
        rules = neighbour_constraints(rest) if near else sweep_constraints(rest, dim)
        v = start.join(lines, "group_id", "left_anti").select(F.col("group_id").alias("problem_id"), F.col("rect_id").alias("var_id"), ((F.col(lo) + F.col(hi)) / 2).alias("desired"), "weight", "part")
        at = project_forward(v, rules.withColumnRenamed("group_id", "problem_id")).select(F.col("problem_id").alias("group_id"), F.col("var_id").alias("rect_id"), "position")
        at = at if chained is None else at.unionByName(chained)
    if at is None:  # no rectangles
        return rects
    here = start.select("group_id", "rect_id", ((F.col(lo) + F.col(hi)) / 2).alias("wish"), ((F.col(hi) - F.col(lo)) / 2).alias("half")).join(at, ["group_id", "rect_id"], "left")
    here = here.select("group_id", "rect_id", F.coalesce("position", "wish").alias("x"), "half")
    return written(rects.join(here, ["group_id", "rect_id"]).withColumns({lo: F.col("x") - F.col("half"), hi: F.col("x") + F.col("half")}).select(*rects.columns), "moved")


def in_parts(rects: DataFrame) -> DataFrame:
    """rects as a written table with part, a number that about PLACED rectangles near each other share: they are dealt in the order of cells, four to a part, as many mean widths wide as they are mean heights high."""
    span = lambda lo, hi: F.max(hi) - F.min(lo)
    mean = lambda lo, hi: F.greatest(F.avg(F.col(hi) - F.col(lo)), span(lo, hi) / 1e9, F.lit(1e-300))
    g = rects.groupBy("group_id").agg(F.count("*").alias("n"), F.min("min_x").alias("x"), F.min("min_y").alias("y"), mean("min_x", "max_x").alias("w"), mean("min_y", "max_y").alias("h"), span("min_x", "max_x").alias("sx"), span("min_y", "max_y").alias("sy"))
    # In mean widths and heights; a strip has no cells across.
    g = g.select("group_id", "n", "x", "y", "w", "h", F.greatest(F.lit(1.0), F.col("sx") / F.col("w")).alias("u"), F.greatest(F.lit(1.0), F.col("sy") / F.col("h")).alias("v"))
    cell = F.col("u") * F.col("v") * (PLACED / 4) / F.col("n")
    side = F.sqrt(cell)
    tall = F.when(F.col("v") <= 4 * side, 2 * F.col("v")).when(F.col("u") <= 4 * side, cell / F.col("u")).otherwise(side)
    wide = F.when(F.col("v") <= 4 * side, cell / F.col("v")).when(F.col("u") <= 4 * side, 2 * F.col("u")).otherwise(side)
    g = g.select("group_id", "x", "y", (F.col("v") <= 4 * side).alias("flat"), (F.col("w") * wide).alias("wide"), (F.col("h") * tall).alias("tall"))
    placed = rects.join(g, "group_id").withColumns({"cell_x": F.floor((F.col("min_x") - F.col("x")) / F.col("wide")), "cell_y": F.floor((F.col("min_y") - F.col("y")) / F.col("tall"))})
    placed = placed.withColumn("across", F.when(F.col("flat"), F.col("min_x")).otherwise(F.col("min_y")))
    return dealt(placed.select(*rects.columns, "cell_x", "cell_y", "across"), "group_id", "cell_x", "cell_y", "across", "rect_id", rows=PLACED).select(*rects.columns, F.col("part").cast("long").alias("part"))


def separated_by_passes(rects: DataFrame, extra: float = EXTRA_GAP, third_pass: bool = True) -> DataFrame:
    """The rows of rects (group_id, rect_id, min_x, max_x, min_y, max_y, weight) moved as separated moves them, for groups of any size: a pass is a sweep and a projection of its constraints, in parts of about PLACED rectangles that lie near each other."""
    start = in_parts(rects)
    rects = start.drop("part")
    box = along_axis(rects, start, X, extra, near=True)
    box = along_axis(box, start, Y, extra, near=False)
    return along_axis(box, start, X, extra, near=False) if third_pass else box


def remove_overlaps(rects: DataFrame, fixed: DataFrame | None = None, third_pass: bool = True, small: int = SMALL) -> DataFrame:
    """Rectangles of each group moved apart, sizes kept, fixed ones (group_id, rect_id) hardly moved. Groups of at most small rectangles are solved whole, each in a task; larger ones by passes over tables (separated_by_passes), with the same result."""
    f = F.lit(False) if fixed is None else F.coalesce("fixed", F.lit(False))
    r = rects if fixed is None else rects.join(fixed.select("group_id", "rect_id", F.lit(True).alias("fixed")), ["group_id", "rect_id"], "left")
    r = r.select(F.col("group_id").cast("long").alias("group_id"), F.col("rect_id").cast("long").alias("rect_id"), low(X).alias("min_x"), high(X).alias("max_x"), low(Y).alias("min_y"), high(Y).alias("max_y"), F.when(f, FIXED_WEIGHT).otherwise(1.0).alias("weight"))

    def apart(t: pa.Table) -> pa.Table:
        t = t.sort_by([("group_id", "ascending"), ("rect_id", "ascending")])
        box, weight = np.stack([t.column(c).to_numpy() for c in SIDES], 1), t.column("weight").to_numpy()
        ends = [*np.flatnonzero(np.diff(t.column("group_id").to_numpy())) + 1, t.num_rows]
        for i, j in zip([0, *ends], ends):
            if j - i > 1:
                box[i:j] = separated(box[i:j], weight[i:j], third_pass=third_pass)
        return pa.table({"group_id": t.column("group_id"), "rect_id": t.column("rect_id"), **{c: box[:, i] for i, c in enumerate(SIDES)}})

    many = written(r.groupBy("group_id").agg(F.count("*").alias("n")).filter(F.col("n") > small).select("group_id"), "large")
    # Many small groups at a time.
    batches = max(8, r.count() // BATCH)
    whole = r.join(many, "group_id", "left_anti").groupBy(F.pmod(F.xxhash64("group_id"), F.lit(batches)).alias("batch")).applyInArrow(apart, "group_id long, rect_id long, min_x double, max_x double, min_y double, max_y double")
    if many.isEmpty():
        return whole
    return whole.unionByName(separated_by_passes(r.join(many, "group_id", "left_semi"), third_pass=third_pass).drop("weight"))


def separate_components(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """graph_id, node_id, x, y: components of a graph moved as wholes until their bounding boxes are apart."""
    n = nodes.join(labels.select("graph_id", "node_id", "component_id"), ["graph_id", "node_id"])
    box = n.groupBy(F.col("graph_id").alias("group_id"), F.col("component_id").alias("rect_id")).agg(F.min(F.col("x") - F.col("w") / 2).alias("min_x"), F.max(F.col("x") + F.col("w") / 2).alias("max_x"), F.min(F.col("y") - F.col("h") / 2).alias("min_y"), F.max(F.col("y") + F.col("h") / 2).alias("max_y"))
    box = box.withColumns({"x_border": F.lit(0.0), "y_border": F.lit(0.0)})
    moved = remove_overlaps(box).select(F.col("group_id").alias("graph_id"), F.col("rect_id").alias("component_id"), F.col("min_x").alias("to_x"), F.col("min_y").alias("to_y"))
    was = box.select(F.col("group_id").alias("graph_id"), F.col("rect_id").alias("component_id"), F.col("min_x").alias("was_x"), F.col("min_y").alias("was_y"))
    shift = moved.join(was, ["graph_id", "component_id"])
    return n.join(shift, ["graph_id", "component_id"]).select("graph_id", "node_id", "component_id", (F.col("x") + F.col("to_x") - F.col("was_x")).alias("x"), (F.col("y") + F.col("to_y") - F.col("was_y")).alias("y"), "w", "h")
