"""Shortest distances between all nodes of a graph, by min-plus products of square tiles.

The matrix of a graph is cut into tiles of side by side nodes, a row each. Round k closes the
tile k, k of every graph that has one, then the tiles in its row and column, then all others
through these. Tiles meet by joins on (graph, row tile, column tile), so one large graph is many
tasks and no task holds more than a few tiles. Tiles without a path do not exist.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import counts_before, dealt, forget, written
from .graph import PAIRS, both_ways, sanitised

#: Nodes on a side of a tile, bytes of tiles in a partition, cells of small tiles that a task closes at once (about).
SIDE, PART_BYTES, CELLS = 512, 1 << 27, 1 << 16
PLACE = ["graph_id", "i", "j"]
FACTS = [*PLACE, "high", "wide", "tiles"]
TILE = "graph_id long, i int, j int, high int, wide int, tiles int, d binary"


def through(left: np.ndarray, right: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """The least known[r, c] and left[r, t] + right[t, c] over t, of each tile of a stack."""
    out = np.full((*left.shape[:-1], right.shape[-1]), np.inf) if known is None else known.copy()
    for t in range(left.shape[-1]):
        np.minimum(out, left[..., t, None] + right[..., t, None, :], out=out)
    return out


def closed(d: np.ndarray) -> np.ndarray:
    """Distances within a tile of its own nodes, of each tile of a stack."""
    out = d.copy()
    for t in range(d.shape[-1]):
        np.minimum(out, out[..., :, t, None] + out[..., t, None, :], out=out)
    return out


def _stacks(b: pa.RecordBatch, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of b with tiles of the same sides (and alike in more), about CELLS cells at a time."""
    if not b.num_rows:
        return
    high, wide = (b.column(c).to_numpy() for c in ("high", "wide"))
    _, kind = np.unique(np.stack([high, wide, *more], 1), axis=0, return_inverse=True)
    order = np.argsort(kind, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
        many = max(1, CELLS // int(high[rows[0]] * wide[rows[0]]))
        for at in range(0, len(rows), many):
            yield b.take(pa.array(rows[at : at + many]))


def _stack(column: pa.Array, high: int) -> np.ndarray | None:
    """Tiles of the same sides as one array; nothing if they are not there."""
    return None if column.null_count else np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), high, -1)


def _made(tiles: Callable[[pa.RecordBatch, int, int], np.ndarray], alike: Callable[[pa.RecordBatch], list] = lambda b: []):
    """Rows with the columns FACTS and others become rows of TILE. tiles: the stack of some rows, of the sides and alike."""

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in _stacks(whole, *alike(whole)):
                d = np.ascontiguousarray(tiles(b, b.column("high")[0].as_py(), b.column("wide")[0].as_py()))
                ends = np.arange(len(d) + 1) * (d.nbytes // len(d))
                d = pa.Array.from_buffers(pa.binary(), len(d), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(d)])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in FACTS), d], [*FACTS, "d"])

    return make


def _filled(b: pa.RecordBatch, high: int, wide: int) -> np.ndarray:
    d = np.full((b.num_rows, high * wide), np.inf)
    of = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("cells")).to_numpy())
    d[of, b.column("cells").flatten().to_numpy()] = b.column("lengths").flatten().to_numpy()
    return d


def _closed(b: pa.RecordBatch, high: int, wide: int) -> np.ndarray:
    return closed(_stack(b.column("d"), high))


def _beside(k: int):
    """Tiles in row or column k through the closed tile k, k."""

    def tiles(b: pa.RecordBatch, high: int, wide: int) -> np.ndarray:
        own, row = _stack(b.column("d"), high), b.column("i")[0].as_py() == k
        pivot = _stack(b.column("pivot"), high if row else wide)
        return through(pivot, own) if row else through(own, pivot)

    return _made(tiles, lambda b: [b.column("i").to_numpy() == k])


def _elsewhere(b: pa.RecordBatch, high: int, wide: int) -> np.ndarray:
    known, left = _stack(b.column("d"), high), _stack(b.column("left"), high)
    return known if left is None else through(left, _stack(b.column("right"), left.shape[2]), known)


def _ways(b: pa.RecordBatch) -> list:
    """What tiles elsewhere differ in: whether they are known, and the side of the tile between (-1: no way)."""
    return [b.column("d").is_valid().to_numpy(zero_copy_only=False), pc.fill_null(pc.binary_length(b.column("left")), -1).to_numpy() // (8 * b.column("high").to_numpy())]


def _pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in it:
        for b in _stacks(whole):
            d = _stack(b.column("d"), b.column("high")[0].as_py())
            g, r, c = np.nonzero(np.isfinite(d))
            u, v = (b.column(ids).flatten().to_numpy().reshape(len(d), -1) for ids in ("from_ids", "to_ids"))
            yield pa.RecordBatch.from_arrays([pa.array(b.column("graph_id").to_numpy()[g]), pa.array(u[g, r]), pa.array(v[g, c]), pa.array(d[g, r, c])], ["graph_id", "u", "v", "d"])


def all_pairs_by_tiles(edges: DataFrame, nodes: DataFrame, side: int = SIDE) -> DataFrame:
    """graph_id, u, v, d as graph.all_pairs, for graphs of any size: of parallel edges the shortest counts, and pairs without a path have no row. A graph of n nodes takes n / side rounds; graphs go side by side, each until its own last tile."""
    spark = nodes.sparkSession
    ids = nodes.select("graph_id", "node_id").distinct()
    place = counts_before(dealt(ids, "graph_id", "node_id"), ["graph_id"], ["node_id"], F.lit(True))
    place = written(place.select("graph_id", "node_id", F.floor(F.col("before") / side).cast("int").alias("t"), (F.col("before") % side).cast("int").alias("nth")), "places")
    sized = place.groupBy("graph_id").agg(F.count("*").alias("n")).withColumn("tiles", F.ceil(F.col("n") / side).cast("int"))
    # How many graphs have how many tiles: a row for each size, which is at most the nodes of the largest graph by side.
    sizes = {r.tiles: r.graphs for r in sized.groupBy("tiles").agg(F.count("*").alias("graphs")).collect()}
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def meeting(df: DataFrame, k: int) -> DataFrame:
        """Dealt by tile to as many partitions as the tiles of round k need."""
        return df.repartition(max(least, sum(g * t * t for t, g in sizes.items() if t > k) * side * side * 8 // PART_BYTES), *PLACE)

    arcs = both_ways(sanitised(edges, nodes)).select("graph_id", "src", "dst", "length").unionByName(ids.select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(0.0).alias("length")))
    arcs = arcs.groupBy("graph_id", "src", "dst").agg(F.min("length").alias("length"))
    end = lambda name, t, nth: place.select("graph_id", F.col("node_id").alias(name), F.col("t").alias(t), F.col("nth").alias(nth))
    cells = arcs.join(end("src", "i", "r"), ["graph_id", "src"]).join(end("dst", "j", "c"), ["graph_id", "dst"]).join(sized, "graph_id")
    long = lambda t: F.least(F.lit(side), F.col("n") - F.col(t) * side).cast("int")
    cells = cells.withColumn("high", long("i")).withColumn("wide", long("j")).groupBy(*FACTS).agg(F.collect_list(F.struct((F.col("r") * F.col("wide") + F.col("c")).alias("cell"), "length")).alias("filled"))
    now = written(cells.select(*FACTS, F.col("filled.cell").alias("cells"), F.col("filled.length").alias("lengths")).mapInArrow(_made(_filled), TILE), "tiles")
    done: list[DataFrame] = []
    for k in range(max(sizes, default=0)):
        live = now.filter(F.col("tiles") > k)
        at = (F.col("i") == k).cast("int") + (F.col("j") == k).cast("int")
        pivot = written(live.filter(at == 2).mapInArrow(_made(_closed), TILE), "pivots")
        others = f"filter(sequence(0, tiles - 1), t -> t <> {k})"
        told = pivot.select("graph_id", F.col("d").alias("pivot"), F.explode(F.expr(f"flatten(transform({others}, t -> array(struct({k} AS i, t AS j), struct(t AS i, {k} AS j))))")).alias("to")).select("graph_id", "to.i", "to.j", "pivot")
        lines = meeting(live.filter(at == 1), k).join(meeting(told, k), PLACE).select(*FACTS, "d", "pivot")
        lines = written(lines.mapInArrow(_beside(k), TILE), "lines")
        left = lines.filter(F.col("j") == k).select("graph_id", "i", F.explode(F.expr(others)).alias("j"), "tiles", "high", F.col("d").alias("left"))
        right = lines.filter(F.col("i") == k).select("graph_id", F.explode(F.expr(others)).alias("i"), "j", "wide", F.col("d").alias("right"))
        way = meeting(left, k).join(meeting(right, k), PLACE).select(*PLACE, *[F.col(c).alias(f"way_{c}") for c in FACTS[3:]], "left", "right")
        rest = meeting(live.filter(at == 0), k).join(way, PLACE, "full").select(*PLACE, *[F.coalesce(c, f"way_{c}").alias(c) for c in FACTS[3:]], "d", "left", "right")
        rest = rest.mapInArrow(_made(_elsewhere, _ways), TILE)
        now = written(pivot.unionByName(lines).unionByName(rest), "tiles", instead_of=None if k in sizes else now)
        forget(pivot)
        forget(lines)
        if k + 1 in sizes:
            done.append(now.filter(F.col("tiles") == k + 1))
    out = now if not done else done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    names = place.groupBy("graph_id", "t").agg(F.array_sort(F.collect_list("node_id")).alias("ids"))
    of = lambda t, name: names.select("graph_id", F.col("t").alias(t), F.col("ids").alias(name))
    out = out.join(of("i", "from_ids"), ["graph_id", "i"]).join(of("j", "to_ids"), ["graph_id", "j"])
    return out.select("graph_id", "high", "wide", "d", "from_ids", "to_ids").mapInArrow(_pairs, PAIRS)
