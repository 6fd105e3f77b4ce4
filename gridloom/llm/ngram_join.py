"""N-gram Jaccard self-join by a MinHash LSH forest.

Equal word sequences form a text class, whose first row stands for it. Each representative's
MinHash signature is dealt to several trees; in a tree, signatures sort into a prefix trie. A
sorted pass links a signature to the node with which it shares its longest prefix and
shortens prefixes down to the depth at which the trees together reach the target recall.
Links are verified exactly on shingle sets. A second round tests the pairs within a node that
the verified links left in different components, so that no component is lost inside a node.
Last, the texts of each component are compared in blocks, which gives every text its exact
number of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowkit import TO_LOWER, WordHashes, batches, binary_list, hash_words, shingle_hashes
from .common import id_of, key_of, written

WIDTH, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 8, 0.999
#: Members of a node in a block of the second round.
NODE_BLOCK = 200
#: Texts and shingles in a block of a component.
BLOCK_TEXTS, BLOCK_SHINGLES = 2000, 1 << 20
#: A shingle is rare if so many times the pairs that hold it are fewer than all pairs of a task; columns and pairs handled at once.
RARE, COLUMNS, PAIRS_AT_ONCE = 128, 2048, 1 << 21
SIGNED = "row long, key long, h long, text_class binary, signature array<int>"


def least_depth(threshold: float, trees: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold shares a node of some tree with probability recall."""
    d = 1
    while 1 - (1 - threshold ** (d + 1)) ** trees >= recall:
        d += 1
    return d


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_LOWER).split()


def signatures(shingles: list[np.ndarray], n: int) -> np.ndarray:
    """(texts, n) MinHash values of 32 bits; a text without shingles has zeros."""
    rng = np.random.default_rng(3)
    mul, add = rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, dtype=np.uint64)
    out = np.zeros((len(shingles), n), np.uint32)
    some = [i for i, s in enumerate(shingles) if len(s)]
    at = 0
    while at < len(some):
        end, size = at, 0
        while end < len(some) and (end == at or size + len(shingles[some[end]]) <= 60_000):
            size += len(shingles[some[end]])
            end += 1
        part = [shingles[i] for i in some[at:end]]
        flat = np.concatenate(part)
        start = np.cumsum([0, *map(len, part[:-1])])
        for j in range(n):
            # The upper half of the product mixes all bits of the shingle's hash.
            out[some[at:end], j] = np.minimum.reduceat(((flat * mul[j] + add[j]) >> np.uint64(32)).astype(np.uint32), start)
        at = end
    return out


def _signed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for whole in it:
        for part in range(0, whole.num_rows, 500):
            b = whole.slice(part, 500)
            words = [words_of(t) for t in binary_list(b.column("text"))]
            sig = signatures([shingle_hashes(hash_words(w, memo), WIDTH) for w in words], TREES * DEPTH)
            same = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
            offsets = pa.array(np.arange(len(words) + 1) * sig.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "key", "h")), pa.array(same, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(sig.ravel().view(np.int32)))], ["row", "key", "h", "text_class", "signature"])


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for b in it:
        sets = [np.unique(shingle_hashes(hash_words(words_of(t), memo), WIDTH)).view(np.int64) for t in binary_list(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(sets, pa.list_(pa.int64()))], ["row", "shingles"])


def _spanning(least: int):
    """Links of a sorted run of (node, rest, row): each row to the first row of the deepest node that it shares with the row before. The state is one row a depth, however large a node is. A partition also tells how it begins and ends (link = False), as a node may go on in the next."""

    def span(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("link", pa.bool_()), ("part", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("node", pa.int64()), ("last_node", pa.int64())])

        def rows():
            lead: list[int] = []
            node, rest, first, part = None, (), None, 0
            for b in it:
                cols = [b.column(i).to_pylist() for i in range(4)]
                for p, n, r, row in zip(*cols, strict=True):
                    if n != node:
                        if first is None:
                            first, part = (n, row), p
                        node, lead = n, [row] * (len(r) + 1)
                    else:
                        d = 0
                        while d < len(r) and r[d] == rest[d]:
                            d += 1
                        if lead[d] != row:
                            yield True, p, lead[d], row, None, None
                        for k in range(d + 1, len(r) + 1):
                            lead[k] = row
                    rest = r
            if first is not None:
                yield False, part, first[1], lead[0], first[0], node

        yield from batches(rows(), schema)

    return span


def shared_counts(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """How many shingles each set of a shares with each of b (with each other of a, if b is None). Frequent shingles are columns of a matrix product, rare ones are paired off."""
    left, right = len(a), len(a if b is None else b)
    both = a if b is None else a + b
    member = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, word = np.unique(np.concatenate(both), return_inverse=True)
    order = np.argsort(word, kind="stable")
    member, word = member[order], word[order]
    n_words = int(word[-1]) + 1 if len(word) else 0
    if b is None:
        mem_a, word_a, mem_b, word_b = member, word, member, word
    else:
        own = member < left
        mem_a, word_a, mem_b, word_b = member[own], word[own], member[~own] - left, word[~own]
    in_a, in_b = np.bincount(word_a, minlength=n_words), np.bincount(word_b, minlength=n_words)
    rare = in_a * in_b * RARE < left * right
    shared = np.zeros((left, right), np.float32)
    # Frequent shingles.
    place = np.cumsum(~rare) - 1
    keep_a, keep_b = ~rare[word_a], ~rare[word_b]
    row_a, col_a, row_b, col_b = mem_a[keep_a], place[word_a[keep_a]], mem_b[keep_b], place[word_b[keep_b]]
    for low in range(0, int((~rare).sum()), COLUMNS):
        held = []
        for n, r, c in ((left, row_a, col_a), (right, row_b, col_b)):
            i, j = np.searchsorted(c, (low, low + COLUMNS))
            m = np.zeros((n, COLUMNS), np.float32)
            m[r[i:j], c[i:j] - low] = 1
            held.append(m)
        shared += held[0] @ held[1].T
    # Rare shingles.
    start_a, start_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    pairs = np.flatnonzero(rare & (in_a * in_b > 0))
    ends = np.cumsum((in_a * in_b)[pairs])
    at = 0
    while at < len(pairs):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        w = pairs[at:end]
        times = (in_a * in_b)[w]
        k = np.repeat(w, times)
        nth = np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)
        cell = mem_a[start_a[k] + nth // in_b[k]] * right + mem_b[start_b[k] + nth % in_b[k]]
        shared += np.bincount(cell, minlength=left * right).reshape(left, right).astype(np.float32)
        at = end
    return shared


def are_close(shared: np.ndarray, a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - shared
    return shared >= threshold * union - 1e-6


def _sets_of(t: pa.Table) -> list[np.ndarray]:
    return [np.asarray(x, np.int64) for x in t.column("shingles").to_pylist()]


def _counting(threshold: float):
    """Of a pair of blocks of a component (side 1 is empty where a block meets itself): how many links each text has."""

    def count(t: pa.Table) -> pa.Table:
        rep, side, sets = t.column("rep").to_numpy(), t.column("side").to_numpy(), _sets_of(t)
        a, b = [sets[i] for i in np.flatnonzero(side == 0)], [sets[i] for i in np.flatnonzero(side == 1)]
        if b:
            close = are_close(shared_counts(a, b), a, b, threshold) if a else np.zeros((0, len(b)), bool)
            n = np.concatenate([close.sum(1), close.sum(0)])
        else:
            n = are_close(shared_counts(a), a, a, threshold).sum(1) - 1
            if (t.column("low")[0].as_py(), t.column("i")[0].as_py()) != (t.column("high")[0].as_py(), t.column("j")[0].as_py()):
                n[:] = 0  # The other block has no member.
        order = np.concatenate([np.flatnonzero(side == 0), np.flatnonzero(side == 1)])
        return pa.table({"rep": pa.array(rep[order], pa.int64()), "n": pa.array(n, pa.int64())}).filter(pa.array(n > 0))

    return count


def link_counts(label: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(rep, degree): the exact number of texts of its component within the threshold of each text, for components of more than two texts (two have one link each).

    label has (node, component), sets has (row, shingles). A component that fits a block is one
    task. A larger one is cut by set size into classes, of which only neighbours can hold a pair
    within the threshold, and these into blocks; every two blocks that can hold one meet in one
    task, so that every pair is tested once.
    """
    size_class = F.floor(F.log("size") / F.lit(math.log(1 / threshold)) * 0.999)
    member = written(label.join(sets.select(F.col("row").alias("node"), F.size("shingles").alias("size")), "node").select(F.col("node").alias("rep"), "component", "size", size_class.alias("own_class")), "members-sized")
    classes = member.groupBy("component", "own_class").agg(F.count("*").alias("n"), F.sum("size").alias("load"))
    total = Window.partitionBy("component")
    near = total.orderBy("own_class")
    parts = F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("load") / BLOCK_SHINGLES)).cast("int")
    whole = (F.sum("n").over(total) <= BLOCK_TEXTS) & (F.sum("load").over(total) <= BLOCK_SHINGLES)
    classes = classes.withColumn("texts", F.sum("n").over(total)).withColumn("whole", whole).withColumn("parts", F.when(F.col("whole"), 1).otherwise(parts))
    beside = lambda f, by: F.when(~F.col("whole") & (f("own_class").over(near) == F.col("own_class") + by), f("parts").over(near)).otherwise(0)
    classes = classes.filter("texts > 2").select("component", "own_class", "whole", "parts", beside(F.lead, 1).alias("above"), beside(F.lag, -1).alias("below"))
    blocks = """flatten(array(
        transform(sequence(0, parts - 1), k -> struct(c AS low, least(own, k) AS i, c AS high, greatest(own, k) AS j, int(own > k) AS side)),
        IF(above > 0, transform(sequence(0, above - 1), k -> struct(c AS low, own AS i, c + 1 AS high, k AS j, 0 AS side)), array()),
        IF(below > 0, transform(sequence(0, below - 1), k -> struct(c - 1 AS low, k AS i, c AS high, own AS j, 1 AS side)), array())))"""
    placed = member.join(classes, ["component", "own_class"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("c", F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(F.col("own_class")))
    placed = written(placed.select("rep", "component", F.explode(F.expr(blocks)).alias("task")).select("rep", "component", "task.*"), "placed")
    met = placed.join(sets.withColumnRenamed("row", "rep"), "rep")
    counted = met.groupBy("component", "low", "i", "high", "j").applyInArrow(_counting(threshold), "rep long, n long")
    return written(counted.groupBy("rep").agg(F.sum("n").alias("degree")), "degrees")


def _joining(threshold: float):
    """Of two blocks of a node: links that join different components, a tree of them."""

    def join(t: pa.Table) -> pa.Table:
        rep, component, sets = t.column("rep").to_numpy(), t.column("component").to_numpy(), _sets_of(t)
        close = are_close(shared_counts(sets), sets, sets, threshold)
        root = {c: c for c in component.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for i, j in zip(*np.nonzero(np.triu(close & (component[:, None] != component[None, :]))), strict=True):
            p, q = find(int(component[i])), find(int(component[j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return join


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component of edges (a, b). Least labels spread to neighbours and jump to their own labels; a written table ends each round."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = written(step.join(jump, "component", "left").select("node", "was", F.least("component", "next").alias("component")), "labels")
        label = new.select("node", "component")
        if new.filter("component <> was").isEmpty():
            return label


def jaccard(x: Column, y: Column) -> Column:
    shared = F.size(F.array_intersect(x, y))
    return shared / (F.size(x) + F.size(y) - shared)


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Classes of near-duplicates: one row for each row of docs (doc_id, text; other columns are ignored).

    Columns: doc_id; class_id, the least doc_id of the documents that links of a Jaccard
    similarity of threshold or more connect; text_id, the least doc_id with the same words;
    n_copies, rows with the same words; n_links, the different texts within the threshold of its
    text plus its other copies. All pairs of a class are counted, none is written. Shingles are runs of five
    words (ASCII white space, A-Z lower-cased); a shorter text is one shingle; null, empty and
    wordless texts are copies of each other. A null doc_id is the least. Repeated rows are
    copies. Very long texts are taken whole. An empty table gives an empty result. docs is read
    several times; its rows may come in other partitions each time.
    """
    return joined(docs, threshold, recall).select(id_of().alias("doc_id"), id_of("class_key").alias("class_id"), id_of("text_key").alias("text_id"), "n_copies", "n_links")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with key and h, by which a row and its equals are known in every reading."""
    return docs.select(F.col("text").alias("text"), key_of().alias("key"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))


def joined(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, count: bool = True) -> DataFrame:
    """As ngram_join, by keys, with the hash of the text (h). Without count, n_links only tells if there are any (a tree of links spans a class)."""
    spark = docs.sparkSession
    least = least_depth(threshold, TREES, recall)
    rows = keyed(docs).select("key", "h", F.col("text").cast("string").alias("text"))
    # Rows are numbered once, in this written table; texts are met again by key and hash.
    signed = written(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_signed, SIGNED), "signatures")
    # The first row of each text class stands for it. Row numbers are those of the written table.
    classes = written(signed.groupBy("text_class").agg(F.min(F.struct("key", "row")).alias("least"), F.count("*").alias("n_copies")).select("text_class", F.col("least.row").alias("rep"), F.col("least.key").alias("text_key"), "n_copies"), "text-classes")
    reps = signed.join(classes.select(F.col("rep").alias("row")), "row").select(F.col("row").alias("rep"), "signature").filter("signature[0] <> 0 OR signature[1] <> 0")

    tree = F.posexplode(F.expr(f"transform(sequence(0, {TREES - 1}), t -> slice(signature, t * {DEPTH} + 1, {DEPTH}))")).alias("tree", "path")
    forest = reps.select("rep", tree).select(F.xxhash64("tree", F.slice("path", 1, least)).alias("node"), F.slice("path", least + 1, DEPTH).alias("rest"), "rep")
    forest = written(forest, "forest")
    # Nodes of one text need no sorting.
    shared = forest.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = written(forest.join(shared, "node"), "forest-shared")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = crowded.repartitionByRange(n, "node", "rest", "rep").sortWithinPartitions("node", "rest", "rep").select(F.spark_partition_id().alias("part"), "node", "rest", "rep")
    spans = written(dealt.mapInArrow(_spanning(least), "link boolean, part int, a long, b long, node long, last_node long"), "spans")
    # A node that goes on in the next partition: a row for each partition.
    order = Window.orderBy("part")
    ends = spans.filter("NOT link").select(F.col("a").alias("b"), "node", F.lag("b").over(order).alias("a"), F.lag("last_node").over(order).alias("before")).filter("node = before")
    tested = spans.filter("link").select("a", "b").unionByName(ends.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tested = written(tested, "candidates")

    def shingled(need: DataFrame) -> DataFrame:
        wanted = written(signed.select("row", "key", "h").join(need, "row"), "wanted")
        # Equal rows of one doc_id meet a wanted row more than once. A merge join at every size: what is wanted grows with the texts.
        texts = rows.join(wanted.hint("merge"), ["key", "h"]).groupBy("row").agg(F.min("text").alias("text"))
        return written(texts.mapInArrow(_sets, "row long, shingles array<bigint>"), "shingles")

    # Every row of a node of several texts is in a tested pair, so these sets serve all that follows.
    tested_sets = shingled(tested.select(F.col("a").alias("row")).unionByName(tested.select(F.col("b").alias("row"))).distinct())
    one = tested.join(tested_sets.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b")
    two = one.join(tested_sets.select(F.col("row").alias("a"), F.col("shingles").alias("x")), "a")
    links = written(two.filter(jaccard(F.col("x"), F.col("y")) >= threshold).select("a", "b"), "links")
    label = components(links)
    # Second round: members of one node in different components. Large nodes are cut into blocks, every two of which meet in a task; only links that join components leave it.
    placed = crowded.filter("n > 2").select("node", "n", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("node", "n", "rep", F.coalesce("component", "rep").alias("component"))
    # Trees often have the same members in a node: those of equal number, ends and sums of two full hashes, exact as decimals, are compared once.
    sums = [F.sum(F.xxhash64("rep", F.lit(seed)).cast("decimal(20,0)")).alias(f"sum{seed}") for seed in (1, 2)]
    mixed = placed.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("many"), F.min("rep").alias("least"), F.max("rep").alias("most"), *sums).filter("lo < hi")
    mixed = mixed.groupBy("many", "least", "most", "sum1", "sum2").agg(F.min("node").alias("node")).select("node")
    open_ = written(placed.join(mixed, "node"), "open-nodes")
    if not open_.isEmpty():
        blocks = F.ceil(F.col("n") / NODE_BLOCK).cast("int")
        dealt = open_.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        dealt = dealt.select("node", "rep", "component", F.explode(F.expr("transform(sequence(0, blocks - 1), j -> struct(least(own, j) AS i, greatest(own, j) AS j))")).alias("pair"))
        dealt = dealt.join(tested_sets.withColumnRenamed("row", "rep"), "rep").select("node", "pair", "rep", "component", "shingles")
        more = written(dealt.groupBy("node", "pair").applyInArrow(_joining(threshold), "a long, b long").distinct(), "links")
        if not more.isEmpty():
            links = written(links.unionByName(more).distinct(), "links")
            label = components(links)

    degree = link_counts(label, tested_sets, threshold) if count else label.select(F.col("node").alias("rep"), F.lit(1).alias("degree"))
    of_rep = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    of_rep = of_rep.withColumn("degree", F.coalesce("degree", F.col("component").isNotNull().cast("long"))).withColumn("component", F.coalesce("component", "rep"))
    least_key = of_rep.groupBy("component").agg(F.min("text_key").alias("class_key"))
    of_rep = of_rep.join(least_key, "component").select("text_class", "rep", "class_key", "text_key", "n_copies", (F.col("degree") + F.col("n_copies") - 1).alias("n_links"))
    return signed.select("key", "h", "text_class").join(of_rep, "text_class").drop("text_class")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of docs without near-duplicates: of each class the row with the least doc_id stays (a null one is the least; of equal ones that with the least text hash; of rows equal in both, that whose columns' hash is least), with all its columns, whatever their names. Null, empty and very long texts and empty tables as in ngram_join."""
    classes = joined(docs, threshold, recall, count=False)
    # Only classes of several rows meet the texts again.
    several = classes.filter("key > class_key OR n_links > 0").groupBy("class_key", "key", "h").agg(F.count("*").alias("n"))
    several = written(several, "members")
    first = several.groupBy("class_key").agg(F.min(F.struct("key", "h")).alias("first"))
    is_first = F.struct("key", "h") == F.col("first")
    fate = written(several.join(first, "class_key").select("key", "h", is_first.alias("stays"), "n").filter("NOT stays OR n > 1"), "fates")
    rows = docs.select(F.struct("*").alias("doc"))
    rows = rows.select("doc", key_of(F.col("doc")["doc_id"]).alias("key"), F.xxhash64(F.coalesce(F.col("doc")["text"].cast("string"), F.lit(""))).alias("h"))
    out = rows.join(fate, ["key", "h"], "left_anti").select("doc")
    equal = fate.filter("stays")
    if not equal.isEmpty():
        again = rows.join(equal, ["key", "h"]).groupBy("key", "h").agg(F.min_by("doc", F.xxhash64(F.to_json("doc"))).alias("doc"))
        out = out.unionByName(again.select("doc"))
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
