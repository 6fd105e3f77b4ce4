"""Packing by optimal length buckets.

The lengths of all documents form a global histogram. Dynamic programming over it chooses the
bucket boundaries that minimise padding; inside each bucket, batches fill a budget of tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, written

#: Buckets at most, tokens of a batch with its padding, rows that one task ranks (about).
BUCKETS, BUDGET, SHARD_ROWS = 16, 65_536, 100_000
#: Lengths up to EXACT are their own histogram bin; beyond, every doubling has EXACT bins, so the histogram's size is bounded whatever the input.
EXACT = 512
#: Equal rows that one task makes from one row at once.
COPIES = 10_000


def word_tokens(text: Column) -> Column:
    """Words between ASCII white space, and one end token."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE_WORD)).cast("long") + 1


def bin_top(length: Column, exact: int = EXACT) -> Column:
    """The largest length of a length's histogram bin."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(length - 1, F.lit(1)) / exact)) + 1))
    return F.when(length <= exact, length).otherwise((F.ceil(length / step) * step).cast("long"))


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most buckets buckets with the least padding; lengths ascend. The best split of a longer prefix never moves left, so each layer is found by divide and conquer."""
    n = len(lengths)
    if n == 0:
        return []
    c = np.r_[0, np.cumsum(counts, dtype=float)]
    w = np.r_[0, np.cumsum(counts * lengths, dtype=float)]
    # Padding of bins i..j-1 in one bucket: lengths[j-1] * their documents - their tokens.
    best = lengths * c[1:] - w[1:]
    best = np.r_[0.0, best]
    back = [np.zeros(n + 1, int)]
    for _ in range(1, min(buckets, n)):
        new, cut = best.copy(), np.zeros(n + 1, int)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + lengths[j - 1] * (c[j] - c[i]) - (w[j] - w[i])
            k = int(cost.argmin())
            new[j], cut[j] = cost[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        best = new
        back.append(cut)
    out, j = [], n
    for cut in reversed(back):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return out[::-1]


def packing(docs: DataFrame, n_tokens: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, exact: int = EXACT) -> DataFrame:
    """One row for each row of docs (doc_id, text; other columns are ignored): doc_id, n_tokens, bucket (from 0, short to long), bucket_tokens (its sequences are padded to this), batch (number within the bucket), slot (place within the batch), padding.

    n_tokens: the length of a document, by default its words and an end token; a null text
    counts as empty. exact: up to this length the programme sees every length, beyond it bins of
    at most 2 / exact of their length; with the longest length or more the split is the optimum
    itself, and the histogram has a row for each different length. A batch holds budget div bucket_tokens sequences, one at least; only a
    bucket's last batch is not full. Ties are ordered by doc_id and text hash, a null doc_id
    first. Repeated rows and ids each get their own place; a text longer than the budget has a
    batch of its own; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (word_tokens(F.col("text")) if n_tokens is None else n_tokens).alias("n_tokens"), F.xxhash64("doc_id", "text").alias("h"))
    rows = written(rows, "lengths")
    # The histogram's bins are bounded by exact and the logarithm of the longest length.
    seen = rows.groupBy(bin_top(F.col("n_tokens"), exact).alias("top")).agg(F.count("*").alias("n"), F.max("n_tokens").alias("longest")).orderBy("top").collect()
    tops = boundaries(np.array([r.longest for r in seen], dtype=np.int64), np.array([r.n for r in seen], dtype=np.int64), buckets)
    bucket = F.lit(0)
    for t in tops[:-1]:
        bucket = bucket + (F.col("n_tokens") > t).cast("int")
    top = F.element_at(F.array(*map(F.lit, tops or [1])), F.col("bucket") + 1).cast("long")
    # A bucket may hold most rows: it is ranked in shards, whose sizes give each shard's first rank. Equal rows are ranked as one.
    total = sum(r.n for r in seen)
    shards = max(1, -(-total // SHARD_ROWS))
    rows = rows.groupBy("doc_id", "n_tokens", "h").agg(F.count("*").alias("n")).withColumn("bucket", bucket).withColumn("shard", F.pmod("h", F.lit(shards)))
    sizes = rows.groupBy("bucket", "shard").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.coalesce(F.sum("n").over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("rank", rank).join(firsts, ["bucket", "shard"]).withColumn("bucket_tokens", top)
    placed = written(placed.select("doc_id", "n_tokens", "bucket", "bucket_tokens", "n", (F.col("rank") + F.col("first")).alias("rank")), "ranks")
    # Equal rows are made in runs of COPIES, which are dealt out, so that no task makes all copies of a row.
    runs = placed.filter("n > 1").withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})"))).repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards))
    again = runs.withColumn("rank", F.explode(F.expr(f"sequence(rank + run * {COPIES}, rank + least(n, (run + 1) * {COPIES}) - 1)"))).drop("run")
    placed = placed.filter("n = 1").unionByName(again)
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_tokens")))
    return placed.select("doc_id", "n_tokens", "bucket", "bucket_tokens", F.floor(F.col("rank") / size).alias("batch"), (F.col("rank") % size).cast("int").alias("slot"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"))
