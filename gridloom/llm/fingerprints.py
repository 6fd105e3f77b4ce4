"""Document fingerprints: bottom-k sketches of the hashes of word shingles.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's five-word
shingles. Sketches of parts merge into the sketch of the whole (the k smallest of their
union), and they estimate resemblance, containment and the number of distinct shingles.
Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_of, key_of, written

#: Hashes kept of each text.
K = 128
SHINGLE_WORDS = 5
SPACES = " \t\n\x0b\f\r"
#: Rows that one step of the neighbour search sorts in a task, about.
ORDER_ROWS = 500_000


def sketch(text: Column, k: int = K, width: int = SHINGLE_WORDS) -> Column:
    """array<bigint>. Words are lower-cased and separated by ASCII white space. A text of fewer words than width has its whole word sequence as its only shingle; a text without words has an empty sketch."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACES))
    return sketch_of_words(F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")), k, width)


def sketch_of_words(words: Column, k: int = K, width: int = SHINGLE_WORDS) -> Column:
    def shingles(h: Column) -> Column:
        # get() beyond the end is null, which the hash passes over; those cut shingles are left out.
        made = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, width)]))
        return F.slice(made, 1, F.greatest(F.size(h) - (width - 1), F.lit(1)))

    # Held in a lambda, the hashed words are computed once and not for every shingle.
    hashed = F.array(F.transform(words, lambda w: F.xxhash64(w)))
    return F.slice(F.sort_array(F.array_distinct(F.transform(hashed, shingles)[0])), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_agg(sketches: Column, k: int = K) -> Column:
    """An aggregate: the sketch of all parts of a group, for groups of a bounded number of parts; fold larger ones by merge() in levels."""
    return F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(sketches)))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sketches are alike (1)."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both).cast("double"))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na)))


def encoded(a: Column) -> Column:
    """A fingerprint as a string: the hashes as 16 hexadecimal digits each, without separators."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprints(docs: DataFrame, k: int = K, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, sketch and the estimated number of distinct shingles for each row of docs (doc_id, text); null texts count as empty."""
    made = docs.select("doc_id", sketch(F.col("text"), k, width).alias("sketch"))
    return made.select("doc_id", "sketch", distinct_shingles(F.col("sketch"), k).alias("n_shingles"))


#: Rows stand in this order; rows that are equal in both have equal texts.
ORDER = ("key", "h")
#: Equal rows that one task makes at once.
COPIES = 1000


def previous_rows(ids: DataFrame) -> DataFrame:
    """(key, h, n_chars) -> (key, h, prev_key, prev_h, prev_chars): each row with the one before it in ascending order; the first follows the last. Rows must be distinct, so no key is a hot group."""
    spark = ids.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + ids.count() // ORDER_ROWS)
    dealt = written(ids.repartitionByRange(n, *ORDER).withColumn("part", F.spark_partition_id()), "id-order")
    last = dealt.groupBy("part").agg(F.max(F.struct(*ORDER, "n_chars")).alias("last"))
    # A row for each partition, not for each document.
    carry = last.select("part", F.coalesce(F.lag("last").over(Window.orderBy("part")), F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("carry"))
    within = F.lag(F.struct(*ORDER, "n_chars")).over(Window.partitionBy("part").orderBy(*ORDER))
    joined = dealt.withColumn("before", within).join(F.broadcast(carry), "part")
    before = F.coalesce("before", "carry")
    return joined.select("key", "h", before["key"].alias("prev_key"), before["h"].alias("prev_h"), before["n_chars"].alias("prev_chars"))


def fingerprint_edits(docs: DataFrame, k: int = K, width: int = SHINGLE_WORDS, repeats: bool = False) -> DataFrame:
    """Fingerprint every text and its edited text: the last quarter of its code points replaced by as many first ones (or all) of the next document by ascending doc_id, after the last the first.

    docs: doc_id, text; other columns are ignored. Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, n_shingles (estimated). A null text
    counts as empty, a null doc_id as the smallest. With repeats every row of docs is returned,
    and rows of one doc_id follow each other by their texts' hashes; rows that are equal follow
    each other, so all but the last are edited with their own text. Without, a doc_id counts once,
    with the text whose hash is the largest. A table of one document is its own next. Very long
    texts are taken whole; an empty table gives an empty result. Rows are known by doc_id and text
    hash, so docs may come in other partitions each time it is read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(key_of().alias("key"), F.xxhash64(text).alias("h"), text.alias("text"))
    ids = rows.select("key", "h", F.length("text").alias("n_chars")).distinct()
    if not repeats:
        ids = ids.groupBy("key").agg(F.max(F.struct("h", "n_chars")).alias("last")).select("key", "last.*")
    order = previous_rows(ids)
    # The texts are shuffled once; both uses below read the same exchange.
    own = rows.groupBy(*ORDER).agg(F.min("text").alias("text"), F.count("*").alias("n")).join(order.hint("merge"), list(ORDER))
    first = lambda t, n: F.substring(t, F.lit(1), F.floor(n / 4).cast("int"))
    head = own.select(F.col("prev_key").alias("key"), F.col("prev_h").alias("h"), first("text", F.col("prev_chars")).alias("head"), sketch(F.col("text"), k, width).alias("next_sketch"))
    pairs = own.select("key", "h", "text", "n").join(head.hint("merge"), list(ORDER))

    def told(df: DataFrame, n: str) -> DataFrame:
        size = F.length("text")
        df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), size - F.floor(size / 4).cast("int")), F.col("head")))
        df = df.select("key", n, size.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), sketch(F.col("text"), k, width).alias("a"), sketch(F.col("edited"), k, width).alias("b"), "next_sketch")
        return df.select(
            id_of().alias("doc_id"), "n_chars", "edited_sha256", encoded(F.col("a")).alias("fingerprint"), encoded(F.col("b")).alias("edited_fingerprint"),
            resemblance(F.col("a"), F.col("b"), k).alias("near_edited"), resemblance(F.col("a"), F.coalesce("next_sketch", "a"), k).alias("near_next"), distinct_shingles(F.col("a"), k).alias("n_shingles"), n,
        )

    out = told(pairs, "n")
    many = written(rows.groupBy(*ORDER).agg(F.count("*").alias("n")).filter("n > 1"), "equal-rows") if repeats else None
    if many is not None and not many.isEmpty():
        # Equal rows but the last are their own next. They are made once, then dealt out.
        equal = rows.join(many, list(ORDER)).groupBy(*ORDER, "n").agg(F.min("text").alias("text"))
        again = told(equal.select("key", "n", "text", first("text", F.length("text")).alias("head"), F.lit(None).cast("array<bigint>").alias("next_sketch")), "n")
        parts = again.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 2) div {COPIES})"))).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        out = out.unionByName(parts.withColumn("nth", F.explode(F.expr(f"sequence(1L, least({COPIES}L, n - 1 - part * {COPIES}))"))).drop("part", "nth"))
    return out.drop("n")
