"""Source divergence audit: how the sources of a language differ in their words.

CountVectorizer builds exact sparse vectors of documents of a group: one for the terms that they have once, one
for those that they have twice, and so on, so a term is looked up once for many documents. One model has the
vocabularies of all languages, as its terms carry their language; it keeps the terms of at least
MIN_DOCS documents and has no other limit. Vectors are summed by language and source as entries, in
Arrow batches first, never as dense vectors, and pairs of sources are evaluated on the terms that either of them has:
all terms that neither has give the same value.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise, zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowkit import LOWER, UPPER, binary_list
from .common import scratch_path, written

#: Letters of ASCII and all characters beyond it; what else ASCII has stands between terms.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
OTHERS = bytes((*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))
TO_TERMS = bytes.maketrans(UPPER + OTHERS, LOWER + b" " * len(OTHERS))
#: Documents of a language that a term must be in, ranks of the terms' part, one as a probability.
MIN_DOCS, TOP_TERMS, UNIT = 10, 10, 1_000_000_000
#: The largest integer: no limit to a vocabulary.
MAX_VOCAB = 2**31 - 1
#: Different terms, kept or not, that one model may meet (about), and the smallest hashes that estimate how many there are. More terms are dealt to several models by their hashes, so that no vocabulary outgrows a task or the driver.
MODEL_TERMS, SMALLEST = 1 << 23, 1024
#: Entries of vectors that a task sums at once.
ENTRIES = 1 << 20
#: Terms of documents that a task counts together, and terms of a row.
HELD, ROW_TERMS = 1 << 20, 10_000
#: Between a language and a term; no term has it.
END = "\0"
#: Bytes of a language that its terms carry as %XX.
ESCAPED = re.compile(rb"[\x00-\x20%+]")


def divergence(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)) of two long columns."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def probability(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT (count + 2) / (total + 2 terms)), exact for any long; null without terms."""
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    return F.when(F.expr(f"{terms} > 0"), 1 + F.expr(f"CAST({UNIT} AS DECIMAL(10, 0)) * ({wide(count)} + 2) div nullif({wide(total)} + 2 * {wide(terms)}, 0)"))


class Numbers(dict):
    """term -> its number, in the order of first sight."""

    def __missing__(self, term: bytes) -> int:
        value = self[term] = len(self)
        return value


def rows_by_count(tag: bytes, names: list[bytes], of: np.ndarray, i: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(of, n, the names of number i that have both, tagged and joined by spaces), at most ROW_TERMS to a row."""
    order = np.lexsort((n, of))
    of, i, n = of[order], i[order].tolist(), n[order]
    edges = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (n[1:] != n[:-1])) + 1).tolist(), len(i)]
    for begin, end in pairwise(edges):
        for k in range(begin, end, ROW_TERMS):
            yield int(of[k]), int(n[k]), tag + (b" " + tag).join([names[j] for j in i[k : min(k + ROW_TERMS, end)]])


def term_texts(docs: DataFrame, min_docs: int = MIN_DOCS, held: int = 0) -> DataFrame:
    """The terms of docs (g, lang, text) as texts: g, times, terms (those that documents of g have so many times together, each once with its language, joined by spaces), docs, found (terms, each once, that so many of the documents have; min_docs stands for more), least (the smallest hashes of the terms of some rows, null for most).

    Documents that follow each other are counted together, up to about held terms of documents; with 0 each document is counted by
    itself. terms or found is null where there are more of the other; documents without terms have no row.
    """
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    fields = pa.schema([("g", pa.int64()), ("times", pa.int64()), ("terms", pa.string()), ("docs", pa.int64()), ("found", pa.string()), ("least", pa.list_(pa.int64()))])

    def flush(numbers: dict[bytes, Numbers], entries: dict[bytes, list]) -> pa.RecordBatch:
        terms, found, hashes = [], [], []
        for tag, own in numbers.items():
            g, i, n = zip(*entries[tag])
            names, (groups, at) = list(own), np.unique(np.array(g, np.int64), return_inverse=True)
            of, i, n = np.repeat(at, [len(x) for x in i]), np.concatenate(i), np.concatenate(n)
            key = of << 32 | i
            order = np.argsort(key)
            key = key[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, sums = key[at], np.add.reduceat(n[order], at)
            terms += [(int(groups[k]), *row) for k, *row in rows_by_count(tag, names, key >> 32, key & (2**32 - 1), sums)]
            df = np.minimum(np.bincount(i, minlength=len(own)), min_docs)
            found += [row for _, *row in rows_by_count(tag, names, np.zeros(len(own), np.int64), np.arange(len(own)), df)]
            hashes += [xxhash.xxh3_64_intdigest(tag + w) for w in names]
        few = np.sort(np.array(hashes, np.uint64))[:SMALLEST].view(np.int64).tolist()
        both = [(*(t or (None,) * 3), *(f or (None,) * 2)) for t, f in zip_longest(terms, found)]
        columns = [pa.array(c, kind).cast(f.type) for c, kind, f in zip(zip(*both), kinds, fields)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([few, *[None] * (len(both) - 1)], fields.field("least").type)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, entries, many = defaultdict(Numbers), defaultdict(list), 0
        for batch in batches:
            for g, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_list(batch.column(2))):
                counts = Counter(text.translate(TO_TERMS).split())
                if not counts:
                    continue
                tag = ESCAPED.sub(lambda m: b"%%%02X" % m[0][0], lang.encode()) + END.encode()
                i = np.fromiter(map(numbers[tag].__getitem__, counts), np.int64, len(counts))
                entries[tag].append((g, i, np.fromiter(counts.values(), np.int64, len(counts))))
                many += len(counts)
                if many > held:
                    yield flush(numbers, entries)
                    numbers.clear()
                    entries.clear()
                    many = 0
        if many:
            yield flush(numbers, entries)

    return docs.select("g", "lang", "text").mapInArrow(run, "g long, times long, terms string, docs long, found string, least array<long>")


def smallest_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h: the smallest of all hashes (rows of lists), in unsigned order."""
    few = np.zeros(0, np.uint64)
    for b in batches:
        few = np.unique(np.r_[few, b.column(0).flatten().to_numpy().view(np.uint64)])[:SMALLEST]
    yield pa.RecordBatch.from_arrays([pa.array(few.view(np.int64))], ["h"])


def different_terms(texts: DataFrame) -> int:
    """About how many different terms the languages have together, from the smallest of their hashes."""
    # Unsigned order; at most SMALLEST rows leave a task or reach the driver.
    h = F.col("h").bitwiseXOR(F.lit(-(2**63)))
    few = [r.h for r in texts.select("least").filter("least IS NOT NULL").mapInArrow(smallest_hashes, "h long").distinct().orderBy(h).limit(SMALLEST).collect()]
    return len(few) if len(few) < SMALLEST else int((SMALLEST - 1) * 2**64 / (few[-1] % 2**64 + 1))


def term_vectors(texts: DataFrame, min_docs: int = MIN_DOCS, model_terms: int = MODEL_TERMS) -> tuple[DataFrame, DataFrame]:
    """(vectors, vocabulary) of term_texts. vectors: g, times, model, counts (a sparse vector, one for each row and model); vocabulary: model, i, lang, term of every kept term."""
    spark = texts.sparkSession
    # No array is null, as the model may be evaluated ahead of the filter.
    cut = lambda c: F.split(F.coalesce(c, F.lit("")), " ").alias("terms")
    rows = texts.filter("terms IS NOT NULL").select("g", "times", cut("terms"))
    # A row stands for as many documents as have its terms, so the model meets each term in as many rows; more than min_docs change nothing.
    found = texts.filter("found IS NOT NULL").select("found", F.explode(F.sequence(F.lit(1).cast("long"), "docs"))).select(cut("found"))
    models = 1 + int(1.2 * different_terms(texts)) // model_terms
    # A term that every vocabulary has, so that none is empty.
    base = spark.range(min_docs).select(F.array(F.lit(END)).alias("terms"))
    vectors, vocabulary = None, None
    for k in range(models):
        part, seen = (d if models == 1 else d.withColumn("terms", F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(models)) == k)) for d in (rows, found))
        model = CountVectorizer(inputCol="terms", outputCol="counts", minDF=float(min_docs), vocabSize=MAX_VOCAB).fit(seen.unionByName(base))
        path = scratch_path(spark, "vocabulary")
        model.save(path)
        key = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("i", "key")).filter(F.col("key") != END)
        words = key.select(F.lit(k).alias("model"), "i", F.url_decode(F.substring_index("key", END, 1)).alias("lang"), F.substring_index("key", END, -1).alias("term"))
        vecs = model.transform(part).select("g", "times", F.lit(k).alias("model"), "counts")
        vectors = vecs if vectors is None else vectors.unionByName(vecs)
        vocabulary = words if vocabulary is None else vocabulary.unionByName(words)
    return vectors, vocabulary


def summed_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g, model, i, n of rows g, times, model, indices, values: their sums over about ENTRIES entries at a time."""
    held, many = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        g, model, size, i, n = (np.concatenate(c) for c in zip(*held))
        groups, of = np.unique(g, return_inverse=True)
        models, own = np.unique(model, return_inverse=True)
        key = np.repeat((of * len(models) + own) << 32, size) | i
        order = np.argsort(key)
        key = key[order]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n, key = np.add.reduceat(n[order], at), key[at]
        of, own = np.divmod(key >> 32, len(models))
        whole = pa.RecordBatch.from_arrays([pa.array(groups[of]), pa.array(models[own]), pa.array((key & (2**32 - 1)).astype(np.int32)), pa.array(n)], ["g", "model", "i", "n"])
        yield from (whole.slice(at, 50_000) for at in range(0, len(n), 50_000))

    for b in batches:
        size = pc.fill_null(pc.list_value_length(b.column("indices")), 0).to_numpy()
        i, value = (b.column(c).flatten().to_numpy() for c in ("indices", "values"))
        if not len(i):
            continue
        held.append((b.column("g").to_numpy(), b.column("model").to_numpy(), size, i.astype(np.int64), value.astype(np.int64) * np.repeat(b.column("times").to_numpy(), size)))
        many += len(i)
        if many >= ENTRIES:
            yield from flush()
            held, many = [], 0
    if held:
        yield from flush()


def group_sums(vectors: DataFrame) -> DataFrame:
    """g, model, i, n: the sums of sparse vectors, each as often as its times, by group, of the entries that they have."""
    v = vectors.select("g", "times", "model", F.unwrap_udt("counts").alias("v")).select("g", "times", "model", F.col("v.indices").alias("indices"), F.col("v.values").alias("values"))
    return v.mapInArrow(summed_entries, "g long, model int, i int, n long").groupBy("g", "model", "i").agg(F.sum("n").alias("n"))


def numbered_groups(groups: DataFrame) -> DataFrame:
    """groups (lang, source) with g, a number of their own: a hash, with another seed if two groups shared one."""
    n = groups.count()
    for seed in range(64):
        out = groups.withColumn("g", F.xxhash64("lang", "source", F.lit(seed)))
        if out.select("g").distinct().count() == n:
            return out
    raise ArithmeticError("groups share their hashes")


def source_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, model_terms: int = MODEL_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank.

    part 'pair': every other source of the language and the sum of the divergences of all kept
    terms, all ranks; part 'term': the kept terms that a source uses more often than its language,
    the first top of them. Ties are ordered by item in bytes. docs: text, lang, source (null: '');
    other columns are ignored. A language without kept terms has the value 0 for all its pairs and
    no terms; repeated rows count each; texts are read whole; an empty table gives an empty result.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(blank("lang"), blank("source"), "text")
    named = numbered_groups(written(docs.select("lang", "source").distinct(), "groups"))
    # Documents of a group come together, as they share more of their terms; a large group has many tasks.
    texts = written(term_texts(docs.join(named, ["lang", "source"]).hint("rebalance", "g"), min_docs, HELD), "terms")
    vectors, vocabulary = term_vectors(texts, min_docs, model_terms)
    vocabulary = written(vocabulary, "vocabulary")
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"))
    sums = written(group_sums(vectors), "sums").filter(F.col("n") > 0)
    # The term of every vocabulary is in no vector, as no row has it.
    totals = sums.groupBy("g").agg(F.sum("n").alias("total"))
    groups = named.join(totals, "g", "left").join(sizes, "lang", "left").select("g", "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    groups = written(groups.withColumn("p0", probability("0", "total", "terms")), "numbers")
    cells = written(sums.join(groups, "g").select("lang", "g", "model", "i", probability("n", "total", "terms").alias("p"), "p0"), "cells")

    whole = sums.groupBy("model", "i").agg(F.sum("n").alias("n")).join(vocabulary, ["model", "i"])
    whole = whole.join(groups.groupBy("lang").agg(F.sum("total").alias("total")), "lang").join(sizes, "lang").select("model", "i", "term", probability("n", "total", "terms").alias("q"))
    terms = cells.join(whole, ["model", "i"]).filter("p > q").select("g", F.col("term").alias("item"), divergence("p", "q").alias("value"))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item"))
    names = groups.select("g", "lang", "source")
    terms = terms.withColumn("rank", place("g")).filter(F.col("rank") <= top).join(names, "g").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    one = groups.select("lang", F.col("g").alias("a"), F.col("source"), F.col("p0").alias("a0"), "terms")
    two = groups.select("lang", F.col("g").alias("b"), F.col("source").alias("item"), F.col("p0").alias("b0"))
    pairs = one.join(two, "lang").filter("a <> b").withColumn("none", divergence("a0", "b0"))
    # Terms of one source count as if the other had none of them; the terms of both are put right.
    steps = cells.groupBy(F.col("g").alias("a"), "p").agg(F.count("*").alias("m"))
    alone = steps.join(pairs, "a").groupBy("a", "b").agg(F.sum(F.col("m") * (divergence("p", "b0") - F.col("none"))).alias("v"))
    of = lambda s: cells.select("model", "i", F.col("g").alias(s), F.col("p").alias(f"{s}p"), F.col("p0").alias(f"{s}0"))
    both = of("a").join(of("b"), ["model", "i"]).filter("a < b")
    both = both.groupBy("a", "b").agg(F.sum(divergence("ap", "bp") - divergence("ap", "b0") - divergence("a0", "bp") + divergence("a0", "b0")).alias("v"))
    turned = lambda df: df.select(F.col("b").alias("a"), F.col("a").alias("b"), "v")
    base = pairs.select("a", "b", F.coalesce(F.col("terms") * F.col("none"), F.lit(0)).alias("v"))
    value = base.unionByName(alone).unionByName(turned(alone)).unionByName(both).unionByName(turned(both)).groupBy("a", "b").agg(F.sum("v").alias("value"))
    pair = value.join(pairs.select("a", "b", "lang", "source", "item"), ["a", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pair.withColumn("rank", place("lang", "source")).unionByName(terms)
