"""Phrase collocation mining over Rabin-Karp fingerprints.

Prefix polynomials in numpy give the fingerprint of every run of words. Shuffles add up counts by
fingerprint, first of words, then of pairs of frequent words, then of longer runs of frequent pairs
(a frequent phrase has only frequent parts, so none is lost); what is frequent goes into bitmaps of
bounded size, which let some rare fingerprints through and never stop a frequent one. A last pass
opens the places whose fingerprints are frequent: it compares their words with those of the first
such place, so phrases that share a fingerprint part, and the shuffle adds up counts by the text
itself, with the first place. Only these phrases ever become text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowkit import LOWER, UPPER, binary_list, mixed
from .common import written

#: Words of a phrase at most, occurrences at least, share of a phrase's occurrences (in percent) that a longer one needs to replace it, phrases of a language.
LONGEST, LEAST, SHARE, TOP = 5, 100, 100, 2000
#: Bits of a bitmap of frequent fingerprints: 16 for each one, within these powers of two.
MIN_BITS, MAX_BITS = 16, 28
#: Text that a task holds as words at once, words whose runs are hashed together, fingerprints that are counted together, words that a task numbers.
CHUNK_BYTES, BLOCK_WORDS, HELD, MEMO_WORDS = 1 << 21, 1 << 19, 1 << 20, 300_000
#: Ends of a piece and of a text; no UTF-8 text has these bytes.
END, DOC = b"\xff", b"\xfe"
TO_WORDS = bytes.maketrans(UPPER + b".,;:!?\n\x0b\x0c\r\t", LOWER + END * 10 + b" ")
BASE = 0x9E3779B97F4A7C15
GRAM = pa.schema([("h", pa.int64()), ("n", pa.int64())])
PHRASE = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64())])


class Words(dict):
    """word -> number; hashes[number] is its 64-bit hash, 0 for the ends."""

    def __init__(self):
        self.hashes = np.zeros(1024, np.uint64)
        self.ends()

    def ends(self) -> None:
        self[END], self[DOC] = 0, 1

    def __missing__(self, word: bytes) -> int:
        k = len(self)
        if k == len(self.hashes):
            self.hashes = np.r_[self.hashes, np.zeros(k, np.uint64)]
        self.hashes[k] = xxhash.xxh3_64_intdigest(word) or 1
        self[word] = k
        return k


class Powers:
    """Powers of the base and of its inverse, modulo 2^64."""

    def __init__(self, n: int):
        self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)])
        self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)])


def fingerprints(w: np.ndarray, seed: int, sizes: tuple[int, ...], powers: Powers) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, fingerprints) of all runs of k words (hashes w) within pieces (a hash of 0 ends one)."""
    prefix = np.r_[np.uint64(0), np.cumsum(w * powers.down[1 : len(w) + 1], dtype=np.uint64)]
    ends = np.r_[0, np.cumsum(w == 0)]
    for k in sizes:
        at = np.flatnonzero(ends[k:] == ends[:-k]) if k <= len(w) else np.zeros(0, np.int64)
        yield k, at, mixed((prefix[at + k] - prefix[at]) * powers.up[at + k] ^ np.uint64((seed + 0xD6E8FEB86659FD93 * k) % (1 << 64)))


def passes(bitmap: bytes, h: np.ndarray) -> np.ndarray:
    """Which fingerprints a bitmap may hold."""
    bits = np.frombuffer(bitmap, np.uint8)
    at = h >> np.uint64(65 - (8 * len(bits)).bit_length())
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def language_chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, list[int | None], list[bytes]]]:
    """Texts of one language, in the order of doc_id, about CHUNK_BYTES together (a longer text is alone)."""
    rows = sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_list(batch.column(2))), key=lambda r: (r[0], -(2**63) if r[1] is None else r[1]))
    ids, texts, size, lang = [], [], 0, None
    for own, doc, text in rows:
        if texts and (own != lang or size >= CHUNK_BYTES):
            yield lang, ids, texts
            ids, texts, size = [], [], 0
        lang = own
        ids.append(doc)
        texts.append(text)
        size += len(text)
    if texts:
        yield lang, ids, texts


def word_numbers(texts: list[bytes], memo: Words) -> tuple[list[bytes], np.ndarray]:
    if len(memo) > MEMO_WORDS:
        memo.clear()
        memo.ends()
    words = (b" " + DOC + b" ").join(t.translate(TO_WORDS).replace(END, b" " + END + b" ") for t in texts).split()
    return words, np.fromiter(map(memo.__getitem__, words), np.int64, len(words))


def blocks(n: int, longest: int) -> Iterator[tuple[int, int]]:
    """Runs of places, each with the words that runs beginning there need."""
    for a in range(0, n, BLOCK_WORDS):
        yield a, min(n, a + BLOCK_WORDS + longest - 1)


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode(), seed=7)


def frequent(texts: DataFrame, sizes: tuple[int, ...], parts: tuple[int, bytes] | None, least: int, tag: str) -> DataFrame:
    """h of the runs of the given sizes that occur least times; parts: (size, bitmap), the runs of that size that all parts must be in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, powers, held = Words(), Powers(BLOCK_WORDS + LONGEST), []

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], schema=GRAM)

        for batch in batches:
            for lang, _, some in language_chunks(batch):
                _, ids = word_numbers(some, memo)
                w = memo.hashes[ids]
                for a, b in blocks(len(w), max(sizes)):
                    own = w[a:b]
                    if parts is not None:
                        ((size, at, h),) = fingerprints(own, _seed(lang), (parts[0],), powers)
                        fit = np.zeros(len(own) + 1, np.int64)
                        fit[at[passes(parts[1], h)] + 1] = 1
                        fit = np.cumsum(fit)
                    for k, at, h in fingerprints(own, _seed(lang), sizes, powers):
                        keep = at < BLOCK_WORDS
                        if parts is not None:
                            keep &= fit[at + k - size + 1] - fit[at] == k - size + 1
                        held.append(h[keep])
                    if sum(map(len, held)) >= HELD:
                        yield counted()
        if held:
            yield counted()

    # Tasks have counted what they can: rows are dealt out before they are added up, to more tasks for a larger input.
    n = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * texts.rdd.getNumPartitions())
    got = texts.mapInArrow(run, "h long, n long").repartition(n, "h").groupBy("h").agg(F.sum("n").alias("n"))
    return written(got.filter(F.col("n") >= least).select("h"), tag)


def bitmap_of(hashes: DataFrame) -> bytes:
    """A bitmap of fingerprints by their first bits. Its size is bounded by MAX_BITS; a fuller one lets more pass."""
    bits = min(MAX_BITS, max(MIN_BITS, (16 * hashes.count()).bit_length()))
    at = hashes.select(F.shiftrightunsigned("h", 64 - bits).alias("at"))
    got = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63L AS INT))")).alias("bits"))
    rows = got.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.astype("<i8").tobytes()


def opened_batches(batches: Iterable[pa.RecordBatch], maps: dict[int, bytes], longest: int) -> Iterator[pa.RecordBatch]:
    """The frequent phrases of the batches (lang, doc_id, text), counted by their words, with the first place of each, and a row for the words of each chunk."""
    memo, powers = Words(), Powers(BLOCK_WORDS + LONGEST)
    for batch in batches:
        for lang, docs, some in language_chunks(batch):
            words, ids = word_numbers(some, memo)
            w = memo.hashes[ids]
            rows: list[tuple] = [("", int((w != 0).sum()), None, None)]
            ends = np.flatnonzero(ids == memo[DOC])
            starts = np.r_[0, ends + 1]
            before = np.r_[0, np.cumsum(w != 0)]
            for a, b in blocks(len(w), longest):
                for k, at, h in fingerprints(w[a:b], _seed(lang), tuple(maps), powers):
                    keep = (at < BLOCK_WORDS) & passes(maps[k], h)
                    at, h = at[keep] + a, h[keep]
                    while len(at):
                        _, first, of = np.unique(h, return_index=True, return_inverse=True)
                        # A place counts if its words are those of its fingerprint's first place; the rest go another round.
                        same = np.ones(len(at), bool)
                        for j in range(k):
                            same &= ids[at + j] == ids[at[first][of] + j]
                        n = np.bincount(of[same], minlength=len(first))
                        place = at[first]
                        doc = np.searchsorted(ends, place)
                        for p, c, d, s in zip(place.tolist(), n.tolist(), doc.tolist(), (before[place] - before[starts[doc]]).tolist()):
                            rows.append((b" ".join(words[p : p + k]).decode(), c, docs[d], s))
                        at, h = at[~same], h[~same]
            phrase, n, doc, at = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(phrase, pa.string()), pa.array(n, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int64())], schema=PHRASE)


def opened(texts: DataFrame, maps: dict[int, bytes], least: int, longest: int) -> DataFrame:
    """lang, phrase, n, doc_id, at of the phrases that occur least times: where each first occurs (the smallest doc_id, null first, and the words before it there). A row with an empty phrase has the words of a language."""

    got = texts.mapInArrow(lambda batches: opened_batches(batches, maps, longest), "lang string, phrase string, n long, doc_id long, at long")
    got = got.groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "at")).alias("first"))
    return written(got.filter((F.col("n") >= least) | (F.col("phrase") == "")).select("lang", "phrase", "n", "first.doc_id", "first.at"), "phrases")


def cut_score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)) of long columns, exact."""
    wide = lambda c: f"CAST({c} AS DECIMAL(16, 0))"
    return F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {wide(a)} * {wide(n)}) div ({wide(left)} * {wide(right)})")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, doc_id, at: each language's first phrases of 2 to longest words that occur least times.

    docs: doc_id, text, lang; other columns are ignored. A phrase lies within a piece of a text, is
    scored by its lowest-scoring cut (of equal ones after the fewest words) and goes if a longer one
    around it has share percent of its occurrences. doc_id, at: its first place. A null lang is
    'und', a null text empty; repeated rows count each; texts are read whole; ties go by the
    phrase's bytes; an empty table gives an empty result.
    """
    if longest > LONGEST:
        raise ValueError(f"phrases have at most {LONGEST} words")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    maps = {1: bitmap_of(frequent(texts, (1,), None, least, "words"))}
    maps[2] = bitmap_of(frequent(texts, (2,), (1, maps[1]), least, "pairs"))
    if longest > 2:
        rest = tuple(range(3, longest + 1))
        many = bitmap_of(frequent(texts, rest, (2, maps[2]), least, "runs"))
        maps |= dict.fromkeys(rest, many)
    found = opened(texts, maps, least, longest)
    total = found.filter("phrase = ''").select("lang", F.col("n").alias("total"))
    part = found.filter("phrase <> ''").select("lang", "phrase", "n")
    whole = found.filter("instr(phrase, ' ') > 0").select("lang", "phrase", F.col("n").alias("a"), "doc_id", "at", F.split("phrase", " ").alias("w"))

    runs = lambda a, size: F.array_join(F.slice("w", a, size), " ")
    cuts = whole.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select("lang", "phrase", "a", "k", runs(F.lit(1), F.col("k")).alias("left"), runs(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(part.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]).join(total, "lang")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(cut_score("a", "total", "l", "r").alias("score"), "k", "l", "r")).alias("c"))

    inner = F.expr("flatten(transform(sequence(2, size(w) - 1), k -> transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' '))))")
    around = whole.filter(F.size("w") > 2).select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    stays = whole.join(around, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (100 * F.col("around") < share * F.col("a")))
    out = stays.join(best, ["lang", "phrase"]).join(total, "lang").select("lang", "phrase", "a", "c.l", "c.r", F.col("total").alias("n"), "c.score", "doc_id", "at")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return out.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "doc_id", "at")
