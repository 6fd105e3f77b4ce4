"""A hidden Markov language model over words.

Words are counted over all training documents. The most frequent ones are symbols of their
own; every other word belongs to a class by its shape, inside which it has its add-one share.
Baum-Welch re-estimates the latent states: each partition gathers expected counts, and their
sums over all partitions give the next model. A text's score is the logarithm of its exact
likelihood by the scaled forward recursion.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowkit import TO_LOWER, batches, binary_list
from .common import written

STATES = 8
#: Baum-Welch ends when a round raises the log-likelihood by less than this share, or after ROUNDS rounds.
GAIN, ROUNDS = 1e-2, 8
#: Words that are symbols of their own, and words whose counts are sent to every task: fixed bounds.
SYMBOLS, COMMON = 8192, 32_768
#: Other words fall in classes by length and by the hash of their last two bytes.
LENGTHS, ENDINGS = 4, 64
CLASSES = LENGTHS * ENDINGS
#: Bins of a doubling in the histogram of word counts.
BINS = 64
#: Steps of a sequence whose forward vectors are held at once; those of earlier steps are computed again from the carried ones.
RUN = 4096
#: The end token stands for itself; its bytes cannot be a word.
END = b" "
#: Distinct words that a task counts before it passes them on.
COUNT_WORDS = 300_000


def shape(word: bytes) -> int:
    """A class of 0 .. CLASSES - 1: by length in bytes and the last two bytes, which tell languages and kinds of words apart."""
    return ENDINGS * min(LENGTHS - 1, len(word) // 5) + zlib.crc32(word[-2:]) % ENDINGS


def word_hash(word: bytes) -> int:
    """64 bits, signed as Spark's long; two words of one corpus practically never share it."""
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


@dataclass
class WordStats:
    """Bounded statistics of the training corpus, sent to every task."""

    common: dict[bytes, int]
    symbol: dict[bytes, int]
    tokens: int
    types: int
    class_tokens: np.ndarray
    class_types: np.ndarray


@dataclass
class Hmm:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def is_training(doc_id: str):
    """Not those whose crc32 of the id as text leaves 2 when divided by 7; a null id is a training one."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 7 != 2, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, class, count) over docs (text), with the end token once for each row."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        schema = pa.schema([("word", pa.binary()), ("class", pa.int32()), ("n", pa.int64())])

        def flush():
            yield from batches(((w, -1 if w == END else shape(w), n) for w, n in held.items()), schema)

        for b in it:
            for text in binary_list(b.column("text")):
                held.update(text.translate(TO_LOWER).split())
                held[END] += 1
                if len(held) > COUNT_WORDS:
                    yield from flush()
                    held.clear()
        yield from flush()

    return docs.select("text").mapInArrow(count, "word binary, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n"))


def word_stats(counts: DataFrame, common: int = COMMON, symbols: int = SYMBOLS) -> WordStats:
    """counts: a written table. Only the common words, those above the count that a histogram of bounded size gives, and a row for each class come to the driver."""
    binned = counts.withColumn("bin", F.floor(F.log2("n") * BINS))
    left, least = common, None
    for r in binned.groupBy("bin").agg(F.count("*").alias("v")).orderBy(F.desc("bin")).collect():
        left -= r.v
        if left < 0:
            break
        least = r.bin
    top = binned.filter(F.col("bin") >= least).collect() if least is not None else []
    top = sorted(((bytes(r.word), r.n) for r in top), key=lambda x: (-x[1], x[0]))
    symbol = {w: i for i, (w, _) in enumerate([x for x in top if x[0] != END][: symbols - 1], 1)} | {END: 0}
    ct, cv = np.zeros(CLASSES), np.zeros(CLASSES)
    tokens = types = 0
    for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens, types = tokens + r.n, types + r.v
        if r["class"] >= 0:
            ct[r["class"]], cv[r["class"]] = r.n, r.v
    for w, n in top:
        if w in symbol and w != END:
            ct[shape(w)] -= n
            cv[shape(w)] -= 1
    return WordStats(dict(top), symbol, tokens, types, ct, cv)


TOKEN_COLUMNS = "row long, doc_id long, training boolean, n_tokens long, n_known long, base double, inside double, symbols binary, rare array<bigint>, rare_n array<int>"


class WordCodes(dict):
    """word -> row of the columns below; a task starts anew when it holds many."""

    def __init__(self, stats: WordStats):
        self.stats, self.log = stats, {w: float(np.log10(n + 1)) for w, n in stats.common.items()}
        self.denominator = np.log10(stats.class_tokens + stats.class_types + 1).tolist()
        self.rows: list[tuple] = []
        self.held: list[np.ndarray] = []

    def __missing__(self, word: bytes) -> int:
        symbol, log = self.stats.symbol.get(word), self.log.get(word)
        if symbol is None:
            kind = shape(word)
            symbol, inside = len(self.stats.symbol) + kind, (log or 0.0) - self.denominator[kind]
        else:
            inside = 0.0
        self.rows.append((symbol, log or 0.0, inside, log is None, word_hash(word) if log is None else 0))
        at = self[word] = len(self)
        return at

    def columns(self) -> list[np.ndarray]:
        kinds = (np.uint16, float, float, bool, np.int64)
        if self.rows:
            new = [np.array(c, t) for c, t in zip(zip(*self.rows), kinds, strict=True)]
            self.held = [np.concatenate(x) for x in zip(self.held, new, strict=True)] if self.held else new
            self.rows = []
        return self.held


def tokenised(docs: DataFrame, stats: WordStats) -> DataFrame:
    """Each document as symbols (16 bits each), its words beyond the common ones as (hash, times), and the parts of its scores that the common words give."""

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = TOKEN_COLUMNS.replace(",", "").split()[::2]
        codes = WordCodes(stats)
        for whole in it:
            for part in range(0, whole.num_rows, 2000):
                b = whole.slice(part, 2000)
                if len(codes) > COUNT_WORDS:
                    codes = WordCodes(stats)
                docs = [[*t.translate(TO_LOWER).split(), END] for t in binary_list(b.column("text"))]
                size = np.array([len(w) for w in docs])
                at = np.cumsum(size) - size
                word = np.fromiter((codes[w] for words in docs for w in words), np.int64, int(size.sum()))
                symbol, log, inside, rare, hashed = codes.columns()
                data, ends = symbol[word].tobytes(), (2 * np.r_[0, np.cumsum(size)]).tolist()
                doc = np.repeat(np.arange(len(docs)), size)
                out = rare[word]
                pair, times = np.unique(doc[out] << 32 | word[out], return_counts=True)
                offsets = pa.array(np.searchsorted(pair >> 32, np.arange(len(docs) + 1)), pa.int32())
                cols = [pa.array(size), pa.array(size - np.add.reduceat(out.astype(np.int64), at)), pa.array(np.add.reduceat(log[word], at)), pa.array(np.add.reduceat(inside[word], at)), pa.array([data[x:y] for x, y in zip(ends, ends[1:])], pa.binary())]
                cols += [pa.ListArray.from_arrays(offsets, pa.array(hashed[pair & 0xFFFFFFFF])), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names[:3]), *cols], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), is_training("doc_id").alias("training"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(make, TOKEN_COLUMNS)


def first_model(stats: WordStats, states: int = STATES) -> Hmm:
    """Shares of symbols in the corpus, moved apart and the same on every run; states tend to stay."""
    rng = np.random.default_rng(10)
    share = np.zeros(len(stats.symbol) + CLASSES)
    for w, i in stats.symbol.items():
        share[i] = stats.common.get(w, 0)
    share[len(stats.symbol) :] = stats.class_tokens
    emit = (share + 1) * rng.uniform(0.2, 1.8, (states, len(share)))
    step = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Hmm(np.full(states, 1 / states), step, emit / emit.sum(1, keepdims=True))


class Sequences:
    """Symbol sequences side by side, longest first, step by step: symbols number t of those that have one stand at flat[at[t] : at[t + 1]]."""

    def __init__(self, symbols: list[np.ndarray]):
        size = np.array([len(x) for x in symbols])
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        narrow = step.astype(np.uint16) if size[0] <= 1 << 16 else step
        self.flat = np.concatenate([symbols[i] for i in self.order])[np.argsort(narrow, kind="stable")].astype(np.int64)
        self.at = np.r_[0, np.cumsum(np.bincount(step))].tolist()
        self.longest = len(self.at) - 1


class Segment:
    """Scaled forward vectors (a), their scales (z) and emissions (e) of steps first .. end - 1, from the carried vectors of the step before."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray, seqs: Sequences, carried: np.ndarray | None, first: int, end: int):
        base = seqs.at[first]
        self.symbols = seqs.flat[base : seqs.at[end]]
        self.at = [x - base for x in seqs.at[first : end + 1]]
        self.e = emit.take(self.symbols, axis=0)
        self.a, self.z = np.empty_like(self.e), np.empty(len(self.e), self.e.dtype)
        one = np.ones(len(start), self.e.dtype)
        last = carried
        for i, j in zip(self.at, self.at[1:]):
            a = self.a[i:j]
            if last is None:
                a[:] = start
            else:
                np.matmul(last[: j - i], step, out=a)
            a *= self.e[i:j]
            z = np.matmul(a, one, out=self.z[i:j])
            a /= z[:, None]
            last = a
        self.carried = last


def expected_counts(model: Hmm, symbols: list[np.ndarray], run: int = RUN, kind=np.float32) -> np.ndarray:
    """Forward-backward over whole sequences: expected starts, steps and emissions (flat, in this order), then the log-likelihood. Vectors of run steps are held at once; both directions carry theirs across, so no step is left out."""
    s, m = model.emit.shape
    seqs = Sequences(symbols)
    start, step, emit = model.start.astype(kind), model.step.astype(kind), np.ascontiguousarray(model.emit.T, kind)
    firsts = list(range(0, seqs.longest, run))
    carried: list[np.ndarray | None] = [None]
    said, held = 0.0, None
    for first in firsts:
        held = Segment(start, step, emit, seqs, carried[-1], first, min(seqs.longest, first + run))
        said += float(np.log10(held.z, dtype=np.float64).sum())
        carried.append(held.carried)
    steps, emits = np.zeros((s, s)), np.zeros((s, m))
    beta, after = np.ones((len(symbols), s), kind), None
    back_step = np.ascontiguousarray(step.T)
    for k in range(len(firsts) - 1, -1, -1):
        seg = held or Segment(start, step, emit, seqs, carried[k], firsts[k], min(seqs.longest, firsts[k] + run))
        held = None
        gamma = np.empty_like(seg.a)
        for i, j in zip(seg.at[-2::-1], seg.at[:0:-1]):
            a = seg.a[i:j]
            if after is not None:
                n = len(after[1])
                back = after[0] * beta[:n]
                back /= after[1][:, None]
                steps += a[:n].T @ back
                np.matmul(back, back_step, out=beta[:n])
            np.multiply(a, beta[: j - i], out=gamma[i:j])
            after = seg.e[i:j], seg.z[i:j]
        for q in range(s):
            emits[q] += np.bincount(seg.symbols, gamma[:, q], m)
        starts = gamma[: seg.at[1]].sum(0, dtype=np.float64)
    return np.r_[starts, (model.step * steps).ravel(), emits.ravel(), said]


#: Bytes of sequences that a recursion takes side by side (a longer one is taken alone).
AT_ONCE = 600_000


def _together(symbols: list[bytes], at_once: int) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for raw in symbols:
        held.append(np.frombuffer(raw, np.uint16))
        size += len(raw)
        if size > at_once:
            yield held
            held, size = [], 0
    if held:
        yield held


def _added(model: Hmm, symbols: list[bytes], at_once: int = AT_ONCE) -> np.ndarray | None:
    """The sum of expected counts."""
    total = None
    for some in _together(symbols, at_once):
        got = expected_counts(model, some)
        total = got if total is None else total + got
    return total


def baum_welch(tokens: DataFrame, model: Hmm, rounds: int = ROUNDS, gain: float = GAIN) -> tuple[Hmm, list[float]]:
    """Re-estimate on all rows of tokens (symbols) until a round gains little; also the log10 likelihood before each round. The sums have a fixed number of cells."""
    s, m = model.emit.shape
    said: list[float] = []
    for _ in range(rounds):
        now = model

        def gather(it: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = None
            for b in it:
                got = _added(now, b.column("symbols").to_pylist())
                if got is not None:
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["cell", "v"])

        sums = tokens.select("symbols").mapInArrow(gather, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
        if not sums:
            break
        v = np.zeros(s + s * s + s * m + 1)
        for r in sums:
            v[r.cell] = r.v
        said.append(float(v[-1]))
        start, step, emit = v[:s] + 1, v[s : s + s * s].reshape(s, s) + 1, v[s + s * s : -1].reshape(s, m) + 0.01
        model = Hmm(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
        if len(said) > 1 and said[-1] - said[-2] < gain * abs(said[-2]):
            break
    return model, said


def likelihoods(model: Hmm, symbols: list[np.ndarray], run: int = RUN) -> np.ndarray:
    """log10 of each whole sequence's probability, by the scaled forward recursion over all sequences at once."""
    seqs = Sequences(symbols)
    out = np.zeros(len(symbols))
    emit, carried = np.ascontiguousarray(model.emit.T), None
    for first in range(0, seqs.longest, run):
        seg = Segment(model.start, model.step, emit, seqs, carried, first, min(seqs.longest, first + run))
        carried = seg.carried
        log = np.log10(seg.z)
        for i, j in zip(seg.at, seg.at[1:]):
            out[: j - i] += log[i:j]
    back = np.empty_like(out)
    back[seqs.order] = out
    return back


def hmm_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, common: int = COMMON, symbols: int = SYMBOLS) -> DataFrame:
    """Train on the training rows of docs (doc_id, text; other columns are ignored) and score every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the model's probability of the text).

    Tokens are words between ASCII white space, A-Z lower-cased, and one end token. base_score
    is the add-one unigram sum. A null or empty text is the end token alone; very long texts are
    whole sequences like all others. Ties between words go by their bytes. Repeated rows and
    ids are counted and scored each; an empty table gives an empty result.
    """
    counts = written(word_counts(docs.filter(is_training("doc_id"))), "word-counts")
    stats = word_stats(counts, common, symbols)
    # Sequences of like length stand together, which the recursions take side by side.
    tokens = written(tokenised(docs, stats).sortWithinPartitions("n_tokens"), "tokens")
    model, _ = baum_welch(tokens.filter("training"), first_model(stats, states), rounds)

    # Words beyond the common ones meet their counts in a shuffle by word.
    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([word_hash(w) for w in b.column("word").to_pylist()], pa.int64()), b.column("n")], ["word", "n"])

    rare_counts = counts.select("word", "n").mapInArrow(hashed, "word long, n long")
    pairs = tokens.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("p")).select("row", F.col("p.rare").alias("word"), F.col("p.rare_n").alias("k"))
    rare = pairs.join(rare_counts, "word").groupBy("row").agg(F.sum("k").alias("known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("log"))

    def forward(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = [x for some in _together(b.column("symbols").to_pylist(), AT_ONCE // 2) for x in likelihoods(model, some).tolist()]
            names = [n for n in b.schema.names if n != "symbols"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(out, pa.float64())], [*names, "path"])

    scored = tokens.select("row", "doc_id", "training", "n_tokens", "n_known", "base", "inside", "symbols").mapInArrow(forward, "row long, doc_id long, training boolean, n_tokens long, n_known long, base double, inside double, path double")
    log, known = F.coalesce("log", F.lit(0.0)), F.coalesce("known", F.lit(0))
    whole = float(np.log10(stats.tokens + stats.types + 1))
    return scored.join(rare, "row", "left").select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(stats.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("path") + F.col("inside") + log).alias("score"),
    )
