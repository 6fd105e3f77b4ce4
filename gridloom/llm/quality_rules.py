"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

The field is trained on a bounded sample of labelled documents. Their lines have weak labels of
their own: repeated, symbol-heavy, menu-like and shouted lines are boilerplate in any document,
the other lines of a good document are content, prose lines of a bad one too, and its remaining
lines stay open, summed over in training. Viterbi decoding labels the lines of every text; a
document is kept if its content lines hold a sufficient share of its characters and the base
rules pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowkit import LOWER, UPPER, binary_list

#: Labelled documents that the field is trained on, at most (those whose ids hash lowest, one row of each), and lines of each.
MAX_TRAINING_DOCS, MAX_TRAINING_LINES = 2000, 200
#: Share of word characters in content lines that keeps a document.
MIN_CONTENT = 0.3
# Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WIDTH = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
DIGITS = b"0123456789"
#: Words of a line that are enough to tell prose and repetition by.
MANY = 8

N_FEATURES = 10
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, n_content_lines long, n_lines long, kept boolean"
STATS_ARROW = [(n.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[n.split()[1]]) for n in STATS.split(", ")]


@dataclass
class LineField:
    """Weights of a two-state chain: state 1 is content, 0 boilerplate. Untrained, every line is content."""

    emit: np.ndarray = field(default_factory=lambda: np.r_[np.zeros(N_FEATURES), 1.0])
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi: the likeliest labels of one text's lines; x: lines by features."""
        s = x @ self.emit
        n = len(s)
        (t00, t01), (t10, t11) = self.step.tolist()
        back = bytearray(2 * n)
        a, b = 0.0, float(s[0])
        for i, e in enumerate(s.tolist()[1:], 1):
            p, q = a + t00, b + t10
            u, v = a + t01, b + t11
            back[2 * i], back[2 * i + 1] = q > p, v >= u
            a, b = (q if q > p else p), (v if v >= u else u) + e
        out = np.empty(n, bool)
        at = int(b >= a)
        for i in range(n - 1, -1, -1):
            out[i] = at
            at = back[2 * i + at]
        return out


def line_features(lines: list[bytes], seen_before: list[bool]) -> np.ndarray:
    """A row of N_FEATURES values and a constant for each line."""
    rows = []
    for line, seen in zip(lines, seen_before, strict=True):
        words = line.split()
        n, size = len(words), len(line) or 1
        letters = size - len(line.translate(None, UPPER))
        small = size - len(line.translate(None, LOWER))
        symbols = size - len(line.translate(None, SYMBOLS))
        distinct = len(set(words)) / (n + 1)
        rows.append((
            min(n, 50) / 50, 3 * letters / (letters + small + 1), 3 * min(1.0, 4 * symbols / (n + 1)), 3 * min(1.0, 2 * line.count(b"!") / (n + 1)), (size - len(line.translate(None, DIGITS))) / size,
            float(line.count(b"|") > 0), float(line.rstrip()[-1:] in (b".", b"?")), 3 * float(seen), 3 * (1 - distinct) * (n >= MANY), min(size / (n + 1), 20) / 20, 1.0,
        ))
    return np.array(rows, float).reshape(-1, N_FEATURES + 1)


def _lines(text: bytes) -> tuple[list[bytes], list[bool]]:
    """Lines with a word, and whether each equals an earlier one."""
    seen: set[bytes] = set()
    lines = [x for x in text.split(b"\n") if x.strip()]
    before = []
    for x in lines:
        before.append(x in seen)
        seen.add(x)
    return lines, before


def weak_labels(lines: list[bytes], seen_before: list[bool], good: bool) -> list[int]:
    """For each line 1 (content), 0 (boilerplate) or -1 (open)."""
    out = []
    for line, seen in zip(lines, seen_before, strict=True):
        words = line.split()
        n = len(words)
        symbols = len(line) - len(line.translate(None, SYMBOLS))
        upper = len(line) - len(line.translate(None, UPPER))
        lower = len(line) - len(line.translate(None, LOWER))
        if seen or 4 * symbols >= n or 2 * line.count(b"!") >= n or (n > 3 and upper > lower) or (n >= MANY and 2 * len(set(words)) < n):
            out.append(0)
        elif good or (n >= MANY and not symbols and line.rstrip()[-1:] in (b".", b"?")):
            out.append(1)
        else:
            out.append(-1)
    return out


def repeated_words(words: list[bytes], width: int = REPEAT_WIDTH) -> int:
    """Words in runs of width words that the text holds twice or more. Ranks of runs are doubled in length, so equality is exact."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    held = 1
    while held < width:
        more = min(held, width - held)
        rank = rank[: len(rank) - more] * (int(rank.max()) + 1) + rank[more:]
        found, rank = np.unique(rank, return_inverse=True)
        if len(found) == len(rank):
            return 0
        held += more
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[width : width + n] -= again
    return int((np.cumsum(edge) > 0).sum())


def measures(text: bytes, model: LineField, min_content: float = MIN_CONTENT) -> tuple:
    """The values of STATS for one text."""
    words = text.split()
    n = len(words)
    tail = int(((np.frombuffer(text, np.uint8) & 0xC0) == 0x80).sum())
    lines, before = _lines(text)
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    share, content = 0.0, 0
    if lines:
        label = model.decode(line_features(lines, before))
        size = np.array([len(x) for x in lines], float)
        share, content = float(size[label].sum() / size.sum()), int(label.sum())
    return (n, sum(map(len, words)) - tail, len(text) - len(text.translate(None, SYMBOLS)), sum(before), repeats, failed, share, content, len(lines), not failed and share >= min_content)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS, rounds: int = 120, rate: float = 0.1, max_lines: int = MAX_TRAINING_LINES) -> LineField:
    """Fit the field on at most max_docs labelled documents and max_lines lines of each (documented bounds; the rest of the operator reads every row whole). labels: doc_id, quality (1 good, 0 bad; of a repeated doc_id the largest). Null ids and texts have no lines. Without lines of both kinds the untrained field is returned."""
    chosen = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)

    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            xs, ys = [], []
            for text, good in zip(binary_list(b.column("text")), b.column("quality").to_pylist(), strict=True):
                lines, before = (v[:max_lines] for v in _lines(text))
                xs.append(line_features(lines, before).ravel().tolist())
                ys.append(weak_labels(lines, before, good == 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.list_(pa.int32()))], ["doc_id", "x", "y"])

    # At most max_docs ids are broadcast, and a row for each comes back.
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(features, "doc_id long, x array<double>, y array<int>")
    sample = met.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("r.x", "r.y").collect()
    return fit([(np.array(r.x).reshape(-1, N_FEATURES + 1), np.array(r.y)) for r in sample if r.x], rounds, rate)


def _expected(s: np.ndarray, step: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray, live: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Expected labels of all lines and expected steps, for scores s (lines, 2) of texts in order of falling length."""
    alpha, beta = s.copy(), np.zeros_like(s)
    for t in range(1, size[0]):
        i = start[: live[t]] + t
        alpha[i] += np.logaddexp.reduce(alpha[i - 1][:, :, None] + step, 1)
    for t in range(size[0] - 1, 0, -1):
        i = start[: live[t]] + t
        beta[i - 1] = np.logaddexp.reduce((beta[i] + s[i])[:, None, :] + step, 2)
    z = np.repeat(np.logaddexp.reduce(alpha[start + size - 1], 1), size)
    p = np.exp(alpha + beta - z[:, None])
    pair = np.exp(alpha[at - 1][:, :, None] + step + (beta[at] + s[at])[:, None, :] - z[at][:, None, None]).sum(0)
    return p[:, 1], pair


def fit(sample: list[tuple[np.ndarray, np.ndarray]], rounds: int, rate: float) -> LineField:
    """Gradient ascent on the likelihood of the labels that are known (y of 0 or 1; -1 is open), from (features, y) of texts: what the field expects with those labels held, less what it expects freely."""
    rows = sorted(sample, key=lambda r: (-len(r[0]), float(r[0].sum()), r[1].tolist()))
    model = LineField()
    if {0, 1} - {int(v) for _, y in rows for v in y}:
        return model
    x, y = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    size = np.array([len(r[0]) for r in rows])
    start = np.cumsum(size) - size
    # Documents in order of falling length: those with a line number t are the first live[t].
    live = [int((size > t).sum()) for t in range(size[0])]
    model.emit = np.zeros(N_FEATURES + 1)
    first = np.zeros(len(y), bool)
    first[start] = True
    at = np.nonzero(~first)[0]
    held = np.where(y[:, None] == np.array([1, 0]), -1e4, 0.0)
    m, v = np.zeros(N_FEATURES + 5), np.zeros(N_FEATURES + 5)
    for k in range(1, rounds + 1):
        s = np.stack([np.zeros(len(y)), x @ model.emit], 1)
        (known, known_steps), (free, free_steps) = (_expected(z, model.step, start, size, at, live) for z in (s + held, s))
        g = np.r_[x.T @ (known - free), (known_steps - free_steps).ravel()] / len(y) - 1e-3 * np.r_[model.emit, model.step.ravel()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        model.emit, model.step = model.emit + move[: N_FEATURES + 1], model.step + move[N_FEATURES + 1 :].reshape(2, 2)
    return model


def quality_rules(docs: DataFrame, model: LineField, min_content: float = MIN_CONTENT) -> DataFrame:
    """doc_id and the STATS columns, one row for each row of docs (doc_id, text; other columns are ignored).

    Words are runs of bytes other than ASCII white space. base_failed: under 20 words, or over
    30 % of the words in 8-word runs found twice or more. content_share: of the characters of
    lines with a word, those in content lines (0 without such lines). kept: not base_failed and
    a content_share of min_content or more. Ties between labels go to content. A null or empty
    text has no words and fails; very long texts are decoded whole; repeated rows and ids each get
    their own row; an empty table gives an empty result.
    """

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            made = [measures(t, model, min_content) for t in binary_list(b.column("text"))]
            cols = [pa.array(c, t) for c, (_, t) in zip(zip(*made) if made else [()] * len(STATS_ARROW), STATS_ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", *(n for n, _ in STATS_ARROW)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, f"doc_id long, {STATS}")


def keep_good(docs: DataFrame, model: LineField, min_content: float = MIN_CONTENT) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns, in one narrow pass: null, empty and repeated rows, very long texts and empty tables as there."""
    schema = docs.schema

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.filter(pa.array([measures(t, model, min_content)[-1] for t in binary_list(b.column("text"))], pa.bool_()))

    return docs.mapInArrow(keep, schema)
