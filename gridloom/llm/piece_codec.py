"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The words of many texts lie side by side in flat numpy arrays of symbols. In each round every
word takes the pair of neighbours with its best rank and merges all places of that pair at once,
from the left; the arrays are compacted, words without a pair leave, until none is left. A pair
whose merge could make room for a better or equal one is merged at one place a round, so the
result is that of merging one pair at a time. Characters outside the vocabulary become bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for a space in the vocabulary.
SPACE = "▁"
#: New words that meet in one call of the merge rounds (about), and words that a task remembers; its memory starts anew when full.
ROUND_WORDS, MEMO_WORDS = 50_000, 400_000
#: Characters of texts whose words are looked up together.
CHUNK_CHARS = 1 << 22
NEVER = np.iinfo(np.int32).max
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PairTable:
    """(left symbol, right symbol) -> merged symbol, -1 for none; open addressing in numpy arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * max(1, len(pairs))).bit_length())
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        key = np.array([a << 32 | b for a, b in pairs], np.int64)
        value = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(key)
        while len(key):
            free = self.key[slot] < 0
            self.key[slot[free]] = key[free]  # of several keys for one slot the last stays
            placed = self.key[slot] == key
            self.value[slot[placed]] = value[placed]
            key, value, slot = key[~placed], value[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        known = (left >= 0) & (right >= 0)
        key = np.where(known, left.astype(np.int64) << 32 | right, -2)
        out, slot, open_ = np.full(len(key), -1, np.int32), self._slot(key), np.flatnonzero(known)
        while len(open_):
            s = slot[open_]
            found = self.key[s]
            hit = found == key[open_]
            out[open_[hit]] = self.value[s[hit]]
            open_ = open_[~hit & (found >= 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out


class PieceModel:
    """The vocabulary of a SentencePiece BPE model file. Raises ValueError for models of another kind: other normalisation than a space put before the text, no byte pieces, pieces across words."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        piece = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        plain = {piece[i]: i for i in range(n) if not special[i] and not sp.is_unused(i)}
        probe = "  Aﬁ ①  z\t\n é "
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE) or any(sp.is_unused(i) for i in range(n)) or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in plain):
            raise ValueError("the model normalises texts, has unused pieces or has pieces across words")
        self.byte = np.zeros(256, np.int32)
        of_byte = {int(piece[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        if len(of_byte) != 256:
            raise ValueError("the model has no piece for every byte")
        self.byte[list(of_byte)] = list(of_byte.values())
        # The best score has rank 0; equal scores share a rank.
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.of_char = np.full(0x110000, -1, np.int32)
        pairs, near = {}, set()
        #: Pieces to merge at one place a round: a longer piece that begins or ends with one is no worse, or an equal rank exists.
        self.one_by_one = np.bincount(self.rank, minlength=n)[self.rank] > 1
        for p, i in plain.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
            near.update(zip(p, p[1:]))
            for k in range(1, len(p)):
                a, b = plain.get(p[:k]), plain.get(p[k:])
                for part in (a, b):
                    if part is not None and self.rank[i] <= self.rank[part]:
                        self.one_by_one[part] = True
                if a is not None and b is not None:
                    pairs[a, b] = i
        self.pairs = PairTable(pairs)
        #: Characters that stand side by side in some piece; between others no merge ever reaches.
        self.near = PairTable({(ord(a), ord(b)): 1 for a, b in near})
        self.text_of = [piece[i].replace(SPACE, " ").encode() for i in range(n)]
        for i in range(n):
            if sp.is_control(i):
                self.text_of[i] = b""
            elif sp.is_unknown(i):
                self.text_of[i] = " ⁇ ".encode()
        for b, i in of_byte.items():
            self.text_of[i] = bytes([b])
        self.is_byte = frozenset(of_byte.values())
        self.leads = [p.startswith(SPACE) and not s for p, s in zip(piece, special)]
        self.digits = list(map(str, range(n)))
        self.memo: dict[str, tuple[int, ...]] = {}

    def merged(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word, by merge rounds over all of them."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.cumsum([0, *map(len, words)])
        begins = np.zeros(len(code), bool)
        begins[first[:-1]] = True
        begins[1:] |= self.near(code[:-1], code[1:]) < 0
        sym, pos, seg = self.of_char[code], np.arange(len(code)), np.cumsum(begins) - 1
        made = np.full(len(sym), -1, np.int32)  # the piece that a symbol and the next one of its segment make

        def make(at: np.ndarray) -> None:
            at = at[at < len(sym) - 1]
            same = seg[at] == seg[at + 1]
            made[at] = np.where(same, self.pairs(sym[at], sym[at + 1]), -1)

        make(np.arange(len(sym)))
        out_sym, out_pos = [], []
        while len(sym):
            rank = np.where(made >= 0, self.rank[made], NEVER)
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            done = best == NEVER
            if done.any():
                out_sym.append(sym[done])
                out_pos.append(pos[done])
                sym, pos, seg, made, rank, best = (a[~done] for a in (sym, pos, seg, made, rank, best))
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best)
            # In a run of overlapping places every second one merges, from the left.
            head = np.r_[True, np.diff(hit) > 1]
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(head, np.arange(len(hit)), 0))
            lead = np.r_[True, seg[hit[1:]] != seg[hit[:-1]]]
            hit = hit[lead | ((nth % 2 == 0) & ~self.one_by_one[made[hit]])]
            sym[hit] = made[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, pos, seg, made = sym[keep], pos[keep], seg[keep], made[keep]
            at = hit - np.arange(len(hit))
            made[at] = -1
            fresh = np.zeros(len(sym), bool)
            fresh[at] = True
            fresh[at[at > 0] - 1] = True
            make(np.flatnonzero(fresh))
        sym, pos = (np.concatenate(out_sym), np.concatenate(out_pos)) if out_sym else (sym, pos)
        order = np.argsort(pos)
        sym, pos = sym[order], pos[order]
        cut = np.searchsorted(pos, first)
        odd = np.flatnonzero(sym < 0)
        if len(odd):
            # A character without a piece becomes its bytes.
            data = [chr(c).encode("utf-8", "surrogatepass") for c in code[pos[odd]].tolist()]
            many = np.ones(len(sym) + 1, np.int64)
            many[odd] = list(map(len, data))
            start = np.cumsum(many) - many
            ids = np.empty(start[-1], np.int32)
            ids[start[:-1]] = sym
            ids[np.concatenate([np.arange(len(d)) + start[k] for d, k in zip(data, odd.tolist())])] = self.byte[np.frombuffer(b"".join(data), np.uint8)]
            sym, cut = ids, start[cut]
        ids, cut = sym.tolist(), cut.tolist()
        return [tuple(ids[a:b]) for a, b in zip(cut, cut[1:])]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text. Words that the task knows are looked up, new ones merged in rounds."""
        for some in in_chunks(texts):
            lists = [WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in some]
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            new = [w for w in set(chain.from_iterable(lists)) if w not in self.memo]
            for k in range(0, len(new), ROUND_WORDS):
                part = new[k : k + ROUND_WORDS]
                self.memo.update(zip(part, self.merged(part)))
            for words in lists:
                yield list(chain.from_iterable(map(self.memo.__getitem__, words)))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: one leading space goes, bytes that are no UTF-8 become U+FFFD one by one; control ids have no text."""
        data = b"".join(map(self.text_of.__getitem__, ids))
        first = next((i for i in ids if self.text_of[i]), None)
        if first is not None and self.leads[first]:
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data.decode("utf-8", "each_byte")


def _each_byte(e: UnicodeDecodeError) -> tuple[str, int]:
    return "�", e.start + 1


def in_chunks(texts: Iterable[str]) -> Iterator[list[str]]:
    """Runs of texts of about CHUNK_CHARS characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """The model of a file, read once by a Python worker."""
    import codecs

    codecs.register_error("each_byte", _each_byte)
    return PieceModel(path)


def _mapped(docs: DataFrame, schema: str, fields: pa.Schema, rows) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(values), 1000):
                columns = list(zip(*rows(values[at : at + 1000]))) or [()] * (len(fields) - 1)
                yield pa.RecordBatch.from_arrays([keys.slice(at, 1000).cast(fields.field(0).type), *[pa.array(c, f.type) for c, f in zip(columns, list(fields)[1:])]], schema=fields)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) for each row of docs (doc_id, text; other columns are ignored), as the sentencepiece library encodes with the model file, without begin and end ids. A null or empty text has none; repeated rows each have their row."""
    rows = lambda texts: ((ids,) for ids in piece_model(path).encode([t or "" for t in texts]))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _mapped(own, "doc_id long, ids array<int>", pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]), rows)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text for each row of encoded (doc_id, ids); null ids are none."""
    rows = lambda lists: ((piece_model(path).decode(ids or []),) for ids in lists)
    own = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return _mapped(own, "doc_id long, text string", pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), rows)


def piece_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the text decoded from the ids), a row for each row of docs; see encode and decode. Texts are encoded whole, whatever their length; an empty table gives an empty result."""

    def rows(texts: list[str | None]) -> Iterator[tuple]:
        model = piece_model(path)
        for ids in model.encode([t or "" for t in texts]):
            yield len(ids), hashlib.sha256(",".join(map(model.digits.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fields = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _mapped(own, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", fields, rows)
