"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash cuts each text's bytes into chunks whose places depend on their content only, so
documents that share a passage share its chunks. Chunks are counted over all documents by their
digests; each one that occurs again is encoded once, wherever its places are, and its ids are
joined back by digest (of the most frequent ones, a bounded number, every task encodes its own,
once). A cut may fall inside a word, so every join of two chunks is repaired: a window of text
around it is encoded anew, and widened until the ids at both of its ends agree with those of the
chunks.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowkit import binary_list
from .common import written
from .joined_bpe import JoinedBpe

#: A chunk has so many bytes on average (a power of two).
CHUNK_BYTES = 512
#: Whole words at each end of a chunk that a window may take in.
EDGE = 2
#: A worker's memory of words starts anew when it holds so many; digests that a task counts before it passes them on; texts taken at once.
MEMO_WORDS, MEMO_DIGESTS, TEXTS = 400_000, 400_000, 1000
#: Chunks that occur again are told by so many bits of their digests; one that shares them with such a chunk goes the same way.
SHARED_BITS = 26
#: The most frequent chunks, so many at most, are known to every task, which encodes each of them once itself; texts that repeat no other chunk are then not shuffled.
POPULAR, BINS = 16_384, 64
_SPACES = b" \t\n\x0b\x0c\r"
# Fixed value: how the pre-tokenizer splits.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile(r"[\x21-\u024F]*")
_TABLE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def cuts(text: bytes, average: int = CHUNK_BYTES) -> list[int]:
    """Ends of the chunks: a hash of the last 16 bytes rolls over the text and cuts where its upper bits are zero."""
    h = _TABLE[np.frombuffer(text, np.uint8)]
    for width in (1, 2, 4, 8):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    bits = average.bit_length() - 1
    ends = (np.nonzero((h >> np.uint32(32 - bits)) == 0)[0] + 1).tolist()
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    return ends


def chunks_of(text: bytes, average: int) -> list[bytes]:
    ends = cuts(text, average) if text else []
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def bucket_of(digest: bytes) -> int:
    return int.from_bytes(digest[:4], "big") >> (32 - SHARED_BITS)


class Piece:
    """An encoded chunk: the cut words at its ends (head, tail), EDGE whole words inside each (first, last), and the ids between. One of too few words is held as its text."""

    __slots__ = ("text", "head", "first", "words", "ids", "last", "tail")

    def __init__(self, data: bytes | None = None):
        self.text = self.ids = None
        if data is None:
            return
        words = data.split()
        self.head = words.pop(0) if words and data[0] not in _SPACES else b""
        self.tail = words.pop() if words and data[-1] not in _SPACES else b""
        if len(words) < 2 * EDGE:
            self.text = data
        else:
            self.first, self.words, self.last = words[:EDGE], words[EDGE:-EDGE], words[-EDGE:]

    def packed(self) -> tuple[bytes | None, bytes | None, bytes]:
        if self.text is not None:
            return None, None, self.text
        return b" ".join([self.head, *self.first]), b" ".join([*self.last, self.tail]), self.ids

    @classmethod
    def unpacked(cls, head: bytes | None, tail: bytes | None, ids: bytes) -> Piece:
        p = cls()
        if head is None:
            p.text = ids
        else:
            p.head, *p.first = head.split(b" ")
            *p.last, p.tail = tail.split(b" ")
            p.ids = ids
        return p


class ChunkCodec:
    """Encodes and decodes by a tokenizer that drops white space before it splits."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        if t.decoder is not None:
            raise ValueError("the tokenizer's decoder is not a plain join")
        n = t.get_vocab_size(with_added_tokens=True)
        if n > 1 << 16:
            raise ValueError("ids are held in 16 bits")
        self.token = [t.id_to_token(i) or "" for i in range(n)]
        self.number = [str(i) for i in range(n)]
        self.joined = JoinedBpe(t)
        self.parts: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        #: Chunks that this worker has encoded, for tests.
        self.n_encoded = 0

    def learn(self, words: set[bytes]) -> None:
        """Encode new words."""
        plain, rest = {}, []
        for w in words:
            text = w.decode()
            # Below U+0250 every character is in normal form and lower-cases on its own; the rest and added tokens go to the tokenizer.
            if _PLAIN.fullmatch(text) and "<|" not in text:
                plain[w] = _SPLIT.findall(text.lower())
            else:
                rest.append((w, text))
        if len(self.parts) > MEMO_WORDS:
            self.parts = {}
        parts = list({p for x in plain.values() for p in x if p not in self.parts})
        self.parts.update(zip(parts, self.joined.encode(parts, np.uint16), strict=True))
        for w, x in plain.items():
            self.words[w] = self.parts[x[0]] if len(x) == 1 else b"".join([self.parts[p] for p in x])
        self.words.update(zip([w for w, _ in rest], self.whole([x for _, x in rest]), strict=True))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint16).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_chunks(self, chunks: list[bytes]) -> list[Piece]:
        if len(self.words) > MEMO_WORDS:
            self.words = {}
        pieces = [Piece(c) for c in chunks]
        need: set[bytes] = set()
        for p in pieces:
            if p.text is None:
                need.update(p.words)
        self.learn(need.difference(self.words))
        known = self.words.__getitem__
        for p in pieces:
            if p.text is None:
                p.ids, p.words = b"".join(map(known, p.words)), None
        self.n_encoded += len(chunks)
        return pieces

    def repair(self, windows: list[tuple[list[bytes], bytes, list[bytes]]]) -> list[bytes]:
        """The ids of windows: whole words of the chunk before, the bytes between, whole words of the chunk after."""
        self.learn({w for left, _, right in windows for w in (*left, *right) if w not in self.words})
        known = self.words.__getitem__
        repaired: list[bytes | None] = [None] * len(windows)
        for width in range(1, EDGE + 1):
            open_ = [i for i, r in enumerate(repaired) if r is None]
            if not open_:
                break
            made = self.whole([b" ".join([*windows[i][0][-width:], windows[i][1], *windows[i][2][:width]]).decode() for i in open_])
            for i, ids in zip(open_, made, strict=True):
                left, _, right = windows[i]
                # The word at each end of the window must have the ids that its chunk gave it.
                a = known(left[-width]) if left else b""
                z = known(right[width - 1]) if right else b""
                if len(a) + len(z) <= len(ids) and ids.startswith(a) and ids.endswith(z):
                    repaired[i] = b"".join([*map(known, left[:-width]), ids, *map(known, right[width:])])
        if None in repaired:
            raise ValueError("a join of chunks does not come to agree: this tokenizer's words depend on each other")
        return repaired

    def join(self, texts: list[list[Piece]]) -> list[np.ndarray]:
        """The ids of texts from their chunks' pieces."""
        windows: list[tuple[list[bytes], bytes, list[bytes]]] = []
        plans: list[list] = []
        for pieces in texts:
            plan, left, held = [], [], b""
            for p in pieces:
                if p.text is not None:
                    held += p.text
                    continue
                plan += [len(windows), p.ids]
                windows.append((left, held + p.head, p.first))
                left, held = p.last, p.tail
            if left or held:
                plan.append(len(windows))
                windows.append((left, held, []))
            plans.append(plan)
        repaired = self.repair(windows)
        return [np.frombuffer(b"".join([repaired[x] if isinstance(x, int) else x for x in plan]), np.uint16) for plan in plans]

    def fuse(self, runs: list[list[Piece]]) -> list[list[Piece]]:
        """Each run of neighbouring pieces as few pieces: those between its first and last one of enough words become one."""
        windows: list[tuple[list[bytes], bytes, list[bytes]]] = []
        plans = []
        for run in runs:
            at = [i for i, p in enumerate(run) if p.text is None]
            if len(at) < 2:
                plans.append((run, [], None))
                continue
            one, plan, held = Piece(), [run[at[0]].ids], b""
            one.head, one.first, one.last, one.tail = run[at[0]].head, run[at[0]].first, run[at[-1]].last, run[at[-1]].tail
            left = run[at[0]]
            for p in run[at[0] + 1 : at[-1] + 1]:
                if p.text is not None:
                    held += p.text
                    continue
                plan += [len(windows), p.ids]
                windows.append((left.last, left.tail + held + p.head, p.first))
                left, held = p, b""
            plans.append(([*run[: at[0]], one, *run[at[-1] + 1 :]], plan, one))
        repaired = self.repair(windows)
        for _, plan, one in plans:
            if one is not None:
                one.ids = b"".join([repaired[x] if isinstance(x, int) else x for x in plan])
        return [run for run, _, _ in plans]

    def encode_texts(self, texts: list[bytes], average: int = CHUNK_BYTES) -> list[tuple[str, str]]:
        """For each text the ids and the decoded text, each as one string with a space after every token."""
        cut = [chunks_of(t, average) for t in texts]
        pieces = iter(self.encode_chunks([c for x in cut for c in x]))
        return [tuple(s + " " if len(ids) else s for s in self.said(ids)) for ids in self.join([[next(pieces) for _ in x] for x in cut])]

    def said(self, ids: np.ndarray) -> tuple[str, str]:
        """Decimal ids and tokens, each joined by a space."""
        held = ids.tolist()
        return " ".join(map(self.number.__getitem__, held)), " ".join(map(self.token.__getitem__, held))

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_texts([text.encode()])[0][0].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids)


_codecs: dict[str, ChunkCodec] = {}


def codec(path: str) -> ChunkCodec:
    """One for each worker, which keeps its memory from task to task."""
    if path not in _codecs:
        _codecs[path] = ChunkCodec(path)
    return _codecs[path]


def repeated_chunks(docs: DataFrame, average: int = CHUNK_BYTES, popular: int = POPULAR) -> tuple[np.ndarray, set[bytes]]:
    """Of chunks that occur again in docs (text): the buckets of their digests as bits, of a size that no input changes, and the digests of the most frequent ones, popular at most."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([bucket_of(d) for d in held], pa.int32()), pa.array(list(held.values()), pa.int64())], ["digest", "bucket", "n"])

        for b in it:
            for text in binary_list(b.column("text")):
                for c in chunks_of(text, average):
                    d = xxhash.xxh3_128_digest(c)
                    held[d] = held.get(d, 0) + 1
                if len(held) > MEMO_DIGESTS:
                    yield from flush()
                    held.clear()
        yield from flush()

    counts = docs.select("text").mapInArrow(count, "digest binary, bucket int, n long").groupBy("digest", "bucket").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = written(counts, "bpe-repeated")
    binned = counts.withColumn("bin", F.floor(F.log2("n") * BINS))
    left, least = popular, None
    for r in binned.groupBy("bin").agg(F.count("*").alias("v")).orderBy(F.desc("bin")).collect():
        left -= r.v
        if left < 0:
            break
        least = r.bin
    often = {bytes(r.digest) for r in binned.filter(F.col("bin") >= least).select("digest").collect()} if least is not None else set()
    # Bits in words of 4 KB, so that few rows come to the driver.
    block = 1 << 15

    def bits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            bucket = np.sort(b.column("bucket").to_numpy())
            for k in np.unique(bucket // block).tolist():
                w = np.zeros(block, np.uint8)
                w[bucket[bucket // block == k] % block] = 1
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(w, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    out = np.zeros((1 << SHARED_BITS) // 8, np.uint8)
    # Dealt by block, a partition gives a row for each of its blocks and batches.
    for r in counts.select("bucket").repartition(F.expr(f"bucket div {block}")).sortWithinPartitions("bucket").mapInArrow(bits, "block int, bits binary").collect():
        at = slice(r.block * block // 8, (r.block + 1) * block // 8)
        out[at] |= np.frombuffer(r.bits, np.uint8)
    return out, often


PIECES = "row long, doc_id long, pos int, digest binary, data binary, head binary, tail binary, ids binary, said struct<n_tokens:long,ids_sha256:string,decoded_sha256:string{more}>"


def _said(c: ChunkCodec, ids: np.ndarray, with_text: bool) -> dict:
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    numbers, tokens = c.said(ids)
    return {"n_tokens": len(ids), "ids_sha256": sha(numbers), "decoded_sha256": sha(tokens)} | ({"ids": ids.tolist(), "decoded": tokens} if with_text else {})


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, average: int = CHUNK_BYTES, with_text: bool = False) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256; with_text adds ids (array<int>) and decoded.

    docs: doc_id, text; other columns are ignored. A null or empty text has no tokens and an
    empty decoded text; very long texts are encoded whole. Repeated rows and ids each get their
    own row; an empty table gives an empty result. Texts without a repeated chunk are not shuffled.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    again, often = repeated_chunks(texts, average)
    more = ",ids:array<int>,decoded:string" if with_text else ""
    schema = PIECES.format(more=more)
    said = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * with_text)
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5, said]
    names = [x.split()[0] for x in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds, strict=True)], names)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without a repeated chunk are done; of the others every repeated chunk is a row, whose bytes a task sends once, and what lies between is encoded."""
        c = codec(tokenizer_path)
        sent: set[bytes] = set()
        popular: dict[bytes, Piece] = {}
        for whole in it:
            for part in range(0, whole.num_rows, TEXTS):
                b = whole.slice(part, TEXTS)
                held = [chunks_of(t, average) for t in binary_list(b.column("text"))]
                digests = [[xxhash.xxh3_128_digest(x) for x in chunks] for chunks in held]
                shared = [[d not in often and bool(again[(k := bucket_of(d)) // 8] >> (k % 8) & 1) for d in ds] for ds in digests]
                # A task encodes each popular chunk at its first place.
                here = [[(x, d) for x, d, s in zip(*y, strict=True) if not s] for y in zip(held, digests, shared, strict=True)]
                new = {d: x for y in here for x, d in y if d in often and d not in popular}
                popular.update(zip(new, c.encode_chunks(list(new.values())), strict=True))
                pieces = iter(c.encode_chunks([x for y in here for x, d in y if d not in popular]))
                found = [iter([popular[d] if d in popular else next(pieces) for _, d in y]) for y in here]
                out, done, runs, of_run = [], [], [], []
                for row, doc_id, chunks, ds, s, local in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), held, digests, shared, found, strict=True):
                    if not any(s):
                        done.append((row, doc_id, list(local)))
                        continue
                    run: list[Piece] = []
                    for i, (x, d, is_shared) in enumerate(zip(chunks, ds, s, strict=True)):
                        if not is_shared:
                            run.append(next(local))
                        if run and (is_shared or i == len(chunks) - 1):
                            runs.append(run)
                            of_run.append((row, doc_id, i - len(run) + (not is_shared)))
                            run = []
                        if is_shared:
                            if len(sent) > MEMO_DIGESTS:
                                sent.clear()
                            out.append((row, doc_id, i, d, None if d in sent else x, None, None, None, None))
                            sent.add(d)
                for (row, doc_id, at), fused in zip(of_run, c.fuse(runs), strict=True):
                    out += [(row, doc_id, at + i, None, None, *p.packed(), None) for i, p in enumerate(fused)]
                out += [(row, doc_id, None, None, None, None, None, None, _said(c, ids, with_text)) for (row, doc_id, _), ids in zip(done, c.join([p for _, _, p in done]), strict=True)]
                yield batch(out)

    made = written(texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, schema), "bpe-pieces", "zstd")

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for whole in it:
            for part in range(0, whole.num_rows, TEXTS):
                b = whole.slice(part, TEXTS)
                head, tail, ids = zip(*[p.packed() for p in c.encode_chunks(b.column("data").to_pylist())])
                yield pa.RecordBatch.from_arrays([b.column("digest"), *(pa.array(x, pa.binary()) for x in (head, tail, ids))], ["digest", "head", "tail", "ids"])

    # Each repeated chunk once.
    asked = made.filter("digest IS NOT NULL")
    codes = written(asked.groupBy("digest").agg(F.min("data").alias("data")).mapInArrow(encode, "digest binary, head binary, tail binary, ids binary"), "bpe-codes")
    columns = ("row", "doc_id", "pos", "head", "tail", "ids")
    pieces = asked.select("row", "doc_id", "pos", "digest").join(codes, "digest").select(*columns).unionByName(made.filter("digest IS NULL AND pos IS NOT NULL").select(*columns))

    def assemble(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        held: list[tuple[int, list[Piece]]] = []
        last = None

        def told(docs: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
            ids = c.join([p for _, p in docs])
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in docs], pa.int64()), pa.array([_said(c, x, with_text) for x in ids], said)], ["doc_id", "said"])

        for b in it:
            for row, doc_id, head, tail, ids in zip(*(b.column(x).to_pylist() for x in ("row", "doc_id", "head", "tail", "ids")), strict=True):
                if row != last:
                    if len(held) >= TEXTS:
                        yield told(held)
                        held = []
                    held.append((doc_id, []))
                    last = row
                held[-1][1].append(Piece.unpacked(head, tail, ids))
        if held:
            yield told(held)

    joined = pieces.repartition(n, "row").sortWithinPartitions("row", "pos").mapInArrow(assemble, f"doc_id long, said {schema.split(', ')[-1].split(' ', 1)[1]}")
    return made.filter("said IS NOT NULL").select("doc_id", "said").unionByName(joined).select("doc_id", "said.*")
