"""Token ids as length-delimited binary records, with a separate offset index.

A file holds records one after another, each framed as
    8 bytes   length of the payload, little-endian
    4 bytes   masked CRC-32 of those 8 bytes
    payload   doc_id (8 bytes, signed), id width in bytes (1 byte), ids little-endian
    4 bytes   masked CRC-32 of the payload
The index has a row for each record: file, offset, size, doc_id and n_tokens, so that a reader
can fetch records in any order, or cut files into parts that tasks read side by side. Names of
files ascend with the records. A task writes under a name of its own and renames the file when
it is whole; the name is in the index, so a file of a lost attempt is never read.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrowkit import batches
from .common import id_of, key_of, scratch_path, written

#: Id that ends each document.
END_ID = 0
#: Pieces that a worker remembers; it starts anew when full.
MEMO_PIECES = 1_500_000
#: New pieces that go through the tokenizer in one call.
JOINED_PIECES = 200
#: A task begins a new file beyond FILE_BYTES; a reading task takes about PART_BYTES.
FILE_BYTES, PART_BYTES = 128 << 20, 16 << 20
INDEX = pa.schema([("key", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("n_tokens", pa.int64())])
READ = pa.schema([("key", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(key: int, ids: np.ndarray) -> bytes:
    body = struct.pack("<qB", key, ids.dtype.itemsize) + ids.tobytes()
    head = struct.pack("<Q", len(body))
    return b"".join((head, struct.pack("<I", masked(head)), body, struct.pack("<I", masked(body))))


def read_frame(f) -> tuple[int, np.ndarray] | None:
    """The next record of an open file; None at its end. A record that is cut or fails a checksum raises ValueError."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("a record's length is damaged")
    n = struct.unpack("<Q", head[:8])[0]
    body = f.read(n + 4)
    if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked(body[:n]):
        raise ValueError("a record's payload is damaged")
    key, width = struct.unpack_from("<qB", body)
    return key, np.frombuffer(body[9:n], f"<u{width}")


class ByteEncoder:
    """Ids as tokenizers gives them, with the pieces between single spaces remembered.

    The byte-level pattern always cuts before a space that follows other than white space and
    comes before other than white space, so those pieces encode on their own, and many of them
    in one string: the tokens that begin with a space tell where each piece begins. Texts in
    which a space stands inside a longer run of white space, or that hold the text of an added
    token, go to the tokenizer whole.
    """

    uneven = re.compile(r"\s (?=\s|$)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if n <= 1 << 16 else np.uint32
        # The byte-level alphabet writes a space as U+0120.
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(n)])
        self.memo = {"": self.encode_whole([" "])[0]}

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids, as bytes, of each piece after a space; pieces are not empty and hold no space."""
        size = np.dtype(self.dtype).itemsize
        out: list[bytes] = []
        joined = [" " + " ".join(pieces[i : i + JOINED_PIECES]) for i in range(0, len(pieces), JOINED_PIECES)]
        for i, e in enumerate(self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            data = ids.tobytes()
            at = (np.flatnonzero(self.spaced[ids]) * size).tolist()
            if len(at) != min(JOINED_PIECES, len(pieces) - i * JOINED_PIECES):
                raise ValueError("the pieces are not separable")
            out += [data[x:y] for x, y in zip(at, [*at[1:], len(data)], strict=True)]
        return out

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.memo) > MEMO_PIECES:
            self.memo = {"": self.encode_whole([" "])[0]}
        held: dict[int, list[str]] = {}
        need: set[str] = set()
        for i, t in enumerate(texts):
            if not (self.uneven.search(t) or any(a in t for a in self.added)):
                pieces = held[i] = t.split(" ")
                need.update(set(pieces[1:]).difference(self.memo))
        new = list(need)
        self.memo.update(zip(new, self.encode_pieces(new), strict=True))
        # The first piece of a text has no space before it.
        first = self.encode_whole([x[0] for x in held.values()])
        get = self.memo.__getitem__
        out = {i: b"".join([f, *map(get, x[1:])]) for (i, x), f in zip(held.items(), first, strict=True)}
        whole = [i for i in range(len(texts)) if i not in held]
        out |= zip(whole, self.encode_whole([texts[i] for i in whole]))
        return [np.frombuffer(out[i], self.dtype) for i in range(len(texts))]

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    """One for each worker, which keeps its memory from task to task."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def _files(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url)


def write_records(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID, make: Callable = encoder, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode docs (doc_id, text; other columns are ignored), append end_id to each and write the records to folder in ascending doc_id order: each file holds a range of ids, and a task begins a new one beyond file_bytes. Returns the index, which is itself written beside the files.

    A null text counts as empty and has only end_id; a null doc_id sorts first. Rows that repeat
    a doc_id each get a record, in the order of their texts' hashes, and may go to several
    tasks. A very long text is one record. An empty table gives an empty index. The folder is a
    URL; by default a new one in spark.checkpoint.dir.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-records")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    order = ("key", "h", "salt")
    # The salt lets equal rows be dealt to several tasks; their records are equal, so their order is not told apart.
    dealt = docs.select(key_of().alias("key"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("salt"), text.alias("text")).repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "text")

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _files(folder)
        store.create_dir(root)
        nth, f, name, at, rows = 0, None, "", 0, []
        for b in it:
            for part in range(0, b.num_rows, 1000):
                some = b.slice(part, 1000)
                keys = some.column("key").to_pylist()
                for key, ids in zip(keys, make(tokenizer_path).encode_texts(some.column("text").to_pylist()), strict=True):
                    if f is None:
                        name, at = f"{TaskContext.get().partitionId():06d}-{nth:06d}-{uuid.uuid4().hex}.records", 0
                        f = store.open_output_stream(f"{root}/.{name}")
                    data = frame(key, np.append(ids, ids.dtype.type(end_id)))
                    f.write(data)
                    rows.append((key, name, at, len(data), len(ids) + 1))
                    at += len(data)
                    if at >= file_bytes:
                        f.close()
                        store.move(f"{root}/.{name}", f"{root}/{name}")
                        f, nth = None, nth + 1
            yield from batches(rows, INDEX)
            rows = []
        if f is not None:
            f.close()
            store.move(f"{root}/.{name}", f"{root}/{name}")

    index = dealt.mapInArrow(write, "key long, file string, offset long, size long, n_tokens long")
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index").withColumn("folder", F.lit(folder))


def read_records(spark: SparkSession, index: DataFrame, folder: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Read all records that the index names and check all frames: key, file, offset, n_tokens, ids_crc32 for each. The index cuts files into parts of about part_bytes, which are dealt out to a task each."""
    parts = written(index.groupBy("file", F.expr(f"offset div {part_bytes}").alias("part")).agg(F.min("offset").alias("first"), F.max(F.col("offset") + F.col("size")).alias("end")), "record-parts")

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _files(folder)

        def rows():
            for b in it:
                for name, at, end in zip(*(b.column(c).to_pylist() for c in ("file", "first", "end")), strict=True):
                    with store.open_input_file(f"{root}/{name}") as f:
                        f.seek(at)
                        data = io.BytesIO(f.read(end - at))
                    while at < end:
                        got = read_frame(data)
                        if got is None:
                            raise ValueError("a file is shorter than its index")
                        key, ids = got
                        yield key, name, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                        at += 16 + 9 + ids.nbytes

        yield from batches(rows(), READ)

    # Dealt in turn, which no other exchange can stand for and adaptive execution does not merge.
    return parts.select("file", "first", "end").repartition(max(1, parts.count())).mapInArrow(read, "key long, file string, offset long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write docs as records and read the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file, offset for each row of docs. See write_records for nulls, repeats, very long texts and empty tables."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-records")
    index = write_records(docs, tokenizer_path, folder, end_id, file_bytes=file_bytes)
    got = written(read_records(spark, index, folder, part_bytes), "records-read")
    # A row for each file, not for each document. Names ascend with the records.
    files = got.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1))
    start = (F.col("base") + F.coalesce(inside, F.lit(0))).alias("start")
    return got.join(files, "file").select(id_of().alias("doc_id"), start, "n_tokens", "ids_crc32", "file", "offset")
