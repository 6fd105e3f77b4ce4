"""Removal of repeated byte passages by merging Burrows-Wheeler transforms.

Which 50-byte strings start in a document with a smaller id? Candidates are found without
loss by winnowing: every 50-byte window chooses the least hash among its 24-byte grams, so
equal windows choose equal grams, and only windows whose gram is met in another document go
on. Around each such gram a document contributes its context, the union of the windows that
chose it. Contexts meet by gram. Equal contexts are one, with their least key; where a gram has
several different contexts that can share a window (by the windows' hashes), these are cut into
shards, each shard gets its suffix order and its Burrows-Wheeler transform, and the transforms of
all shards are merged by refining their interleave symbol by symbol: after h passes the suffixes
of all shards stand in order of their first h bytes, without sorting them again, and blocks of
equal prefixes are known. After 50 passes the blocks are the repeated windows. A hot gram, one of
very many contexts, does not meet in one task: its contexts are cut into their windows, and these
meet by their bytes.

Rows are known by the hash of their text and their doc_id, never by their place in the table, so
a table whose files are split anew between two jobs gives the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowkit import binary_list, mixed
from .common import NULL_KEY, id_of, key_of, written

#: Bytes of a repeat, and of the grams that the windows choose from.
LENGTH, GRAM = 50, 24
#: Bytes of texts that are winnowed together, of contexts in a shard, and of contexts merged at once (up to twice as many where a gram begins late).
BLOCK, SHARD, MERGE = 2_000_000, 100_000, 600_000
#: A gram of more contexts is hot: it goes to many tasks, by its windows. Hot grams are told by HOT_BITS bits of their hashes; a gram that shares them goes the same way.
HOT, HOT_BITS = MERGE // (2 * LENGTH - GRAM), 22
#: Entries of a task's memory of hot windows, which starts anew when full, and contexts that a task holds before it compares them.
MEMO, HELD = 200_000, 60_000
#: Bytes of text for each partition, at most: a task holds what its partition's grams need.
PART_BYTES = 128 << 20
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM (16 + 8) bytes; len(data) >= GRAM."""
    h = _BYTES[data]
    held = {}
    width = 1
    for m in _MUL[:4]:
        h = h[:-width] * m + h[width:]
        width *= 2
        held[width] = h
    return mixed(held[16][: len(data) - GRAM + 1] * _MUL[4] + held[8][16 : 16 + len(data) - GRAM + 1])


def window_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all runs of LENGTH (32 + 16 + 2) bytes; len(data) >= LENGTH."""
    h = _BYTES[data]
    held = {}
    width = 1
    for m in _MUL:
        h = h[:-width] * m + h[width:]
        width *= 2
        held[width] = h
    n = len(data) - LENGTH + 1
    return mixed((held[32][:n] * _MUL[4] + held[16][32 : 32 + n]) * _MUL[0] + held[2][48 : 48 + n])


def winnow(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chosen grams of texts: text number, hash, first and last window (in the text) that chose it. Texts shorter than length have none."""
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.view(np.uint64), none, none
    g = gram_hashes(data)
    # Least of the upper bits, then the leftmost; BLOCK and longest texts bound the place's 32 bits.
    v = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    span = length - GRAM + 1
    width = 1
    while 2 * width <= span:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if width < span:
        v = np.minimum(v[: len(v) - (span - width)], v[span - width :])
    end = np.cumsum(size)
    start = end - size
    text = np.repeat(np.arange(len(texts)), np.maximum(size - length + 1, 0))
    n = np.maximum(size - length + 1, 0)
    window = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + start[text]
    place = (v[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(place):
        return none, none.view(np.uint64), none, none
    new = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])]
    first = np.nonzero(new)[0]
    last = np.r_[first[1:], len(place)] - 1
    t = text[first]
    return t, g[place[first]], window[first] - start[t], window[last] - start[t]


def blocks(rows: list[tuple], texts_at: int) -> Iterator[list[tuple]]:
    """Rows in groups of about BLOCK bytes of text."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[texts_at])
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def suffix_order(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's suffixes in order, by doubled ranks: for each its text, its place, and the symbol before it (byte + 1; 0 at a text's start). Every text ends with a mark, less than all bytes; equal suffixes stand in text order."""
    n = len(texts)
    size = np.array([len(t) + 1 for t in texts])
    end = np.cumsum(size)
    text = np.repeat(np.arange(n), size)
    mark = np.repeat(end - 1, size)
    at = np.arange(end[-1])
    symbol = np.zeros(end[-1], np.int64)
    symbol[at != mark] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    rank, width = symbol, 4
    for j in range(1, width):
        rank = rank * 257 + symbol[np.minimum(at + j, mark)]
    longest = int(size.max())
    while True:
        found, rank = np.unique(rank, return_inverse=True)
        if width >= longest or len(found) == len(rank):
            break
        rank = rank * len(found) + rank[np.minimum(at + width, mark)]
        width *= 2
    order = np.argsort(rank * n + text)
    start = end - size
    before = np.where(order == start[text[order]], 0, symbol[order - 1])
    return text[order], order - start[text[order]], before.astype(np.uint16)


#: Symbols that one pass of the refinement goes back.
STRIDE = 3


def merged_blocks(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int = LENGTH, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Merge the transforms of shards by interleave refinement. Returns the suffixes (numbered through all shards, in each shard's order) in order of their first length symbols, and each one's block of equal prefixes.

    A pass goes stride symbols back from every suffix at once, so it stands for as many passes
    of one symbol. A suffix shorter than the stride follows from no other; such ones enter every
    pass first, each as a block of its own, as if every text ended with marks of its own.
    """
    n_rows = [len(s[2]) for s in shards]
    base = np.cumsum([0, *n_rows])
    n_texts = [int(s[0].max()) + 1 for s in shards]
    text = np.concatenate([s[0] for s in shards]) + np.repeat(np.cumsum([0, *n_texts[:-1]]), n_rows)
    place = np.concatenate([s[1] for s in shards])
    before = np.concatenate([s[2] for s in shards]).astype(np.int32)
    # Only symbols that occur are numbered, in their order; the mark is 0.
    occurs = np.bincount(before, minlength=1) > 0
    occurs[0] = True
    before = (np.cumsum(occurs, dtype=np.int32) - 1)[before]
    base_of = int(occurs.sum())
    # A step back of one symbol: the k-th suffix with a symbol before it leads to the k-th suffix that begins with that symbol.
    back = np.empty(len(before), np.int32)
    for at, (_, _, sym) in zip(base, shards, strict=False):
        back[at + np.argsort(sym, kind="stable")] = at + np.arange(len(sym))
    size = np.zeros(sum(n_texts), np.int64)
    np.maximum.at(size, text, place)
    now, block = np.arange(len(before), dtype=np.int32), np.zeros(len(before), np.int32)
    done = 0
    held: dict[int, tuple] = {}
    while done < length:
        w = min(stride, length - done)
        if w not in held:
            gram, to = np.zeros(len(before), np.int32), np.arange(len(before), dtype=np.int32)
            for j in range(w):
                gram += before[to] * base_of**j
                to = back[to]
            # Short suffixes: their symbols, then marks.
            short = np.nonzero(size[text] - place < w)[0]
            short = short[np.lexsort((text[short], -(size[text[short]] - place[short])))]
            row_at = np.full((sum(n_texts), w), -1)
            row_at[text[short], (size[text] - place)[short]] = short
            begins = np.zeros(len(short), np.int64)
            left = (size[text] - place)[short]
            for j in range(w):
                # The symbol j places on is the one before the suffix that is j + 1 shorter.
                on = left > j
                begins[on] += before[row_at[text[short[on]], left[on] - j - 1]] * base_of ** (w - 1 - j)
            can = place >= w
            seen = np.zeros(base_of**w, bool)
            seen[gram[can]] = True
            seen[begins] = True
            code = np.cumsum(seen, dtype=np.int32) - 1
            kind = np.uint16 if code[-1] < 1 << 16 else np.int64
            held[w] = code[gram].astype(kind), to, can, short, code[begins].astype(kind)
        gram, to, can, short, begins = held[w]
        use = can[now]
        src = now[use]
        sym = np.concatenate([begins, gram[src]])
        old = np.concatenate([np.arange(len(short), dtype=np.int32), block[use] + np.int32(len(short))])
        order = np.argsort(sym, kind="stable")
        now = np.concatenate([short.astype(np.int32), to[src]])[order]
        sym, old = sym[order], old[order]
        new = np.empty(len(now), bool)
        new[0] = False
        new[1:] = (sym[1:] != sym[:-1]) | (old[1:] != old[:-1])
        block = np.cumsum(new, dtype=np.int32)
        done += w
    return now, block


def least_windows(contexts: list[bytes], keys: np.ndarray, length: int = LENGTH, shard: int = SHARD) -> list[np.ndarray]:
    """For each context, for each of its windows the least key of a context that holds the same bytes."""
    shards, first, at, size = [], [], 0, 0
    for i, c in enumerate(contexts):
        size += len(c) + 1
        if size >= shard or i == len(contexts) - 1:
            first.append(at)
            shards.append(suffix_order(contexts[at : i + 1]))
            at, size = i + 1, 0
    now, block = merged_blocks(shards, length)
    text = np.concatenate([s[0] + f for s, f in zip(shards, first, strict=True)])[now]
    place = np.concatenate([s[1] for s in shards])[now]
    lowest = np.full(int(block[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, block, keys[text])
    n = np.array([max(0, len(c) - length + 1) for c in contexts])
    base = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.int64)
    full = place < n[text]
    out[base[text[full]] + place[full]] = lowest[block[full]]
    return np.split(out, np.cumsum(n)[:-1])


def _spread(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mixed(h ^ mixed(row.astype(np.uint64)))


def _anchors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, row, n): of the texts of a block that chose a gram, one is dealt out by the gram; the others know already that it repeats and are dealt out evenly, with n = 0. n: the contexts that the gram has in the block, negative if all are in this text."""
    for b in it:
        for part in blocks(list(zip(b.column("row").to_pylist(), binary_list(b.column("text")), strict=True)), 1):
            t, h, _, _ = winnow([x[1] for x in part])
            row = np.array([x[0] for x in part], np.int64)[t]
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            keep = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)]
            begins = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
            n_contexts = np.diff(begins, append=len(h))
            h, row = h[keep], row[keep]
            one = np.r_[True, h[1:] != h[:-1]][: len(h)]
            n = np.zeros(len(h), np.int32)
            n[one] = np.where(np.diff(np.flatnonzero(one), append=len(h)) > 1, n_contexts, -n_contexts)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(row), pa.array(n)], ["hash", "row", "n"])


def _hot_bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - HOT_BITS)).astype(np.int64)


def _repeated(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition of anchors, those of grams that are met in more than one row. Buckets of hot grams come as rows below 0."""
    held = [[np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in range(3)] for b in it if b.num_rows]
    if not held:
        return
    h, row, n = (np.concatenate(c) for c in zip(*held, strict=True))
    del held
    order = np.argsort(h, kind="stable")
    h, row, n = h[order], row[order], n[order]
    same = h[1:] == h[:-1]
    again = np.r_[False, same] | np.r_[same, False] | (n >= 0)
    h, row, n = h[again], row[again], n[again]
    begins = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    if len(h):
        bucket = np.unique(_hot_bucket(h[begins][np.add.reduceat(np.abs(n.astype(np.int64)), begins) > HOT].view(np.uint64)))
        h, row = np.concatenate([h, bucket]), np.concatenate([row, -1 - bucket // 64])
    for i in range(0, len(h), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(row[i : i + 100_000]), pa.array(h[i : i + 100_000])], ["row", "hash"])


def hot_buckets(facts: DataFrame) -> np.ndarray:
    """The buckets of hot grams as bits, of a size that no input changes."""
    words = facts.filter("row < 0").select(F.explode("hashes").alias("b")).groupBy(F.expr("b div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("bits"))
    out = np.zeros((1 << HOT_BITS) // 64, np.int64)
    for r in words.collect():
        out[r.word] = r.bits
    return out


CONTEXT = "deal long, hash long, row long, key long, first int, windows int, context binary, others binary"


def _packed(places: list[tuple[int, int]]) -> bytes | None:
    """(row, first) of the rows of a block that ask the same as one of them, with the same key; it travels for all."""
    return np.array(places, np.int64).tobytes() if places else None


def _cut(contexts: list[tuple[bytes, int, list[tuple[int, int]]]], told: dict[bytes, int]) -> list[tuple]:
    """Contexts (bytes, key, places) of hot grams of a block as rows of CONTEXT: each window that no smaller key of this task has had is a context of its own, dealt out by its bytes; runs of the others are settled. told: the least key of each window so far."""
    out: list[tuple] = []
    mine: dict[bytes, tuple[int, list[tuple[int, int]]]] = {}
    for c, key, places in contexts:
        n = len(c) - LENGTH + 1
        gone = -1
        for j in range(n + 1):
            done = False
            if j < n:
                w = c[j : j + LENGTH]
                k = told.get(w)
                done = k is not None and k < key
                if not done:
                    if k is None and len(told) >= MEMO:
                        told.clear()
                    told[w] = key
                    if w in mine and mine[w][0] == key:
                        mine[w][1].extend((r, f + j) for r, f in places)
                    elif k != NULL_KEY:
                        # The least key of all has nothing to ask; it tells a window once.
                        mine[w] = key, [(r, f + j) for r, f in places]
                        out.append((w, key, mine[w][1]))
            if done and gone < 0:
                gone = j
            elif not done and gone >= 0:
                out += [(None, key, [(r, f + gone, j - gone)]) for r, f in places]
                gone = -1
    rows = []
    for w, key, places in out:
        if w is None:
            row, first, windows = places[0]
            rows.append((xxhash.xxh3_64_intdigest(b"%d %d" % (row, first)), 0, row, key, first, windows, None, None))
        else:
            h = xxhash.xxh3_64_intdigest(w)
            rows.append((h, h, places[0][0], key, places[0][1], 1, w, _packed(places[1:] if key != NULL_KEY else [])))
    return rows


def _contexts(it: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Contexts of repeated grams. One that a smaller key of the same block has too is settled: its bytes stay behind and it is dealt out evenly. Equal ones of one key travel as one row. Those of hot grams are cut."""
    told: dict[bytes, int] = {}
    names = [x.split()[0] for x in CONTEXT.split(", ")]
    for b in it:
        # Equal rows of one doc_id have equal results, which are asked for once.
        rows = list({r[:2]: r for r in zip(b.column("key").to_pylist(), b.column("row").to_pylist(), binary_list(b.column("text")), b.column("hashes").to_pylist(), strict=True)}.values())
        rows.sort(key=lambda r: r[:2])
        for part in blocks(rows, 2):
            texts = [x[2] for x in part]
            t, h, first, last = winnow(texts)
            size = np.array([len(x[3]) for x in part])
            wanted = np.array([v for x in part for v in x[3]], np.int64).view(np.uint64)
            # Of (text, hash) pairs: the mixed pair stands for both.
            keep = np.isin(mixed(h + mixed(t.astype(np.uint64))), mixed(wanted + mixed(np.repeat(np.arange(len(part)), size).astype(np.uint64))))
            t, h, first, last = t[keep], h[keep], first[keep], last[keep]
            row, key = np.array([x[1] for x in part])[t], np.array([x[0] for x in part])[t]
            bucket = _hot_bucket(h)
            is_hot = (hot[bucket // 64] >> (bucket % 64)) & 1 == 1
            seen: dict[bytes, tuple[int, int]] = {}
            out, settled, goes, places = [], [], [], {}
            for i, (a, z, k) in enumerate(zip(first.tolist(), (last + LENGTH).tolist(), key.tolist(), strict=True)):
                c = texts[t[i]][a:z]
                least, at = seen.setdefault(c, (k, i))
                settled.append(least < k)
                goes.append(least < k or at == i)
                out.append(c if at == i else None)
                if least == k and at != i and k != NULL_KEY:
                    places.setdefault(at, []).append((part[t[i]][1], a))
            whole, keep = np.array(settled, bool), np.array(goes, bool)
            cut = np.flatnonzero(is_hot & ~whole & keep).tolist()
            if cut:
                for some in batched(_cut([(out[i], int(key[i]), [(int(row[i]), int(first[i])), *places.get(i, ())]) for i in cut], told), 50_000):
                    deals, hashes, *cols = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (deals, hashes)), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True))], names)
            # Neighbouring contexts that are settled become one row.
            joins = np.r_[False, whole[1:] & whole[:-1] & (t[1:] == t[:-1]) & (first[1:] == last[:-1] + 1)]
            ends = np.flatnonzero(~np.r_[joins[1:], False])
            begins = np.flatnonzero(~joins)
            last[begins] = last[ends]
            keep &= (whole | ~is_hot) & ~joins
            at = np.flatnonzero(keep).tolist()
            out, others = [out[i] for i in at], [_packed(places[i]) if i in places else None for i in at]
            h, row, key, first, last, whole = h[keep], row[keep], key[keep], first[keep], last[keep], whole[keep]
            deal = np.where(whole, _spread(h, row + first), h)
            yield pa.RecordBatch.from_arrays([pa.array(deal.view(np.int64)), pa.array(h.view(np.int64)), pa.array(row, pa.int64()), pa.array(key, pa.int64()), pa.array(first, pa.int32()), pa.array(last - first + 1, pa.int32()), pa.array(out, pa.binary()), pa.array(others, pa.binary())], names)


SPANS = ["row", "key", "first", "end"]


def _spans(row, key, first, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(key, pa.int64()), pa.array(first, pa.int32()), pa.array(end, pa.int32())], SPANS)


def _covered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, key, first, end): bytes covered by repeated windows, from a partition of contexts in order of deal. Whole grams are compared as they come, about HELD contexts at once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in it:
        settled = b.filter(b.column("context").is_null())
        if settled.num_rows:
            first = settled.column("first").to_numpy()
            yield _spans(settled.column("row"), settled.column("key"), first, first + settled.column("windows").to_numpy() + LENGTH - 1)
        b = b.filter(b.column("context").is_valid())
        held.append(b)
        size += b.num_rows
        if size >= HELD:
            whole = pa.Table.from_batches(held).combine_chunks()
            h = whole.column("hash").to_numpy()
            # The last gram may go on.
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield from _compared(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
            size = len(h) - cut
    if size:
        yield from _compared(pa.Table.from_batches(held).combine_chunks())


def share_a_window(contexts: list[bytes], gram: np.ndarray) -> np.ndarray:
    """Which contexts hold a window whose hash another place of a context of the same gram has; the others cannot repeat."""
    size = np.array([len(c) for c in contexts])
    n = np.maximum(size - LENGTH + 1, 0)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    if len(data) < LENGTH:
        return np.zeros(len(contexts), bool)
    context = np.repeat(np.arange(len(contexts)), n)
    place = np.arange(len(context)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(size) - size, n)
    h = window_hashes(data)[place] ^ mixed(gram.view(np.uint64))[context]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(contexts), bool)
    out[context[order[1:][same]]] = True
    out[context[order[:-1][same]]] = True
    return out


def _compared(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """The same of whole grams, in order of their hashes."""
    h, row, key, first, windows = (t.column(c).to_numpy() for c in ("hash", "row", "key", "first", "windows"))
    context = t.column("context").to_pylist()
    # Equal contexts of a gram are one: the first in order has the least key. Gram and context stand for their bytes by 64 bits each.
    same = np.fromiter(map(xxhash.xxh3_64_intdigest, context), np.uint64, len(context))
    order = np.lexsort((key, same, h))
    new = np.r_[True, (h[order[1:]] != h[order[:-1]]) | (same[order[1:]] != same[order[:-1]])]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    one = order[new]
    least, gram = key[one], h[one]
    whole = least[group] < key
    # Only contexts of grams with several can repeat in part. Those of a gram stay together.
    begins = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    several = np.flatnonzero(np.repeat(np.diff(begins, append=len(gram)) > 1, np.diff(begins, append=len(gram))))
    if len(several):
        several = several[share_a_window([context[i] for i in one[several]], gram[several])]
    lowest: list[np.ndarray] = []
    at = 0
    while at < len(several):
        end, size = at, 0
        while end < len(several) and (size < MERGE or gram[several[end]] == gram[several[end - 1]]):
            size += len(context[one[several[end]]])
            end += 1
        some = several[at:end]
        lowest += least_windows([context[i] for i in one[some]], least[some])
        at = end
    # Contexts that no smaller key has whole: runs of their windows that one has.
    n_windows = np.zeros(len(one), np.int64)
    n_windows[several] = [len(x) for x in lowest]
    start = np.zeros(len(one), np.int64)
    start[several] = np.cumsum(n_windows[several]) - n_windows[several]
    part = np.flatnonzero(~whole & (n_windows[group] > 0))
    n = n_windows[group[part]]
    owner = np.repeat(np.arange(len(part)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    low = np.concatenate(lowest) if lowest else np.zeros(0, np.int64)
    hit = low[start[group[part[owner]]] + place] < key[part[owner]]
    edge = owner[1:] != owner[:-1]
    opens = np.flatnonzero(hit & np.r_[True, ~hit[:-1] | edge][: len(hit)])
    closes = np.flatnonzero(hit & np.r_[~hit[1:] | edge, True][: len(hit)])
    i = np.r_[np.flatnonzero(whole), part[owner[opens]]]
    a = np.r_[np.zeros(int(whole.sum()), np.int64), place[opens]]
    z = np.r_[windows[whole] - 1, place[closes]]
    yield _spans(row[i], key[i], first[i] + a, first[i] + z + LENGTH)
    # Places that ask the same as a row.
    others = t.column("others")
    if others.null_count < len(others):
        said = {k: np.frombuffer(v, np.int64).reshape(-1, 2) for k, v in enumerate(others.to_pylist()) if v}
        for k in np.flatnonzero(np.isin(i, list(said))).tolist():
            r, f = said[i[k]].T
            yield _spans(r, np.full(len(r), key[i[k]]), f + a[k], f + z[k] + LENGTH)


def cut_out(text: bytes, spans: list[dict] | None, copy: bool) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the maximal removed runs."""
    if copy and len(text) >= LENGTH:
        return b"", len(text), 1
    if not spans:
        return text, 0, 0
    left, at, gone, runs, end = [], 0, 0, 0, -1
    for s in sorted((s["first"], s["end"]) for s in spans):
        if s[0] > end:
            left.append(text[at : s[0]])
            runs += 1
            gone += s[1] - s[0]
        else:
            gone += max(0, s[1] - end)
        end = at = max(end, s[1])
    left.append(text[at:])
    return b"".join(left), gone, runs


def with_spans(docs: DataFrame, columns: list[str]) -> DataFrame:
    """text, copy (a smaller doc_id has the same text), spans (bytes that repeated windows cover), key, and rest: the given columns of docs."""
    spark = docs.sparkSession
    rest = F.struct(*columns) if columns else F.lit(0)
    text = F.coalesce("text", F.lit(""))
    # A row is known by row, 63 bits of a hash, together with its key. Equal rows have equal results.
    rows = docs.select(key_of().alias("key"), text.alias("text"), rest.alias("rest")).withColumn("row", F.expr("xxhash64(text, key) & 9223372036854775807"))
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    deal = F.when(F.col("n") != 0, F.col("hash")).otherwise(F.xxhash64("hash", "row"))
    anchors = rows.select("row", "text").mapInArrow(_anchors, "hash long, row long, n int").repartition(n, deal)
    wanted = anchors.mapInArrow(_repeated, "row long, hash long").groupBy("row").agg(F.collect_list("hash").alias("hashes"))
    digests = rows.select("row", "key", F.md5("text").alias("digest")).groupBy("row", "key").agg(F.min("digest").alias("digest"))
    least = digests.groupBy("digest").agg(F.min("key").alias("least"), F.count("*").alias("n")).filter("n > 1").select("digest", "least")
    facts = digests.join(least, "digest", "left").select("row", "key", F.coalesce(F.col("least") < F.col("key"), F.lit(False)).alias("copy")).join(wanted, "row", "full_outer")
    facts = written(facts, "passage-facts")
    hot = hot_buckets(facts)
    facts = facts.filter("row >= 0")
    # Both joins read one exchange of the texts.
    same = (F.col("row") == F.col("r")) & (F.col("key") == F.col("k"))
    asked = facts.filter("NOT copy AND hashes IS NOT NULL").select(F.col("row").alias("r"), F.col("key").alias("k"), "hashes")
    contexts = rows.join(asked.hint("merge"), same).select("row", "key", "text", "hashes").mapInArrow(lambda it: _contexts(it, hot), CONTEXT)
    spans = contexts.repartition(n, "deal").sortWithinPartitions("deal").mapInArrow(_covered, "row long, key long, first int, end int").groupBy("row", "key").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    told = facts.select("row", "key", "copy").join(spans, ["row", "key"], "left").withColumnRenamed("row", "r").withColumnRenamed("key", "k")
    return rows.join(told.hint("merge"), same).drop("r", "k", "row")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Measure what suffix deduplication removes: one row for each row of docs (doc_id, text; other columns are ignored).

    Each byte covered by a 50-byte string that also starts in a document with a smaller doc_id
    is removed, as the input has it; matches never cross documents. Columns: doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256. A null text counts as empty, a null
    doc_id as the smallest; rows that repeat a doc_id, whole rows too, do not remove each other's
    bytes. Very long texts are taken whole. An empty table gives an empty result. docs is read
    several times; its rows may come in other partitions each time.
    """

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cols: list[list] = [[], [], [], []]
            for text, spans, copy in zip(binary_list(b.column("text")), b.column("spans").to_pylist(), b.column("copy").to_pylist(), strict=True):
                left, gone, runs = cut_out(text, spans, copy)
                for c, v in zip(cols, (len(text), gone, runs, hashlib.sha256(left).hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = with_spans(docs, []).select("key", "text", "copy", "spans").mapInArrow(measure, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(id_of().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with what is left of their texts (a byte of a cut character is left out); a null text becomes empty. n_chars, where docs has it, follows. Null ids, repeated rows, very long texts and empty tables as in suffix_dedup; other columns, whatever their names, stay as they are."""
    names = docs.columns
    others = [c for c in names if c not in ("text", "n_chars")]
    spanned = with_spans(docs, others).select("text", "copy", "spans", "rest")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            left = [cut_out(t, s, c)[0].decode(errors="ignore") for t, s, c in zip(binary_list(b.column("text")), b.column("spans").to_pylist(), b.column("copy").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), b.column("rest")], ["text", "rest"])

    out = spanned.mapInArrow(cut, T.StructType([T.StructField("text", T.StringType()), spanned.schema["rest"]]))
    of = {"text": F.col("text"), "n_chars": F.length("text")}
    return out.select(*[(of[c] if c in of else F.col("rest")[c]).cast(docs.schema[c].dataType).alias(c) for c in names])
