"""Encode many short strings in one call: the merge rules of a byte-level BPE tokenizer file, run by tiktoken."""

from __future__ import annotations

import json

import numpy as np

#: Ends a string in the joined input; strings that hold it are not for this class.
END = "\0"


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes bytes as characters: printable ones of Latin-1 as themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class JoinedBpe:
    """encode(strings) gives each string's ids. With a word-end suffix in the model, a string is one pre-token and its last byte carries the suffix; without, pattern splits the strings into pre-tokens."""

    def __init__(self, tokenizer, pattern: str | None = None):
        import tiktoken

        model = json.loads(tokenizer.to_str())["model"]
        suffix, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        of = byte_alphabet()
        self.suffix = bool(suffix)

        def raw(token: str) -> bytes:
            ended = bool(suffix) and token.endswith(suffix)
            return bytes(of[c] for c in (token[: -len(suffix)] if ended else token)) + END.encode() * ended

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        tokens = [*of, *(c + suffix for c in of if suffix), *(a + b for a, b in pairs)]
        ranks: dict[bytes, int] = {}
        ids = []
        for b, c in sorted((b, c) for c, b in of.items()):
            ranks[bytes([b])] = len(ids)
            ids.append(vocab[c])
        for token in tokens[256:]:
            if raw(token) not in ranks:
                ranks[raw(token)] = len(ids)
                ids.append(vocab[token])
        self.ids = np.array(ids, np.int64)
        # A word ends with the marker's token; a joined string begins with a space's.
        self.edge = np.zeros(len(ids), bool)
        for token, rank in ranks.items():
            self.edge[rank] = token.endswith(END.encode()) if suffix else token.startswith(b" ")
        self.core = tiktoken.Encoding("joined", pat_str=pattern or f"[^{END}]*{END}", mergeable_ranks=ranks, special_tokens={})

    def encode(self, strings: list[str], dtype=np.int32) -> list[bytes]:
        """The ids of each string as the bytes of an array of dtype. Without a suffix every string begins with its only space; with one, none is empty."""
        if not strings:
            return []
        got = np.array(self.core.encode_ordinary("".join([s + END for s in strings] if self.suffix else strings)), np.int64)
        at = np.nonzero(self.edge[got])[0] + self.suffix
        data, size = self.ids[got].astype(dtype).tobytes(), np.dtype(dtype).itemsize
        ends = (at * size).tolist() if self.suffix else [*(at[1:] * size).tolist(), len(data)]
        if len(ends) != len(strings):
            raise ValueError("the strings are not separable")
        return [data[a:b] for a, b in zip([0, *ends], ends)]
