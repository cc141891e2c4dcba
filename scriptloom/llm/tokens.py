"""Caches in front of the tokenizers library, and byte-level decoding.

White space separates what a tokenizer treats apart, so a text's ids are the
ids of its pieces in order.  Pieces repeat far more often than texts do; each
worker encodes a piece once, in batches, and keeps it in a bounded dictionary.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable

_loaded: dict = {}


def load(path: str):
    """The tokenizer at a path, once per worker, without truncation, padding or threads of its own."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


class PieceCache(dict):
    """piece (bytes) -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer, prefix: bytes = b"", limit: int = 350_000):
        super().__init__()
        self.tokenizer, self.prefix, self.limit = tokenizer, prefix, limit

    def learn(self, pieces: Iterable[bytes]) -> None:
        """Encodes those that are not here yet, together."""
        new = [p for p in set(pieces) if p not in self]
        if not new:
            return
        if len(self) + len(new) > self.limit:
            self.clear()
        texts = [(p if p[:1] == b"\n" else self.prefix + p).decode("utf-8") for p in new]
        for p, e in zip(new, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            self[p] = array("I", e.ids).tobytes()

    def __missing__(self, piece: bytes) -> bytes:
        self.learn([piece])
        return self[piece]


class LatinPieceCache(PieceCache):
    """Sends a run of Latin letters and the punctuation behind it straight to the merges; all else takes the whole path.

    The patterns of both tokenizers split exactly there.  lead is what the
    byte-level alphabet has for the space before a piece; lower is for a
    tokenizer whose normaliser lower-cases.
    """

    SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")

    def __init__(self, tokenizer, prefix: bytes = b"", lower: bool = False, limit: int = 900_000):
        super().__init__(tokenizer, prefix, limit)
        chars = byte_chars()
        self.lower, self.lead = lower, "".join(chars[b] for b in prefix)
        self.letters = {c: "".join(chars[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.tails: dict[str, bytes] = {"": b""}

    def learn(self, pieces: Iterable[bytes]) -> None:
        new = [p for p in set(pieces) if p not in self]
        if len(self) + len(new) > self.limit:
            self.clear()
        tokenize, others = self.tokenizer.model.tokenize, []
        for p in new:
            text = p.decode("utf-8", "replace")
            m = self.SIMPLE.fullmatch(text.lower() if self.lower else text)
            if not m:
                others.append(p)
                continue
            word, tail = m.groups()
            if tail not in self.tails:
                self.tails[tail] = array("I", self.tokenizer.encode(tail, add_special_tokens=False).ids).tobytes()
            self[p] = array("I", [x.id for x in tokenize(self.lead + (word if word.isascii() else word.translate(self.letters)))]).tobytes() + self.tails[tail]
        super().learn(others)


def byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}


def byte_table(path: str) -> dict[int, bytes]:
    """id -> bytes of a byte-level vocabulary."""
    spec = json.loads(open(path, encoding="utf-8").read())
    chars = {c: b for b, c in byte_chars().items()}
    table = {i: bytes(chars[c] for c in s) for s, i in spec["model"]["vocab"].items() if all(c in chars for c in s)}
    return table | {a["id"]: a["content"].encode() for a in spec["added_tokens"]}


#: Text whose white space is single spaces and line feeds between other characters.
PLAIN = re.compile(r"[^\s\x1c-\x1f]+(?:[ \n][^\s\x1c-\x1f]+)*")
