"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over the bytes cuts every text into chunks at places that
depend on the bytes nearby only, so texts that share a passage share chunks.

1. One pass counts every chunk of every document by a 128-bit key.
2. Of the chunks that stand in more than one place, those that save most bytes
   are encoded, each once, from the text of one document that owns it.  They
   make up the store, which goes out as a broadcast of bounded size
   (`store_bytes` of text).  Chunks beyond the bound are encoded where they
   stand, so the bound limits the saving only, never the result.  Chunks that
   stand in most places come first, since a passage that saves much is one
   that many documents share.
3. Each document is its stored chunks and the stretches between them.  A
   stretch is encoded as it stands; a chunk's ids come from the store, where it
   is looked up by its bytes.
4. Where two parts meet, encoding them apart may differ from encoding them
   together.  The join is encoded anew in a window around it, and the window
   grows until the new ids agree with the left part's at its start and with
   the right part's at its end; if it has grown over the whole right part,
   its own ids stand.

Why agreement proves the join right: the tokenizer's pattern is matched from
left to right, and what it matches next depends on the place alone.  If two
readings have a word start at the same place, they go on alike as far as both
see the same text.  A word start that is at least `margin` bytes before a
part's end does not depend on what follows, since neither the pattern nor an
added token looks so far ahead.  Windows begin at such a place.

Defined cases: a null text is an empty one (no ids, the empty text back); a
text that is not valid UTF-8 is read with replacement characters; very long
texts are one row's work, nothing is cut off; repeated rows give repeated
results; null identifiers pass through; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import mapped, table
from scriptloom.llm.tokens import PLAIN, LatinPieceCache, PieceCache, byte_table, load

#: Chunks end where these bits of the rolling hash are zero: 512 bytes on average.
MASK = 511
#: The store's bounds: bytes of chunk text, and chunks.
STORE_BYTES, STORE_CHUNKS = 24 << 20, 1 << 16
_tools: dict = {}


def chunk_ends(data: bytes, mask: int = MASK) -> list[int]:
    """Ends of the chunks: where a hash over the eight bytes before is zero under the mask, moved on to the next character's start; the text's end comes last."""
    n = len(data)
    if n <= 16:
        return [n]
    raw = np.frombuffer(data, np.uint8)
    h = raw.astype(np.uint32)
    for step, factor in ((1, 0x9E3779B1), (2, 0x85EBCA77), (4, 0xC2B2AE3D)):
        h[step:] += h[:-step] * np.uint32(factor)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2545F491)
    out = []
    for e in (np.flatnonzero((h >> np.uint32(8)) & np.uint32(mask) == 0) + 1).tolist():
        while e < n and 0x80 <= data[e] < 0xC0:
            e += 1
        if e < n and (not out or e > out[-1]):
            out.append(e)
    out.append(n)
    return out


def chunks_of(data: bytes, mask: int = MASK) -> list[bytes]:
    ends = chunk_ends(data, mask)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def valid(text: bytes | None) -> bytes:
    """The text as valid UTF-8."""
    try:
        (text or b"").decode("utf-8")
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()
    return text or b""


class Part:
    """Ids of a stretch of a text that starts at byte `start`: where each id starts, and which of them start a word."""

    __slots__ = ("start", "end", "ids", "at", "heads")

    def __init__(self, start: int, end: int, ids: np.ndarray, at: np.ndarray, heads: np.ndarray):
        self.start, self.end, self.ids, self.at, self.heads = start, end, ids, at, heads

    def index(self, place: int) -> int:
        """How many ids start before a place."""
        return int(np.searchsorted(self.at, place))


class ChunkEncoder:
    """Encodes whole texts for one worker, with a store of encoded chunks: bytes -> (ids, word starts)."""

    def __init__(self, path: str, store: dict[bytes, tuple[bytes, bytes]] | None = None, mask: int = MASK):
        spec = json.loads(open(path, encoding="utf-8").read())
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: a byte-level tokenizer without normaliser and prefix space is needed")
        self.tokenizer, self.store, self.mask = load(path), store or {}, mask
        lengths = {i: len(b) for i, b in byte_table(path).items()}
        self.bytes_of = np.zeros(max(lengths) + 1, np.int64)
        self.bytes_of[list(lengths)] = list(lengths.values())
        #: Neither the pattern (three characters) nor an added token looks further ahead.
        self.margin = 16 + max([len(a["content"].encode()) for a in spec["added_tokens"]], default=0)
        self.words, self.first = LatinPieceCache(self.tokenizer, b" "), PieceCache(self.tokenizer, b"", 50_000)
        self.reused = self.joins = self.widened = 0

    def pieces(self, data: bytes) -> list[bytes] | None:
        """ids of each piece between single spaces or line feeds, where the pattern always splits; None where the white space is of other kinds."""
        whole = data.decode("utf-8")
        if not PLAIN.fullmatch(whole[1:] if whole[:1] in (" ", "\n") else whole):
            return None
        words = data.replace(b"\n", b" \n").split(b" ")
        head = [self.first[words[0]]] if words[0] else []
        words = words[1:]
        parts = list(map(self.words.get, words))
        if None in parts:
            self.words.learn(words)
            parts = list(map(self.words.__getitem__, words))
        return head + parts

    def raw(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """ids of a stretch, and for each of them whether it is known to start a word."""
        parts = self.pieces(data)
        if parts is None:
            e = self.tokenizer.encode(data.decode("utf-8"), add_special_tokens=False)
            return np.array(e.ids, np.uint32), np.diff(np.array(e.word_ids, np.int32), prepend=-1) != 0
        ids = np.frombuffer(b"".join(parts), np.uint32)
        heads = np.zeros(len(ids), bool)
        heads[np.cumsum([0, *map(len, parts[:-1])]) // 4] = True
        return ids, heads

    def plain(self, data: bytes) -> bytes:
        """ids of a whole text."""
        parts = self.pieces(data)
        if parts is None:
            return np.array(self.tokenizer.encode(data.decode("utf-8"), add_special_tokens=False).ids, np.uint32).tobytes()
        return b"".join(parts)

    def stored(self, data: bytes) -> tuple[bytes, bytes]:
        """A chunk as the store keeps it: ids in as few bytes as the vocabulary needs, word starts as bits."""
        ids, heads = self.raw(data)
        return ids.astype(self.kept).tobytes(), np.packbits(heads).tobytes()

    @property
    def kept(self):
        return np.uint16 if len(self.bytes_of) <= 1 << 16 else np.uint32

    def part(self, start: int, data: bytes, ids: np.ndarray, heads: np.ndarray) -> Part:
        lengths = self.bytes_of[ids]
        at = np.cumsum(lengths) - lengths + start
        return Part(start, start + len(data), ids, at, at[heads])

    def encode(self, text: bytes | None) -> bytes:
        """All ids of a text, as little-endian unsigned 32-bit integers."""
        data = valid(text)
        if not data:
            return b""
        parts, own = [], 0  # (start, end, what the store has); own: where what is not in a part yet starts
        start = 0
        for end in chunk_ends(data, self.mask) if self.store else ():
            found = self.store.get(data[start:end])
            if found is not None:
                if own < start:
                    parts.append((own, start, None))
                parts.append((start, end, found))
                own = end
            start = end
        if own < len(data):
            parts.append((own, len(data), None))
        if len(parts) == 1 and parts[0][2] is None:
            return self.plain(data)
        done: list[bytes] = []
        tail = None
        for start, end, found in parts:
            body = data[start:end]
            if found is None:
                ids, heads = self.raw(body)
            else:
                ids = np.frombuffer(found[0], self.kept).astype(np.uint32)
                heads = np.unpackbits(np.frombuffer(found[1], np.uint8), count=len(ids)).astype(bool)
                self.reused += end - start
            right = self.part(start, body, ids, heads)
            tail = right if tail is None else self.join(data, tail, right, done)
        done.append(tail.ids.tobytes())
        return b"".join(done)

    def join(self, data: bytes, left: Part, right: Part, done: list[bytes]) -> Part:
        """Both parts as one that starts at a sure word start of the left part; the ids before it go to done.

        left starts at the text's start or at a word start that does not depend on what follows.
        """
        self.joins += 1
        s, reach = right.start, self.margin
        while True:
            sure = left.heads[: np.searchsorted(left.heads, s - self.margin, "right")]
            k = int(np.searchsorted(sure, s - self.margin - reach, "right")) - 1
            lo = int(sure[k]) if k >= 0 else left.start
            hi = min(right.end, s + self.margin + reach)
            while hi < right.end and 0x80 <= data[hi] < 0xC0:
                hi += 1
            window = self.part(lo, data[lo:hi], *self.raw(data[lo:hi]))
            whole = hi == right.end
            q = self.agreement(left, window, right, int(sure[-1]) if len(sure) else lo, hi if whole else hi - self.margin)
            if q is not None or whole:
                break
            reach *= 2
            self.widened += 1
        a = left.index(lo)
        done.append(left.ids[:a].tobytes())
        if q is None:  # the window covers all of the right part
            return window
        w, r = window.index(q), right.index(q)
        ids = np.concatenate([window.ids[:w], right.ids[r:]])
        at = np.concatenate([window.at[:w], right.at[r:]])
        heads = np.concatenate([window.heads[: np.searchsorted(window.heads, q)], right.heads[np.searchsorted(right.heads, q) :]])
        return Part(lo, right.end, ids, at, heads)

    @staticmethod
    def agreement(left: Part, window: Part, right: Part, sure: int, limit: int) -> int | None:
        """The first place from which the window's ids are the right part's, if they are the left part's up to `sure` as well.

        Both must have a word start there, and the ids must agree from there to
        the window's last word start up to limit, one id at least.
        """
        a, b = left.index(window.start), left.index(sure)
        if not np.array_equal(left.ids[a:b], window.ids[: b - a]) or (b > a and window.index(sure) != b - a):
            return None
        mine = window.heads[np.searchsorted(window.heads, right.start) : np.searchsorted(window.heads, limit, "right")].tolist()
        if limit == window.end:
            mine.append(limit)
        theirs = right.heads
        for k, q in enumerate(mine[:-1]):
            i = int(np.searchsorted(theirs, q))
            if i < len(theirs) and theirs[i] == q:
                end = mine[-1]
                w, r = window.ids[window.index(q) : window.index(end)], right.ids[right.index(q) : right.index(end)]
                if len(w) and np.array_equal(w, r):
                    return q
        return None


class Decoder:
    """Texts back from ids, as the library's byte-level decoder gives them."""

    def __init__(self, path: str):
        self.table = byte_table(path)

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.table.__getitem__, np.frombuffer(ids, np.uint32).tolist()))
        return raw.decode("utf-8", "replace")


def decoder(path: str) -> Decoder:
    """This worker's decoder."""
    if path not in _tools:
        _tools[path] = Decoder(path)
    return _tools[path]


def chunk_counts(docs: DataFrame, mask: int = MASK) -> DataFrame:
    """key, n, size, owner of every distinct chunk of docs (doc_id, text): in how many places it stands, its bytes, and the smallest hash of a text that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tally: dict[bytes, list[int]] = {}
            for x in b.column(0):
                data = valid(x.as_py())
                if not data:
                    continue
                owner = xxhash.xxh3_64_intdigest(data) - (1 << 63)
                for c in chunks_of(data, mask):
                    key = xxhash.xxh3_128_digest(c)
                    got = tally.get(key)
                    if got is None:
                        tally[key] = [1, len(c), owner]
                    else:
                        got[0] += 1
                        got[2] = min(got[2], owner)
            rows = list(tally.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], ["key", "n", "size", "owner"])

    each = docs.select(F.col("text").cast("binary")).transform(mapped, run, "key binary, n long, size long, owner long")
    return each.groupBy("key").agg(F.sum("n").alias("n"), F.min("size").alias("size"), F.min("owner").alias("owner"))


def chunk_store(docs: DataFrame, tokenizer: str, mask: int = MASK, store_bytes: int = STORE_BYTES, store_chunks: int = STORE_CHUNKS) -> dict[bytes, tuple[bytes, bytes]]:
    """The encoded chunks that stand in several places of docs, most bytes saved first, within the bounds."""
    spark = docs.sparkSession
    saved = (F.col("n") - 1) * F.col("size")
    chosen, room = {}, store_bytes
    for r in chunk_counts(docs, mask).filter("n > 1").orderBy(saved.desc(), "key").limit(store_chunks).collect():  # bounded by store_chunks
        if r.size <= room:
            chosen.setdefault(r.owner, set()).add(bytes(r.key))
            room -= r.size
    if not chosen:
        return {}
    wanted = spark.sparkContext.broadcast(chosen)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, seen = dict(wanted.value), set()
        for b in batches:
            out = []
            for x in b.column(0):
                data = valid(x.as_py())
                owner = xxhash.xxh3_64_intdigest(data) - (1 << 63)
                if owner in owners and owner not in seen:  # copies of an owner are skipped in the same task
                    seen.add(owner)
                    keys = owners[owner]
                    out += {c for c in chunks_of(data, mask) if xxhash.xxh3_128_digest(c) in keys}
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["chunk"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer)
        for b in batches:
            got = [encoder.stored(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i for i, _ in got], pa.binary()), pa.array([h for _, h in got], pa.binary())], ["chunk", "ids", "heads"])

    found = docs.select(F.col("text").cast("binary")).transform(mapped, gather, "chunk binary").distinct()
    encoded = found.transform(mapped, encode, "chunk binary, ids binary, heads binary").toArrow()  # bounded by store_bytes
    return {c: (i, h) for c, i, h in zip(*(encoded.column(k).to_pylist() for k in range(3)), strict=True)}


def encoders(docs: DataFrame, tokenizer: str, **store):
    """A function that gives a worker its encoder, with the store of docs."""
    mask = store.get("mask", MASK)
    shared = docs.sparkSession.sparkContext.broadcast(chunk_store(docs, tokenizer, **store))
    return lambda: ChunkEncoder(tokenizer, shared.value, mask)


def encode_texts(docs: DataFrame, tokenizer: str, **store) -> DataFrame:
    """doc_id, ids (array<int>) of every text; tokenizer is the path of a byte-level BPE file, store has the bounds of chunk_store."""
    encoder_of = encoders(docs, tokenizer, **store)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of()
        for b in batches:
            ids = [np.frombuffer(encoder.encode(x.as_py()), np.int32) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).transform(mapped, run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text of every row of doc_id, ids (a null list is an empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decoder(tokenizer).decode(np.array(x.as_py() or [], np.uint32).tobytes()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").transform(mapped, run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str, **store) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, reused_bytes: encoding with the store and decoding, without a shuffle of texts.

    reused_bytes says how many bytes' ids came from the store.
    """
    encoder_of = encoders(docs, tokenizer, **store)
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "n_bytes": pa.int64(), "reused_bytes": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of()
        for b in batches:
            rows = []
            for x in b.column(1):
                text, before = x.as_py() or b"", encoder.reused
                ids = encoder.encode(text)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoder(tokenizer).decode(ids).encode("utf-8")).hexdigest(), len(text), encoder.reused - before))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values()))], ["doc_id", *kinds])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).transform(mapped, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, reused_bytes long")


def op7_bpe_chunk_reuse(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
