import hashlib
import random
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from scriptloom.llm import bpe, packing
from scriptloom.llm.tokens import load

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", " ", "\n", "\t", "a", "Ab", "'s", "1", ".", "é", "e\u0301", "日", "<|endoftext|>", "<|endof", "text|>", "'", "\x1c", "\r\n", "  ", "😀", "\u3000", "hello", "don't", "İ"]


def ids(tokenizer, text):
    return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def store_of(texts, mask):
    """Every chunk that stands in several places, encoded on its own."""
    encoder, counts = bpe.ChunkEncoder(BYTE), Counter(c for s in texts for c in bpe.chunks_of(s.encode(), mask))
    return {c: encoder.stored(c) for c, n in counts.items() if c and n > 1}


@pytest.mark.parametrize("mask", [3, 15, 63])
def test_chunked_encoding_is_the_librarys(mask):
    t, d, rng = load(BYTE), bpe.Decoder(BYTE), random.Random(mask)
    some = lambda n: "".join(rng.choice(PARTS) for _ in range(rng.randint(1, n)))
    pool = [some(60) for _ in range(30)] + ["x" * 400, " " * 300, "ab1" * 150, "日本" * 90]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.6 else some(30) for _ in range(rng.randint(0, 5))) for _ in range(1500)]
    e = bpe.ChunkEncoder(BYTE, store_of(texts, mask), mask)
    for s in texts:
        got = e.encode(s.encode())
        assert got == ids(t, s), s
        assert d.decode(got) == t.decode(t.encode(s, add_special_tokens=False).ids, skip_special_tokens=False)
    assert e.reused > 0.2 * sum(len(s.encode()) for s in texts)
    assert e.joins > 100
    assert mask < 63 or e.widened > 0


def test_joins_ask_for_agreement_and_widen_until_there_is_some():
    """The word at the cut ends far from it, so the first windows agree with neither part."""
    left, right = b"one two " + b"a" * 150, b"a" * 200 + b" three four " + b"five " * 60
    e = bpe.ChunkEncoder(BYTE)
    data, done = left + right, []
    parts = [e.part(at, x, *e.raw(x)) for at, x in ((0, left), (len(left), right))]
    tail = e.join(data, *parts, done)
    assert b"".join(done) + tail.ids.tobytes() == ids(load(BYTE), data.decode())
    assert e.widened >= 2
    other = e.part(len(left), right, parts[1].ids + 1, np.ones(len(parts[1].ids), bool))  # ids that no encoding gives
    window = e.part(0, data, *e.raw(data))
    assert bpe.ChunkEncoder.agreement(parts[0], window, parts[1], 4, len(data)) is not None
    assert bpe.ChunkEncoder.agreement(parts[0], window, other, 4, len(data)) is None
    wrong = e.part(0, left, parts[0].ids + 1, np.ones(len(parts[0].ids), bool))
    assert bpe.ChunkEncoder.agreement(wrong, window, parts[1], 4, len(data)) is None


def test_chunks_of_several_documents_are_stored_once(spark):
    passage = " ".join(f"shared{i}" for i in range(400))
    rows = [(i, f"{i * 977} starts " + " ".join(f"own{i}x{j}" for j in range(50)) + " " + passage + f" ends {i}") for i in range(30)] + [(99, None), (99, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    store = bpe.chunk_store(d, BYTE)
    assert sum(c in passage.encode() for c in store) == len(store) >= 3
    few = bpe.chunk_store(d, BYTE, store_chunks=2)
    assert len(few) == 2
    assert sum(map(len, few)) >= 0.3 * sum(map(len, store))
    for bounds in ({}, {"store_chunks": 2}, {"store_bytes": 0}):
        got = {r.doc_id: r for r in bpe.round_trip(d, BYTE, **bounds).collect()}
        for i, text in rows[:30]:
            assert got[i].ids_sha256 == hashlib.sha256(ids(load(BYTE), text)).hexdigest()
            assert got[i].n_bytes == len(text)
            assert got[i].reused_bytes == (0 if bounds.get("store_bytes") == 0 else sum(map(len, few if bounds else store)))


def test_round_trip_rows(docs, none):
    t = load(BYTE)
    got = {(r.doc_id, r.ids_sha256): r for r in bpe.round_trip(docs, BYTE).collect()}
    for r in docs.collect():
        want = ids(t, r.text or "")
        g = got[(r.doc_id, hashlib.sha256(want).hexdigest())]
        assert g.n_tokens == len(want) // 4
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.round_trip(none, BYTE).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode_ids(bpe.encode_texts(docs, BYTE), BYTE).collect()}
    assert back[8] == next(r.text for r in docs.collect() if r.doc_id == 8)


def test_plans_fill_bins_without_gaps():
    for seed in range(12):
        rng = random.Random(seed)
        cap = rng.choice([16, 64, 4096])
        counts = {}
        for _ in range(rng.choice([1, 10, 3000])):
            n = min(cap, max(1, int(rng.lognormvariate(6.3, 1.1) * cap / 4096)))
            counts[n] = counts.get(n, 0) + 1
        plan, bins, ranks = packing.Plan(counts, cap), {}, {}
        for length, rank, count, first, offset in plan.runs:
            for k in range(count):
                bins.setdefault(first + k, []).append((offset, length))
                ranks.setdefault(length, []).append(rank + k)
        for content in bins.values():
            at = 0
            for offset, length in sorted(content):
                assert offset == at
                at += length
            assert at <= cap
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
        assert len(bins) <= -(-sum(n * c for n, c in counts.items()) // cap) * 1.1 + 1


def test_plans_are_near_a_known_optimum():
    """Lengths cut from 200 full sequences of two or three large pieces each: 200 is the optimum."""
    for seed in range(6):
        rng, cap, counts = random.Random(seed), 4096, Counter()
        for _ in range(200):
            a, b = rng.randint(1100, cap - 1100), rng.randint(1030, 2000)
            c = rng.randint(1030, cap - b - 1030)
            counts.update([a, cap - a] if rng.random() < 0.5 else [b, c, cap - b - c])
        assert packing.best_plan(counts, cap, packing.GROUPS).bins <= 203


def test_linear_program_is_a_lower_bound_that_small_cases_reach():
    import itertools

    for seed in range(20):
        rng = random.Random(seed)
        sizes = sorted({rng.randint(26, 100) for _ in range(3)}, reverse=True)
        counts = [rng.randint(1, 3) for _ in sizes]
        items = [s for s, c in zip(sizes, counts, strict=True) for _ in range(c)]
        best = len(items)
        for order in set(itertools.permutations(items)):  # first fit of the best order is an optimum
            bins = []
            for s in order:
                k = next((k for k, room in enumerate(bins) if room >= s), None)
                if k is None:
                    bins.append(100 - s)
                else:
                    bins[k] -= s
            best = min(best, len(bins))
        bound = sum(v for _, v in packing.linear_program(np.array(sizes), np.array(counts), 100))
        assert bound <= best + 1e-6
        found = packing.configurations(sizes, counts, 100)
        placed = Counter()
        for times, many in found:
            assert sum(sizes[i] * m for i, m in many.items()) <= 100
            placed.update({i: times * m for i, m in many.items()})
        assert placed == dict(enumerate(counts))
        assert best <= sum(times for times, _ in found) <= best + 1


def test_packing_of_whole_documents(docs, none):
    t, cap = load(WORD), 512
    rows = [r.asDict() for r in packing.pack_documents(docs, WORD, capacity=cap).collect()]
    want = []
    for r in docs.collect():
        data = ids(t, r.text or "") + (1).to_bytes(4, "little")
        for k, at in enumerate(range(0, len(data), 4 * cap)):
            one = data[at : at + 4 * cap]
            want.append((r.doc_id, k, at // 4, len(one) // 4, zlib.crc32(one)))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == sorted(want, key=repr)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in places.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= cap
    assert packing.pack_documents(none, WORD).count() == 0
