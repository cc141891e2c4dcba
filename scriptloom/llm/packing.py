"""Best-fit packing of token sequences by a linear grouping scheme.

Only lengths matter to a packing, and there are at most as many lengths as a
sequence has places.  So the plan is made on the histogram of lengths, whose
size does not depend on the number of documents: large lengths are ranked,
cut into groups of equal cardinality and rounded up to their group's largest;
configurations of these few sizes are optimised, by a linear program whose
columns are generated as they are needed and which is rounded by solving it
anew for what is left; the actual lengths take the places of the rounded ones;
then small lengths go, longest first, where they fit best.  Large are lengths
of which at most three go into a sequence.  Bins of equal content are held as ranges.  The
plan is a list of runs: "pieces of length l with ranks a to b go to the bins
from s on, at offset o".  Pieces find their run by length and rank, and ranks
are counted in two steps, so that no task sees all pieces of a length.

Defined cases: a null text is an empty one; every document has at least the
end token, so an empty one is a piece of length 1; longer ones are cut into
full pieces and a rest; null identifiers pass through; rows that repeat are
packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import mapped, settled, table, written
from scriptloom.llm.tokens import LatinPieceCache, load

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Numbers of groups that are tried in turn; more groups round less.
GROUPS = (16, 48, 256)
_caches: dict = {}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document, cut where it is longer than capacity."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _caches.setdefault(tokenizer, LatinPieceCache(load(tokenizer), lower=True))
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                pieces = (text.as_py() or b"").split()
                parts = list(map(cache.get, pieces))
                if None in parts:
                    cache.learn(pieces)
                    parts = list(map(cache.__getitem__, pieces))
                ids = b"".join(parts) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    one = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(one) // 4, zlib.crc32(one)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).transform(mapped, run, PIECE)


def linear_program(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, fractions allowed, so that every size is placed as often as it counts, in fewest bins.

    Revised simplex; the configuration that enters is the one worth most at the
    current prices, found over all pairs of sizes and the best third beside
    each.  Sizes are above a quarter of the capacity.
    """
    m = len(sizes)
    each = np.minimum(counts, capacity // sizes).astype(float)
    columns: list[np.ndarray | None] = [np.eye(m)[i] * each[i] for i in range(m)]  # None: a size is placed too often
    inverse, cost, x = np.diag(1 / each), np.ones(m), counts / each
    fits = sizes[:, None] + sizes[None, :] <= capacity
    fits &= ~np.diag(counts < 2)
    room = np.where(fits, capacity - sizes[:, None] - sizes[None, :], 0)
    for turn in range(40 * m + 200):
        price = cost @ inverse
        worst = int(price.argmin())
        if price[worst] < -1e-9:
            column, c, kept = -np.eye(m)[worst], 0.0, None
        else:
            top = np.zeros(capacity + 1)
            np.maximum.at(top, sizes, price)
            top = np.maximum.accumulate(top)
            pairs = np.where(fits, price[:, None] + price[None, :] + top[room], -1.0)
            i, j = divmod(int(pairs.argmax()), m)
            one = int(price.argmax())
            column, c = np.zeros(m), 1.0
            if pairs[i, j] > price[one]:
                column[i] += 1
                column[j] += 1
                third = np.flatnonzero((sizes <= room[i, j]) & (price > 0))
                if len(third):
                    column[third[price[third].argmax()]] += 1
            else:
                column[one] = each[one]
            if column @ price <= 1 + 1e-9:
                break
            kept = column
        d = inverse @ column
        can = d > 1e-9
        if not can.any():
            break
        ratio = np.where(can, x / np.where(can, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = x - step * d
        x[out] = step
        columns[out], cost[out] = kept if kept is not None else None, c
        inverse[out] /= d[out]
        d[out] = 0
        inverse -= np.outer(d, inverse[out])
        if turn % 200 == 199:  # errors that add up are put right
            basis = np.array([col if col is not None else np.zeros(m) for col in columns]).T
            if all(col is not None for col in columns) and np.linalg.matrix_rank(basis) == m:
                inverse = np.linalg.inv(basis)
                x = inverse @ counts
    return [(col, float(v)) for col, v in zip(columns, x, strict=True) if col is not None and v > 1e-9]


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, how many of each size): all sizes placed, in as few bins as can be.

    The linear program is solved; whole uses are taken, and of the fractions
    those of 0.9 and more, one at least; then it is solved for what is left.
    """
    left, out = np.array(counts, np.int64), []

    def take(column: np.ndarray, live: np.ndarray, most: int) -> bool:
        used = np.flatnonzero(column)
        times = min(most, int((left[live[used]] // column[used].astype(np.int64)).min())) if len(used) else 0
        if times > 0:
            out.append((times, {int(live[i]): int(column[i]) for i in used}))
            left[live[used]] -= times * column[used].astype(np.int64)
        return times > 0

    while left.any():
        live = np.flatnonzero(left)
        found = linear_program(np.array(sizes)[live], left[live], capacity)
        some = False
        for column, v in found:
            if v >= 1 - 1e-6:
                some |= take(column, live, int(v + 1e-6))
        for column, v in sorted(found, key=lambda f: f[1] % 1, reverse=True):
            if not some or 0.9 <= v % 1 < 1 - 1e-6:
                some |= take(column, live, 1)
        if not some:  # no configuration has all its members left: the largest size, as often as it goes
            i = live[0]
            n = min(int(left[i]), capacity // sizes[i])
            out.append((1, {int(i): n}))
            left[i] -= n
    return out


class Plan:
    """A packing of a histogram of lengths: runs of (length, first rank, count, first bin, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int, groups: int = 24):
        self.capacity, self.small = capacity, capacity // 4
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.bins, self.rank = 0, dict.fromkeys(counts, 0)
        self.open: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first bin, bins)
        self.rooms: list[int] = []
        left = {n: c for n, c in counts.items() if c}
        if left.get(capacity):
            self.put(capacity, left.pop(capacity), self.new_bins(counts[capacity]), 0)
        large = {n: left.pop(n) for n in sorted(left) if n > self.small}
        if large:
            self.configure(self.group(large, groups))
        for n in sorted(left, reverse=True):
            self.best_fit(n, left[n])

    def new_bins(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def put(self, length: int, count: int, first: int, offset: int) -> None:
        self.runs.append((length, self.rank[length], count, first, offset))
        self.rank[length] += count

    def leave(self, room: int, first: int, n: int) -> None:
        """Bins that have so much room left."""
        if room and n:
            if room not in self.open:
                self.open[room] = []
                bisect.insort(self.rooms, room)
            self.open[room].append((first, n))

    @staticmethod
    def group(large: dict[int, int], groups: int) -> list[list[list[int]]]:
        """Lengths, longest first, in groups of equal cardinality: lists of [length, count]."""
        total, out, room = sum(large.values()), [], 0
        per = -(-total // groups)
        for n in sorted(large, reverse=True):
            c = large[n]
            while c:
                if not room:
                    out.append([])
                    room = per
                k = min(c, room)
                out[-1].append([n, k])
                c, room = c - k, room - k
        return out

    def configure(self, groups: list[list[list[int]]]) -> None:
        """Configurations of rounded sizes, then their actual lengths in their places."""
        sizes = [g[0][0] for g in groups]
        counts = [sum(c for _, c in g) for g in groups]
        for times, many in configurations(sizes, counts, self.capacity):
            ranges = [(self.new_bins(times), times, 0)]  # first bin, bins, used
            for g, m in sorted(many.items()):
                for _ in range(m):
                    ranges = self.substitute(groups[g], ranges)
            for first, n, used in ranges:
                self.leave(self.capacity - used, first, n)

    def substitute(self, members: list[list[int]], ranges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out = []
        for first, n, used in ranges:
            while n:
                length, c = members[0]
                k = min(c, n)
                self.put(length, k, first, used)
                out.append((first, k, used + length))
                first, n = first + k, n - k
                members[0][1] -= k
                if not members[0][1]:
                    members.pop(0)
        return out

    def best_fit(self, length: int, count: int) -> None:
        """Pieces of one length to the bins with the least room that holds them, else to new bins."""
        while count:
            i = bisect.bisect_left(self.rooms, length)
            if i == len(self.rooms):
                per = self.capacity // length
                n = -(-count // per)
                self.leave(self.capacity, self.new_bins(n), n)
                continue
            room = self.rooms[i]
            first, n = self.open[room].pop()
            if not self.open[room]:
                del self.open[room]
                self.rooms.pop(i)
            per = room // length
            full = min(n, count // per)
            for q in range(per if full else 0):
                self.put(length, full, first, self.capacity - room + q * length)
            self.leave(room - per * length, first, full)
            count -= full * per
            first, n = first + full, n - full
            if n and count:  # fewer than per are left: one bin takes them
                for q in range(count):
                    self.put(length, 1, first, self.capacity - room + q * length)
                self.leave(room - count * length, first, 1)
                first, n, count = first + 1, n - 1, 0
            self.leave(room, first, n)


def best_plan(counts: dict[int, int], capacity: int, groups: tuple[int, ...]) -> Plan:
    """Of the numbers of groups, the plan that needs the fewest bins; none is tried once the lengths' sum admits no fewer."""
    least, best = -(-sum(n * c for n, c in counts.items()) // capacity), None
    for g in groups:
        plan = Plan(counts, capacity, g)
        if best is None or plan.bins < best.bins:
            best = plan
        if best.bins == least:
            break
    return best


def pack(pieces: DataFrame, capacity: int, groups: tuple[int, ...] = GROUPS, per_bucket: int = 500_000) -> DataFrame:
    """pieces (a written table) with sequence_id and offset; of the numbers of groups, the one that needs the fewest sequences."""
    n = pieces.count()
    buckets = max(64, n // per_bucket)
    ranked = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = written(ranked.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "pack-sizes")
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}  # as many rows as capacity, at most
    plan = best_plan(counts, capacity, groups)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    keys, firsts, offsets = (runs[:, 0] << 48) + runs[:, 1], runs[:, 3], runs[:, 4]
    before = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = ranked.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = (b.column(3).to_numpy(zero_copy_only=False) << 48) + b.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(firsts[at] + key - keys[at]), pa.array(offsets[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).transform(mapped, place, PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """Tokens of every document (doc_id, text) and an end token, in sequences of at most capacity."""
    return pack(written(token_pieces(docs, tokenizer, capacity, end_id), "pack-pieces"), capacity, groups)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return settled(spark, "pack-result", lambda: pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
