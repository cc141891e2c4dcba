"""Near-duplicate detection by min-max hashing.

Each permutation of the hashed shingles gives two values, the minimum and the
maximum; each agrees between two sets with the probability of their Jaccard
similarity, so half the hash evaluations fill a signature.  Values are banded.

1. One pass over the texts gives per row the set's size, a 128-bit key of the
   whole set and one hash per band.  Rows with equal sets are one class, with
   a number of its own; only one row of a class goes on.
2. Band buckets with several classes become stars (member, smallest member),
   so a bucket of n costs n links, never n squared.  Their connected
   components are the families: every pair to be confirmed lies inside one.
3. A family's sets meet in one task if it is small.  In a larger one, each
   member is first held against one hub; those linked with it are settled
   among themselves.  Then only the band buckets that still have members of
   different standing are looked at, each set of members once however many
   bands it shares, and only members of one bucket meet; unless few are far
   from the hub, so that the family as a whole needs fewer copies.  A large
   bucket is
   cut into blocks, and each pair of blocks is a task of bounded size.  There,
   exact intersections decide, and only a spanning forest of the confirmed
   links leaves the task.
4. Components of the confirmed links name each row's smallest partner.

A pair at the similarity that is asked for is missed with probability 2e-5,
and less above it: 7 values a band and 28 bands do for 0.85, 6 values and 36
bands for 0.80.

Defined cases: a text that is null or has no words has an empty set, is linked
with nothing and is kept; fewer than five words are one shingle.  What is
linked is rows, not identifiers: rows that repeat a doc_id with different
texts may be in different groups.  A null doc_id is linked as any other, but
names no group unless all of the group's are null.  Of each group keep_one
keeps the row with the smallest doc_id, then the smallest hash of the text;
rows that repeat both all stay or all go, as telling them apart is exact
deduplication's work.  An empty table gives no rows; other columns are ignored
(the pipeline stage passes them through).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm.common import discard, distinct_name, mapped, table, written

#: A pair at the threshold is missed with about this probability.
MISS = 2e-5
SHINGLE = 5
#: Family members are broadcast up to so many (about 100 bytes each); beyond, the join with the texts is a shuffle.
BROADCAST_ROWS = 400_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.default_rng(20240229)
_ODD = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def banding(percent: int) -> tuple[int, int]:
    """Values a band and bands for a threshold; 28 bands at least, an even number."""
    rows = 7 if percent >= 85 else 6
    agree = (percent / 100) ** rows
    bands = math.ceil(math.log(MISS) / math.log1p(-agree)) if agree < 1 else 1
    return rows, max(28, bands + bands % 2)


@lru_cache
def permutations(rows: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """A multiplier for each permutation (two values each), and one for each value's place in its band."""
    rng = np.random.default_rng([20240229, rows, bands])
    odd = rng.integers(0, 1 << 63, rows * bands // 2 + rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd[: rows * bands // 2], odd[rows * bands // 2 :].reshape(bands, rows)


def shingle_set(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word k-shingles (all words as one where there are fewer)."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = len(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < k:
        return _scramble((h * _ODD[:n]).sum(keepdims=True) + np.uint64(n))
    s = h[: n - k + 1] * _ODD[0]
    for j in range(1, k):
        s = s + _scramble(h[j : n - k + 1 + j] * _ODD[j])
    return np.unique(_scramble(s))


def band_hashes(s: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One hash per band over the minima and maxima of a non-empty set under each permutation."""
    perm, mix = permutations(rows, bands)
    least = np.full(len(perm), np.iinfo(np.uint64).max, np.uint64)
    most = np.zeros(len(perm), np.uint64)
    for at in range(0, len(s), 2048):
        h = s[at : at + 2048, None] * perm
        h ^= h >> np.uint64(32)
        np.minimum(least, h.min(0), out=least)
        np.maximum(most, h.max(0), out=most)
    values = np.concatenate([least, most]).reshape(bands, rows)
    return _scramble((_scramble(values) * mix).sum(1) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def set_key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def signatures(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (null for the empty set), bands of every row."""
    shape = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, keys, bands = [], [], []
            for x in b.column(2):
                s = shingle_set(x.as_py())
                sizes.append(len(s))
                keys.append(set_key(s))
                bands.append(band_hashes(s, *shape) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "set_key", "bands"])

    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary"))
    return texts.transform(mapped, run, "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (smallest node reachable) of a table of undirected edges a, b.

    Alternating large-star and small-star steps; each is an aggregation and a
    join, and each result is a written table, so no lineage grows.  The
    minima are written before the join, too: between plain exchanges Spark can
    split a node that most edges meet over several tasks.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = written(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
        lower = written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        after = written(small, name)
        discard(now, least, large, lower)
        now = after
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    out = written(stars.union(roots.join(stars, "node", "left_anti")), name)
    discard(now)
    return out


def forest(ids: np.ndarray, sets: list[np.ndarray], percent: int, left: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union, each confirmed on full sets.

    With left, only pairs between the first left sets and the others count.
    Postings of the shingles that several sets share give exact intersections,
    a row at a time; rows already joined to all others are skipped.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.empty(len(flat), bool)
    new[0] = True
    new[1:] = flat[1:] != flat[:-1]
    token = np.cumsum(new) - 1
    starts = np.append(np.flatnonzero(new), len(flat))
    by_owner = np.argsort(owner, kind="stable")
    tokens, bounds = token[by_owner], np.concatenate([[0], np.cumsum(sizes)])
    shared = np.diff(starts) > 1
    parent, links = np.arange(n), []
    for i in range(n if left is None else left):
        lo = i + 1 if left is None else left
        others = parent[lo:] != parent[i]
        if not others.any():
            continue
        mine = tokens[bounds[i] : bounds[i + 1]]
        mine = mine[shared[mine]]
        if not len(mine):
            continue
        a, m = starts[mine], starts[mine + 1] - starts[mine]
        at = np.repeat(a - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
        common = np.bincount(owner[at], minlength=n)[lo:]
        hit = (100 * common >= percent * (sizes[i] + sizes[lo:] - common)) & others
        for j in np.flatnonzero(hit) + lo:
            if parent[j] != parent[i]:
                links.append((int(ids[i]), int(ids[j])))
                parent[parent == max(parent[i], parent[j])] = min(parent[i], parent[j])
    return links


def decisions(docs: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept, stays of every row of docs (doc_id, text): a written table."""
    sig = written(signatures(docs, percent), "minhash-signatures")
    rep = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = sig.filter("set_key is not null").groupBy("set_key").agg(F.min(rep).alias("rep"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")  # numbers are fixed once written
    banded = classes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = written(banded.join(buckets, "band").select("node", "band", "head", "n"), "minhash-placed")
    stars = placed.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    company = placed.groupBy("node").agg(F.sum("n").alias("company"))
    found = components(stars, "minhash-families")
    family = written(found.withColumnRenamed("root", "family").join(company, "node").join(classes.select("node", "set_key", "rep"), "node"), "minhash-family")
    links = written(confirmed(docs, family, placed, percent, block), "minhash-links")
    root = components(links, "minhash-components")
    linked = root.join(classes.select("node", "set_key", "rep"), "node")
    tops = written(linked.groupBy("root").agg(F.min("rep").alias("top")), "minhash-tops")
    named = written(linked.join(tops, "root").select("set_key", "top"), "minhash-named")
    # Written, so that a set that most rows share can be split over several tasks in the join behind it.
    top = written(classes.select("set_key", "rep").join(named, "set_key", "left").select("set_key", F.coalesce("top", "rep").alias("top")), "minhash-top")
    out = sig.drop("bands").join(top, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")))
    out = out.withColumns({"kept": F.col("doc_id").eqNullSafe(F.col("component_id")), "stays": F.col("set_key").isNull() | rep.eqNullSafe(F.col("top"))})
    out = written(out.select("doc_id", "text_hash", "n_shingles", "component_id", "kept", "stays"), "minhash-decisions")
    discard(sig, classes, placed, found, family, links, root, tops, named, top)
    return out


def near_duplicates(docs: DataFrame, percent: int = 80, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    return decisions(docs, percent, block).select("doc_id", "n_shingles", "component_id", "kept")


def family_sets(docs: DataFrame, family: DataFrame) -> DataFrame:
    """The sets of family members: node, family, company, set; the row of a class is found by identifier and hash, and held against the class's key."""
    if family.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # then only the texts of members are read on
        family = F.broadcast(family)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that repeat identifier and text give a class's set once a task
        for b in batches:
            rows = []
            for node, fam, company, key, text in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4), strict=True):
                if node not in seen:
                    s = shingle_set(text.as_py())
                    if set_key(s) == key:
                        seen.add(node)
                        rows.append((node, fam, company, s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["node", "family", "company", "set"])

    both = texts.join(family, F.col("id").eqNullSafe(F.col("rep.doc_id")) & (F.col("hash") == F.col("rep.text_hash")))
    return both.select("node", "family", "company", "set_key", "text").transform(mapped, to_sets, "node long, family long, company long, set binary")


def near_hub(members: DataFrame, block: int, percent: int) -> DataFrame:
    """members with large (whether the family has more than block), hub and near: whether the set is linked with that of its family's hub.

    A hub is the member of a large family that shares most band buckets with
    most others, as an original does among its edited copies.  Small families
    have none.
    """
    hubs = members.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.max_by(F.struct("node", "set"), F.struct("company", -F.col("node"))).alias("hub"))
    hubs = written(hubs.select("family", (F.col("members") > block).alias("large"), F.when(F.col("members") > block, F.col("hub")).alias("hub")), "minhash-hubs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for mine, hub in zip(b.column(2), b.column(5), strict=True):
                if not hub.is_valid:
                    near.append(False)
                    continue
                x, y = np.frombuffer(mine.as_py(), np.uint64), np.frombuffer(hub.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(near, pa.bool_())], ["node", "family", "set", "large", "hub", "near"])

    both = members.join(hubs, "family").select("node", "family", "set", "large", F.col("hub.node").alias("hub"), F.col("hub.set").alias("hub_set"))
    out = written(both.transform(mapped, compare, "node long, family long, set binary, large boolean, hub long, near boolean"), "minhash-members")
    discard(hubs)
    return out


def copies(near: str, far: str, block: int) -> Column:
    """How many copies of sets a cell of so many members near and far costs when it is dealt."""
    near_blocks, far_blocks = F.ceil(F.col(near) / block), F.ceil(F.col(far) / block)
    return F.col(near) * far_blocks + F.col(far) * (far_blocks + near_blocks)


def cells(members: DataFrame, placed: DataFrame, block: int) -> DataFrame:
    """Groups in which pairs are left to decide: bucket (whether it is one), cell, node, near.

    A small family is one cell.  Of a large one, cells are the band buckets
    with members of different standing (linked with the hub, or each for
    itself), buckets of the same members once; but if few are far from the
    hub, the whole family as one cell costs fewer copies, and is taken.
    """
    near, far = F.sum(F.col("near").cast("long")).alias("n_near"), F.sum((~F.col("near")).cast("long")).alias("n_far")
    standing = members.filter("large").select("family", "node", "near", F.when(F.col("near"), F.col("hub")).otherwise(F.col("node")).alias("standing")).distinct()
    met = placed.select("node", "band").join(standing, "node")
    buckets = met.groupBy("band").agg(F.first("family").alias("family"), near, far, F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.min("standing").alias("low"), F.max("standing").alias("high"))
    buckets = buckets.filter("low <> high").groupBy("family", "n_near", "n_far", "sum").agg(F.min("band").alias("band"))
    buckets = written(buckets.select("family", "band", copies("n_near", "n_far", block).alias("apart")), "minhash-buckets")
    apart = buckets.groupBy("family").agg(F.sum("apart").alias("apart"))
    whole = members.filter("large").groupBy("family").agg(near, far).select("family", copies("n_near", "n_far", block).alias("together"))
    cheap = written(whole.join(apart, "family").select("family", (F.col("together") <= F.col("apart")).alias("one")), "minhash-cheap")
    ones = members.filter("not large").select("family", "node", "near").union(members.filter("large").join(cheap.filter("one"), "family").select("family", "node", "near"))
    several = met.drop("family").join(buckets.join(cheap.filter("not one"), "family").select("band"), "band")
    out = ones.select(F.lit(False).alias("bucket"), F.col("family").alias("cell"), "node", "near").union(several.select(F.lit(True).alias("bucket"), F.col("band").alias("cell"), "node", "near"))
    out = written(out, "minhash-cells")
    discard(buckets, cheap)
    return out


def dealt(cell: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """Sets dealt to tasks: bucket, cell, i, j, mine, node, set.

    What is not near a hub is dealt into blocks of about `block` by a hash,
    and so is what is near; each pair of blocks, two of the near ones aside,
    is one group.
    """
    counts = written(cell.groupBy("bucket", "cell").agg(F.sum(F.col("near").cast("long")).alias("n_near"), F.sum((~F.col("near")).cast("long")).alias("n_far")).filter("n_far > 0 and n_near + n_far > 1"), "minhash-counts")
    placed = cell.join(counts, ["bucket", "cell"])
    placed = placed.withColumn("far_blocks", F.ceil(F.col("n_far") / block).cast("int")).withColumn("near_blocks", F.ceil(F.col("n_near") / block).cast("int"))
    at = F.xxhash64("node")
    mine = F.when(F.col("near"), F.col("far_blocks") + F.pmod(at, F.greatest(F.lit(1), "near_blocks").cast("long"))).otherwise(F.pmod(at, F.greatest(F.lit(1), "far_blocks").cast("long"))).cast("int")
    placed = placed.withColumn("mine", mine)
    others = F.when(F.col("near"), F.col("far_blocks")).otherwise(F.col("far_blocks") + F.col("near_blocks"))
    pair = F.transform(F.sequence(F.lit(0), others - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    placed = placed.withColumn("pair", F.explode(pair)).select("node", "bucket", "cell", "mine", "pair.i", "pair.j")
    return placed.join(members.select("node", "set"), "node")


def confirmed(docs: DataFrame, family: DataFrame, placed: DataFrame, percent: int, block: int) -> DataFrame:
    """a, b: confirmed links that span what is linked inside each family (node, family, company, set_key, rep)."""
    sets = written(family_sets(docs, family), "minhash-sets")
    members = near_hub(sets, block, percent)
    discard(sets)
    through = members.filter("near and node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    cell = cells(members, placed, block)

    def link(key, rows: pd.DataFrame) -> pd.DataFrame:
        _, _, i, j = key
        rows = rows.drop_duplicates(["node"])
        if i == j:
            ids, left = rows, None
        else:
            ids = pd.concat([rows[rows.mine == i], rows[rows.mine == j]])
            left = int((rows.mine == i).sum())
            if left == len(ids) or not left:
                return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets = [np.frombuffer(s, np.uint64) for s in ids.set]
        return pd.DataFrame(forest(ids.node.to_numpy(), sets, percent, left), columns=["a", "b"], dtype="int64")

    return through.union(dealt(cell, members, block).groupBy("bucket", "cell", "i", "j").applyInPandas(link, "a long, b long"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates, all columns as they were."""
    one, two = distinct_name("gone_id", docs.columns), distinct_name("gone_hash", docs.columns)
    gone = decisions(docs, percent).filter("not stays").select(F.col("doc_id").alias(one), F.col("text_hash").alias(two)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone[one]) & (F.xxhash64(docs["text"]) == gone[two]), "left_anti")


def op2_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
c AS (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
e AS (SELECT rep, n, unnest(sh) AS x FROM c),
p AS (SELECT a.rep AS u, b.rep AS v FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
q AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r(a, b) AS (SELECT u, v FROM q UNION SELECT r.a, q.v FROM r JOIN q ON r.b = q.u),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a),
k AS (SELECT c.sh, least(c.rep, coalesce(m.b, c.rep)) AS root FROM c LEFT JOIN m ON c.rep = m.a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(k.root, s.doc_id) AS component_id, s.doc_id = coalesce(k.root, s.doc_id) AS kept
FROM s LEFT JOIN k ON list_sort(s.sh) = k.sh
"""
