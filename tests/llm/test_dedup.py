import hashlib
import random
import re

from pyspark.sql import functions as F

from scriptloom.llm import exact_dedup, minhash


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[normal(t)]
        known = [x for x in g if x is not None]
        out.append((i, min(known) if known else None, len(g), hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_against_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = exact_dedup.deduplicate(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute_exact(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({normal(t) for _, t in rows})
    assert sorted(exact_dedup.exact_dedup(docs).columns) == sorted(docs.columns)


def test_colliding_digests_are_told_apart_by_their_bytes(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = exact_dedup.deduplicate(docs, digest=lambda t: F.substring(exact_dedup.sha256(t), 1, 1)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == sorted((x[:3] for x in brute_exact(rows)), key=repr)
    assert sum(r.kept for r in got) == len({normal(t) for _, t in rows})


def test_state_goes_on_over_several_batches(spark, tmp_path):
    store, state = f"file://{tmp_path}/store", f"file://{tmp_path}/state"
    for k in range(3):
        d = spark.createDataFrame([(10 - k, "a"), (20 + k, f"b{k}")], "doc_id long, digest string")
        d.coalesce(1).write.mode("append").parquet(store)
        exact_dedup.fold_stream(spark, store, state)
    got = {r.digest: (r.first.id, r.hits) for r in exact_dedup.read_state(spark, state).collect()}
    assert got == {"a": (8, 3), "b0": (20, 1), "b1": (21, 1), "b2": (22, 1)}


def test_exact_of_nothing(none):
    assert exact_dedup.deduplicate(none).count() == 0
    assert exact_dedup.exact_dedup(none).columns == none.columns


def shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_near(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                ra, rb = root[a], root[b]
                root = [rb if r == ra else r for r in root]
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if root[j] == root[k] and sets[j][0] is not None]
        out.append((i, len(s), min(ids) if ids and s else i))
    return sorted(out, key=repr)


def test_near_against_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = minhash.near_duplicates(docs, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_near(rows)
    assert minhash.keep_one(docs).columns == docs.columns


def test_near_families_of_several_blocks(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(words))]
    for k in range(1, 60):
        w = list(words)
        w[(k * 7) % 120] = f"x{k}"
        if k % 3 == 0:
            w[(k * 11) % 120] = f"y{k}"
        rows.append((k, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (8, 512):
        got = minhash.near_duplicates(d, 85, block).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_near(rows)


def edited(words, n, rng, mark):
    """words with n places, far apart, taken by other words."""
    w = list(words)
    for k in range(n):
        w[(k + 1) * len(w) // (n + 1)] = f"{mark}{rng.random()}"
    return " ".join(w)


def test_one_identifier_with_several_texts(spark):
    """Rows are linked, not identifiers: the row with a text of its own stays."""
    rng, words = random.Random(1), [f"w{i}" for i in range(200)]
    other = " ".join(f"u{i}" for i in range(90))
    rows = [(1, " ".join(words)), (5, edited(words, 2, rng, "x")), (5, other), (None, edited(words, 1, rng, "y")), (None, other + " end"), (None, "alone is this text that nobody else has"), (5, other)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as gone_id", "2 as text_hash")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(d, 85).collect()), key=repr)
    assert got == brute_near(rows)
    assert sorted(((r.doc_id, r.text) for r in minhash.keep_one(d).collect()), key=repr) == sorted([rows[0], rows[2], rows[5], rows[6]], key=repr)


def test_planted_pairs_at_the_threshold_are_found(spark):
    rng, rows = random.Random(2), []
    for k in range(2400):  # 5 shingles change with each word: similarity 0.85 to 0.90
        words = [f"p{k}w{i}" for i in range(rng.randint(160, 260))]
        n = len(words) - 4
        most = int(0.15 / 1.85 * n / 5)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, edited(words, most, rng, f"p{k}x"))]
    sets = {i: shingles(t) for i, t in rows}
    alike = {i: len(sets[i] & sets[i - 1]) / len(sets[i] | sets[i - 1]) for i in sets if i % 2}
    near = [i for i, j in alike.items() if 0.85 <= j <= 0.9]
    assert len(near) >= 2000
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert sum(got[i] == i - 1 for i in near) >= 0.999 * len(near)
    assert all(got[i] == (i - 1 if alike[i] >= 0.85 else i) for i in alike if i not in near or got[i] == i - 1)


def test_a_family_far_from_its_hub_copies_few_sets(spark):
    """A chain: each text is near its neighbours only, so the family is one and its hub near to few."""
    words, rows = [f"c{i}" for i in range(1600)], []
    for k in range(300):
        rows.append((k, " ".join(words[4 * k : 4 * k + 120])))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}
    inner = minhash.dealt

    def counted(*a):
        out = inner(*a)
        seen["copies"], seen["largest"] = out.count(), out.groupBy("bucket", "cell", "i", "j").count().agg({"count": "max"}).first()[0]
        return out

    minhash.dealt = counted
    try:
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(d, 85, block=8).collect()}
    finally:
        minhash.dealt = inner
    assert got == {i: c for i, _, c in brute_near(rows)}
    assert seen["largest"] <= 40
    assert seen["copies"] <= 28 * len(rows)  # a bucket a band at most; pairs of blocks of the whole family are 38 times the rows


def test_near_of_nothing(none):
    assert minhash.near_duplicates(none).count() == 0


def test_components_of_chains(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in minhash.components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
