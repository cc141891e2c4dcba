import random
import zlib
from itertools import pairwise

from pyspark.sql import functions as F

from scriptloom.llm import resharding


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(3)
    for _ in range(60):
        old = [rng.randint(0, 50) for _ in range(rng.randint(1, 7))]
        shards = rng.randint(1, 7)
        cap = resharding.even(sum(old), shards)
        flow = resharding.solve(old, shards)
        assert [sum(r) for r in flow] == old
        assert [sum(r[j] for r in flow) for j in range(shards)] == cap
        kept = sum(min(a, b) for a, b in zip(old, cap, strict=False))
        assert sum(x for i, r in enumerate(flow) for j, x in enumerate(r) if i != j) == sum(old) - kept


def test_flow_follows_costs():
    assert resharding.min_cost_flow([5, 5], [5, 5], [[3, 1], [1, 3]]) == [[0, 5], [5, 0]]


def test_cuts_cover_every_block():
    pieces = resharding.cut([(0, 0, 7), (0, 1, 3), (1, 0, 2)], resharding.solve([10, 2], 3))
    for old, block, size in ((0, 0, 7), (0, 1, 3), (1, 0, 2)):
        own = sorted(p[2:4] for p in pieces if p[:2] == (old, block))
        assert own[0][0] == 0
        assert own[-1][1] == size
        assert all(a[1] == b[0] for a, b in pairwise(own))


def check(rows, source):
    assert len(rows) == len(source)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in source if i is not None)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_rows_slots_and_even_sizes(spark, docs):
    source = [(r.doc_id, r.text) for r in docs.collect()]
    old = F.pmod(F.xxhash64("source"), F.lit(4)).cast("int")
    check(resharding.reshard(resharding.sized(docs, old), 4, 8).collect(), source)
    many = spark.createDataFrame([(i, "x" * (i * 7919 % 90), "hot" if i % 3 else str(i)) for i in range(4000)], "doc_id long, text string, source string")
    rows = resharding.reshard(resharding.sized(many, old), 4, 8, block_bytes=2000).collect()
    check(rows, [(r.doc_id, r.text) for r in many.collect()])
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 4 * 91
    before = [sum(r.size for r in rows if r.old == s) for s in range(8)]
    stay = sum(min(a, b) for a, b in zip(before, resharding.even(sum(before), 8), strict=True))
    assert abs(sum(r.size for r in rows if r.old == r.shard) - stay) <= 16 * 91


def test_repeated_rows_are_spread(spark, tmp_path):
    rows = [(1, "same text")] * 900 + [(k, f"{k}") for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = resharding.reshard_files(d, F.lit(0), 1, 4, f"file://{tmp_path}/hot").collect()
    check(out, rows)
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 40


def test_number_of_blocks_is_bounded(spark):
    d = spark.createDataFrame([(k, "x" * 50) for k in range(3000)], "doc_id long, text string")
    seen, inner = {}, resharding.cut
    resharding.cut = lambda blocks, flow: seen.setdefault("pieces", inner(blocks, flow))
    try:
        out = resharding.reshard(resharding.sized(d, F.lit(0)), 1, 8, block_bytes=10, most_blocks=40).collect()
    finally:
        resharding.cut = inner
    check(out, [(r.doc_id, r.text) for r in d.collect()])
    assert len(seen["pieces"]) <= 40 + 8 + 8


def test_nothing(none):
    assert resharding.reshard(resharding.sized(none, F.lit(0)), 4, 8).count() == 0


def test_only_changed_shards_are_rewritten(spark, tmp_path):
    folder = f"file://{tmp_path}/shards"
    placed = spark.createDataFrame([(1, 0, 0, 0), (2, 1, 1, 0), (3, 1, 2, 0)], "doc_id long, old int, shard int, slot long")
    assert resharding.rewrite(placed, ["doc_id"], folder, 3) == [1, 2]
    assert sorted((r.shard, r.doc_id) for r in spark.read.parquet(folder).collect()) == [(1, 2), (2, 3)]
    assert resharding.rewrite(placed.filter("old = shard"), ["doc_id"], folder, 3) == []


def test_files_of_all_shards_are_written_and_old_ones_go(spark, docs, none, tmp_path):
    source = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    old = F.pmod(F.xxhash64("source"), F.lit(4)).cast("int")
    for shards in (8, 2):
        folder = f"{tmp_path}/to{shards}"
        check(resharding.reshard_files(docs, old, 4, shards, f"file://{folder}").collect(), source)
        files = spark.read.parquet(f"file://{folder}").collect()
        assert sorted(((r.doc_id, r.text) for r in files), key=repr) == source
        assert {r.shard for r in files} <= set(range(shards))
    assert resharding.reshard_files(none, old, 4, 8, f"file://{tmp_path}/none").count() == 0


def test_shards_that_stay_keep_their_files(spark, tmp_path):
    d = spark.createDataFrame([(i, "x" * 9) for i in range(40)], "doc_id long, text string")
    old = F.when(F.col("doc_id") < 20, 0).otherwise(F.when(F.col("doc_id") < 25, 1).otherwise(2))
    even = resharding.reshard_files(d, F.pmod("doc_id", F.lit(2)), 2, 2, f"file://{tmp_path}/even")
    check(even.collect(), [(r.doc_id, r.text) for r in d.collect()])
    assert sorted(r.doc_id for r in even.filter("shard = 0").collect()) == list(range(0, 40, 2))
    check(resharding.reshard_files(d, old, 3, 2, f"file://{tmp_path}/fewer").collect(), [(r.doc_id, r.text) for r in d.collect()])
    assert {p.name for p in (tmp_path / "fewer").glob("shard=*")} == {"shard=0", "shard=1"}


def test_rows_of_shards_that_are_gone_are_not_there_twice(spark, tmp_path):
    folder = f"file://{tmp_path}/shards"
    placed = spark.createDataFrame([(1, 0, 0, 0), (2, 1, 0, 1)], "doc_id long, old int, shard int, slot long")
    placed.withColumn("shard", F.col("old")).write.partitionBy("shard").parquet(folder)
    assert resharding.rewrite(placed, ["doc_id"], folder, 1) == [0]
    assert sorted(r.doc_id for r in spark.read.parquet(folder).collect()) == [1, 2]
