"""Resharding by minimum-cost flow.

Old shards are kept as blocks: rows of a shard whose tie hashes to the same
block.  Only block sizes reach the driver, and there are at most about 65,536
blocks, which grow with the data.  A minimum-cost flow from the
old shards' sizes to the new shards' capacities, where staying costs nothing
and moving costs a unit a byte, says how many bytes go from where to where;
it moves as few as any assignment can.  Blocks are cut along that flow, so a
shard gives away whole blocks and at most one part of a block for each
transfer.  Only files of shards that gain or lose rows are rewritten; those of
shards that no longer exist are removed.  The plan is made without texts; rows
are laid down with a number, by which the texts follow the plan and by which
they are dealt into blocks, so rows that repeat are spread like any others.

Defined cases: a null text has no bytes, so its row has size 1; null
identifiers hash like any value; rows that repeat are placed each, in an order
that hashes and sizes decide; an empty table gives no rows; other columns are
ignored by the query and kept by rewrite.  This method keeps no groups: equal
texts may go to different shards, since one group may exceed a shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import discard, new_folder, remove, settled, table, written


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Cheapest flow[i][j] that ships every supply i into capacities j; successive shortest paths with potentials."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, room, cost, index of the reverse
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a: int, b: int, room: int, price: int) -> int:
        out[a].append(len(edges))
        edges.append([b, room, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])
        return len(edges) - 2

    for i, s in enumerate(supply):
        add(source, i, s, 0)
    for j, c in enumerate(capacity):
        add(n + j, sink, c, 0)
    arcs = [[add(i, n + j, supply[i], cost[i][j]) for j in range(m)] for i in range(n)]
    height = [0] * (n + m + 2)
    while True:
        far, came = [None] * (n + m + 2), [-1] * (n + m + 2)
        far[source], heap = 0, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                b, room, price = edges[e]
                new = d + price + height[a] - height[b]
                if room and (far[b] is None or new < far[b]):
                    far[b], came[b] = new, e
                    heapq.heappush(heap, (new, b))
        if far[sink] is None:
            break
        height = [h + (f or 0) if f is not None else h for h, f in zip(height, far, strict=True)]
        path, at = [], sink
        while at != source:
            path.append(came[at])
            at = edges[came[at] ^ 1][0]
        push = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= push
            edges[e ^ 1][1] += push
    return [[edges[arcs[i][j] ^ 1][1] for j in range(m)] for i in range(n)]


def even(total: int, shards: int) -> list[int]:
    """Capacities that hold total, at most one apart."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def solve(old: list[int], shards: int, capacity: list[int] | None = None) -> list[list[int]]:
    """Bytes from each old shard to each new one: the fewest that move."""
    capacity = even(sum(old), shards) if capacity is None else capacity
    return min_cost_flow(old, capacity, [[int(i != j) for j in range(len(capacity))] for i in range(len(old))])


def cut(blocks: list[tuple[int, int, int]], flow: list[list[int]]) -> list[tuple[int, int, int, int, int]]:
    """blocks (old, block, bytes), sorted, along the flow: (old, block, from, to, new): bytes [from, to) of the block go to new.

    A shard keeps its first blocks, so that what stays is contiguous.
    """
    out, at = [], {}
    turns = {i: ([[i, row[i]]] if i < len(row) and row[i] else []) + [[j, x] for j, x in enumerate(row) if x and j != i] for i, row in enumerate(flow)}
    for old, block, size in blocks:
        done = 0
        while done < size:
            k = at.get(old, 0)
            new, left = turns[old][k]
            take = min(left, size - done)
            out.append((old, block, done, done + take, new))
            turns[old][k] = [new, left - take]
            done += take
            if not turns[old][k][1]:
                at[old] = k + 1
    return out


def reshard(rows: DataFrame, old_shards: int, shards: int, block_bytes: int = 1 << 26, capacity: list[int] | None = None, most_blocks: int = 1 << 16) -> DataFrame:
    """rows (old, size, tie, and others) with shard and slot, as a written table; a row goes where its middle byte in its block goes.

    tie orders rows inside a block; it should tell different rows apart.  There
    are at most most_blocks blocks and 8 for each old shard, and as many cuts
    as blocks and pairs of shards: that bounds what the driver sees, what is
    broadcast and the windows over blocks.
    """
    spark = rows.sparkSession
    sizes = [0] * old_shards
    for old, size in rows.groupBy("old").agg(F.sum("size")).collect():
        sizes[old] = size
    each = max(1, min(block_bytes, sum(sizes) // (8 * old_shards)), -(-sum(sizes) // most_blocks))  # a shard that holds most bytes has most blocks
    counts = F.array(*[F.lit(max(8, -(-size // each))) for size in sizes])
    hashed = rows.withColumn("block", F.pmod(F.xxhash64("tie", F.lit(1)), F.get(counts, F.col("old"))).cast("int"))
    inside = Window.partitionBy("old", "block").orderBy("tie", "size")
    placed = written(hashed.withColumn("middle", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.ceil(F.col("size") / 2)), "reshard-rows")
    blocks = sorted((r[0], r[1], r[2]) for r in placed.groupBy("old", "block").agg(F.sum("size")).collect())
    pieces = cut(blocks, solve(sizes, shards, capacity))
    where = spark.createDataFrame(pieces, "old int, block int, from long, to long, shard int")
    moved = placed.join(F.broadcast(where.withColumnsRenamed({"old": "o", "block": "b"})), (F.col("old") == F.col("o")) & (F.col("block") == F.col("b")) & (F.col("middle") >= F.col("from")) & (F.col("middle") < F.col("to"))).drop("o", "b", "from", "to")
    moved = written(moved, "reshard-moved")
    counts = moved.groupBy("shard", "old", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("old", "block")) - F.col("n")).drop("n")
    slot = F.row_number().over(Window.partitionBy("shard", "old", "block").orderBy("tie", "size")) - 1
    out = moved.withColumn("in_block", slot).join(F.broadcast(before), ["shard", "old", "block"]).withColumn("slot", (F.col("before") + F.col("in_block")).cast("long"))
    out = written(out.drop("before", "in_block", "middle", "block"), "reshard-planned")
    discard(placed, moved)
    return out


def rewrite(placed: DataFrame, columns: list[str], folder: str, shards: int) -> list[int]:
    """Writes folder/shard=N for every shard whose rows change (old differs from shard somewhere), others stay; returns these shards.  Files of old shards numbered shards or more are removed, as all their rows have moved.

    placed has old, shard, slot and the columns to write.  New files are
    written whole beside the old ones and take their place at the end.
    """
    spark = placed.sparkSession
    changed = placed.filter("old <> shard").select(F.explode(F.array("old", "shard")).alias("s")).distinct()
    changed = sorted(r[0] for r in changed.collect())  # at most as many as there are shards
    touched = [s for s in changed if s < shards]
    if not touched:
        return []
    placed.filter(F.col("shard").isin(touched)).select(*columns, "slot", "shard").write.partitionBy("shard").mode("overwrite").option("compression", "zstd").parquet(f"{folder}.new")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path(folder))
    for s in changed:
        new = fs_path(f"{folder}.new/shard={s}")
        remove(spark, f"{folder}/shard={s}")
        if s < shards and fs.exists(new) and not fs.rename(new, fs_path(f"{folder}/shard={s}")):
            raise OSError(f"shard {s} stays in {folder}.new")
    remove(spark, f"{folder}.new")
    return touched


def sized(docs: DataFrame, old: Column, *others: str) -> DataFrame:
    """doc_id, size, text_crc32, old, tie and other columns of documents (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), old.alias("old"), *others).withColumn("tie", F.xxhash64("doc_id", "size", "text_crc32"))


def reshard_files(docs: DataFrame, old: Column, old_shards: int, shards: int, folder: str) -> DataFrame:
    """Lays documents (doc_id, text) down in folder as old shards, reshards the files, and reads them: doc_id, size, text_crc32, shard, slot, as a written table."""
    spark = docs.sparkSession
    laid = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), old.cast("int").alias("shard")).withColumn("row", F.monotonically_increasing_id())
    laid.write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    reader = spark.read.schema("doc_id long, text string, row long, slot long, shard int")
    before = reader.parquet(folder)
    plan = reshard(sized(before, F.col("shard"), "row").withColumn("tie", F.xxhash64("row")), old_shards, shards)
    placed = plan.select("row", "old", "shard", "slot")
    texts = before.select("doc_id", "text", "row")
    touched = rewrite(texts.join(placed.hint("shuffle_hash"), "row"), ["doc_id", "text", "row"], folder, shards)
    after = reader.parquet(folder)
    stayed = after.filter(~F.col("shard").isin(touched)).drop("slot").join(placed.select("row", "slot"), "row")  # files as they were know no slot
    out = after.filter(F.col("shard").isin(touched)).unionByName(stayed)
    out = written(sized(out, F.col("shard"), "shard", "slot").select("doc_id", "size", "text_crc32", "shard", "slot"), "reshard-rows-read")
    discard(plan)
    return out


def op4_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From six shards by source, which are far from even, to eight of near equal bytes; the files go when they have been read."""

    def read_back() -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        out = reshard_files(docs, F.pmod(F.xxhash64("source"), F.lit(6)).cast("int"), 6, 8, new_folder(spark, "shards"))
        return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

    return settled(spark, "reshard-result", read_back)
