"""Exact deduplication as a stream over disk-backed keyed state.

Arriving documents are written once to the shared folder (the content store).
A streaming query reads that store and folds each document into state keyed
by the SHA-256 of its normalised text.  The state has no expiry, lives in
RocksDB with its log in the shared folder, and keeps per digest the smallest
stable identifier, the locator (file and row) of that document's content and
the number of hits.  The fold is an algebraic aggregate, so Spark combines
before the shuffle and a digest that a third of all rows share reaches its
state as one row a task.  Hits are then confirmed on full bytes; documents
whose digest is shared by different texts are grouped anew by the text itself.

Defined cases: a null text is an empty one; null identifiers come last when
the smallest is sought; rows that repeat identifier and text count as copies,
of which the one with the first locator stays; an empty table gives no rows;
other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm.common import new_folder, settled, table, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Repeated digests are broadcast up to so many (about 200 bytes each); beyond, the join is a shuffle.
BROADCAST_ROWS = 200_000
DECISION = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def normal_text(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fold_stream(spark: SparkSession, store: str, state: str, bytes_per_batch: int = 1 << 36) -> None:
    """Runs the stream over what the store holds and stops; a later call with the same state goes on from there."""
    schema = spark.read.parquet(store).schema
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate")
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in zip(names, (ROCKSDB, "true", "256", "false"), strict=True):
            spark.conf.set(k, v)
        arriving = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(store)
        place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        folded = arriving.select("digest", place.alias("place")).groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("hits"))
        folded.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """The state as a table: digest, first (no_id, id, file, row), hits."""
    kept = spark.read.format("statestore").load(state)
    value = kept.schema["value"].dataType.names
    return kept.select(F.col("key.digest").alias("digest"), F.col(f"value.`{value[0]}`").alias("first"), F.col(f"value.`{value[1]}`").alias("hits"))


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: row (all its columns), keep_id, group_size, kept, text_sha256, doc_id.

    docs has doc_id and text.  digest is a parameter so that tests can make digests collide.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "dedup")
    store, state = f"{folder}/store", f"{folder}/state"
    docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), digest(normal_text(F.col("text"))).alias("digest")).write.parquet(store)
    content = spark.read.parquet(store)
    if content.isEmpty():
        return content.select("row", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"), "doc_id")
    fold_stream(spark, store, state)
    seen = written(read_state(spark, state), "dedup-seen")
    here = content.select("row", "doc_id", "digest", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    repeated = seen.filter("hits > 1")
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # then no text is shuffled to find the hits
        repeated = F.broadcast(repeated)
    hits = here.select("doc_id", "digest", "file", "at", normal_text(F.col("row.text")).alias("text")).join(repeated, "digest")
    hits = written(hits, "dedup-hits")
    is_first = (F.col("file") == F.col("first.file")) & (F.col("at") == F.col("first.row"))
    first_text = hits.filter(is_first).select("digest", F.col("text").alias("first_text"))
    # No aggregation right behind the join: then Spark may split a digest that most rows share over several tasks.
    unequal = written(hits.join(first_text, "digest").filter("text <> first_text").select("digest"), "dedup-unequal").distinct()
    marked = here.join(seen, "digest").select("row", F.col("first.id").alias("keep_id"), F.col("hits").alias("group_size"), is_first.alias("kept"), "digest", "doc_id", "file", "at")
    if not unequal.isEmpty():  # digests that different texts share: these documents are grouped by the text itself
        place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "file", "at")
        again = hits.join(unequal, "digest", "left_semi")
        groups = again.groupBy("digest", "text").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("size"))
        anew = again.join(groups, ["digest", "text"]).select(F.col("file").alias("f"), F.col("at").alias("a"), "least", "size")
        marked = marked.join(anew, (F.col("file") == F.col("f")) & (F.col("at") == F.col("a")), "left")
        got = F.col("size").isNotNull()
        marked = marked.withColumns({
            "keep_id": F.when(got, F.col("least.id")).otherwise(F.col("keep_id")),
            "group_size": F.coalesce("size", "group_size"),
            "kept": F.when(got, (F.col("least.file") == F.col("file")) & (F.col("least.at") == F.col("at"))).otherwise(F.col("kept")),
        })
    return marked.select("row", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"), "doc_id")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs without later copies, all columns as they were."""
    return deduplicate(docs).filter("kept").select("row.*")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return settled(spark, "dedup-decisions", lambda: deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*DECISION))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
