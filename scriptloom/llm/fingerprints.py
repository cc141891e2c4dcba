"""Document fingerprints: bottom-k sketches of word shingle hashes.

A sketch is the k smallest distinct 64-bit hashes of a text's word 5-shingles,
in order.  Sketches of parts merge into the sketch of the whole, and two
sketches estimate resemblance, containment and the number of distinct
shingles.  Everything is DataFrame expressions.

Defined cases: a null text is an empty one; a text without words has an empty
sketch (empty string), which is alike (1.0) to another empty one and unlike
(0.0) to any other; fewer than five words are one shingle; equal texts have
equal sketches; among rows that repeat a doc_id the order is by the text's
hash; null doc_ids come last in descending order, ordered by the text's hash
among themselves; a single document is its own next one; an empty table gives
no rows; other columns are ignored.  An identifier that very many rows have, or
none, is cut by the text's hash; only rows that repeat both are held together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import lower_ascii, table

K = 128
SHINGLE = 5
BIAS = -(1 << 63)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """array<bigint>: the k smallest distinct shingle hashes, in order."""
    words = F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def over(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(h) - shingle)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(many)), 1, k))

    # one evaluation of the hashes for all that refer to them
    return F.get(F.transform(F.array(hashes), over), 0)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: of the k smallest of the union, the share in both."""
    both = merge(a, b, k)
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), both)) / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    reach = (F.element_at(a, -1).cast("double") - F.lit(float(BIAS))) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def printed(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash, joined."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def steps_of(docs: DataFrame, steps: int) -> tuple[list[int], list[int]]:
    """Quantiles of doc_id over all rows that have one, ascending, and how many steps each of them spans; an identifier that many rows have spans several."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / steps for i in range(1, steps)], max(10_000, 4 * steps))).first()[0] if steps > 1 else None
    spans: dict[int, int] = {}
    for c in cuts or ():
        spans[c] = spans.get(c, 0) + 1
    return list(spans), list(spans.values())


def numbers(values: list[int]) -> Column:
    """A constant array<bigint>, folded once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def table_of(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """Rows of whole numbers or nulls as a table, from constants."""
    if not rows:
        return spark.range(0).select(*[F.col("id").alias(n) for n in names])
    at, out = F.col("at").cast("int"), spark.range(len(rows)).withColumnRenamed("id", "at").coalesce(1)
    columns = zip(*rows, strict=True)
    return out.select(*[F.when(F.get(numbers([int(v is not None) for v in c]), at) == 1, F.get(numbers([v or 0 for v in c]), at)).alias(n) for n, c in zip(names, columns, strict=True)])


def buckets_of(docs: DataFrame, n: int, per_bucket: int, most: int) -> Column:
    """The bucket of a row of docs (doc_id, tie): a range of the descending order of identifiers, then of ties.

    Quantiles cut the identifiers.  One that spans k steps is alone in its
    range, and is cut into k + 1 even ranges of the tie, a hash; so are rows
    without an identifier, which come last.
    """
    steps = min(most, max(1, n // per_bucket))
    cuts, spans = steps_of(docs, steps)
    nulls = docs.filter("doc_id is null").count()
    null_steps = 1 + min(most, nulls // per_bucket)
    # Each cut opens a range from it on; a heavy one closes behind itself.
    starts, widths = [], []
    for c, k in zip(cuts, spans, strict=True):
        if not starts or starts[-1] != c:
            starts.append(c)
            widths.append(1)
        if k > 1:
            widths[-1] = k + 1
            if c < -BIAS - 1:
                starts.append(c + 1)
                widths.append(1)
    first, at = [], 1  # the bucket that a range starts with, counted up with identifiers
    for w in widths:
        first.append(at)
        at += w
    place = F.lit(0)  # how many ranges start at or below the identifier: a binary search
    if starts:
        known = numbers(starts)

        def halve(step: int) -> Callable[[Column], Column]:
            return lambda p: F.when(F.get(known, p + step - 1) <= F.col("doc_id"), p + step).otherwise(p)

        for bit in range(len(starts).bit_length() - 1, -1, -1):
            place = F.transform(F.array(place), halve(1 << bit))[0]

    def within(width: Column) -> Column:
        """Which even range of the tie, counted up with it."""
        share = F.shiftrightunsigned(F.col("tie"), 33)  # 31 bits; the sign comes first in the order
        return F.shiftright((share.bitwiseXOR(F.lit(1 << 30))) * width, 31)

    base, width = F.get(numbers([0, *first]), place), F.get(numbers([1, *widths]), place)
    # Identifiers are counted down and ties up: buckets ascend in the order of rows.
    known_row = -(base + width - 1) + within(width)
    return F.when(F.col("doc_id").isNull(), F.lit(1) + within(F.lit(null_steps))).otherwise(known_row).cast("long")


def with_next(docs: DataFrame, row: Callable[[], Column], per_bucket: int = 2_000, most: int = 65_536) -> DataFrame:
    """docs (with doc_id, tie) plus `own` and `next`: the column row() of each row and of the one that follows in descending doc_id; the last is followed by the first.

    The order is cut into ranges of about per_bucket rows, at most about `most`
    of them, and rows travel once, to their range's task; row() is computed
    there.  The first row of each range travels to the range before it.  What
    the driver sees is a row (bucket, doc_id, tie) for each range.
    """
    n = docs.count()
    bucket = buckets_of(docs, n, per_bucket, most)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), (-F.col("doc_id").cast("decimal(20,0)")).alias("down"), "tie")
    tops = docs.select(bucket.alias("bucket"), "doc_id", "tie").groupBy("bucket").agg(F.min_by(F.struct("doc_id", "tie"), order).alias("top")).collect()
    tops = sorted((r.bucket, r.top.doc_id, r.top.tie) for r in tops)  # bounded by most
    heads = [(tops[i - 1][0], *top[1:]) for i, top in enumerate(tops)]
    heads = table_of(docs.sparkSession, heads, ("before", "top_id", "top_tie"))
    # The first rows of ranges: a scan with a broadcast of a row for each range, then one row for each.
    first = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("tie") == F.col("top_tie"))).dropDuplicates(["before"])
    first = first.withColumn("outer", row()).select(F.col("before").alias("bucket"), "outer")
    inside = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "tie")
    placed = docs.withColumn("bucket", bucket).repartition("bucket").withColumn("own", row())
    chained = placed.withColumn("inner", F.lead("own").over(inside))
    return chained.join(first, "bucket").withColumn("next", F.coalesce("inner", "outer")).drop("inner", "outer", "bucket")


def fingerprint_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """The contract's row for every document (doc_id, text), and how the sketch stands to the edited text's: containment and distinct shingles."""
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumns({"n_chars": F.length("text").cast("long"), "tie": F.xxhash64("text")})
    chained = with_next(base, lambda: F.struct("text", sketch(F.col("text"), k).alias("sketch")))
    third = F.floor(F.col("n_chars") / 3)
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.col("next.text"), F.lit(1), third.cast("int")))
    out = chained.select("doc_id", "n_chars", F.col("own.sketch").alias("own"), F.col("next.sketch").alias("other"), edited.alias("edited")).withColumn("theirs", sketch(F.col("edited"), k))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), printed(F.col("own")).alias("fingerprint"), printed(F.col("theirs")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("theirs"), k).alias("near_edited"), resemblance(F.col("own"), F.col("other"), k).alias("near_next"),
        containment(F.col("own"), F.col("theirs"), k).alias("contained"), distinct_shingles(F.col("own"), k).alias("n_distinct"),
    )


def op10_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
