"""Where programs come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.functions.columns import bookmarklet_decoded


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One program per file: file_id (a hash of the path), path, origin, code."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("code"))
    return df.select(F.xxhash64("path").alias("file_id"), "path", F.lit("file").alias("origin"), "code")


def from_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Programs given as values, as standard input gives them."""
    return spark.createDataFrame([(i, None, "text", t) for i, t in enumerate(texts)], "file_id long, path string, origin string, code string")


def inline_scripts(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """The scripts that stand in pages: page_id, idx, code."""
    found = F.regexp_extract_all(F.col(html_column), F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))
    return pages.select(id_column, F.posexplode(found).alias("idx", "code"))


def bookmarklets(df: DataFrame, code_column: str = "code") -> DataFrame:
    """Programs whose `javascript:` addresses are decoded, in the JVM."""
    return df.withColumn(code_column, bookmarklet_decoded(F.col(code_column)))
