"""Rewriting of files as they arrive: stateless, so no watermark and no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptloom.js.pipeline import Options
from scriptloom.operators.programs import rewrite


def arriving_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that come into a folder, one program each."""
    df = spark.readStream.option("wholetext", True).text(path)
    return df.select(F.xxhash64("_metadata.file_path").alias("file_id"), F.col("value").alias("code"))


def rewrite_stream(programs: DataFrame, target: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Rewrites arriving programs into Parquet files and stops when all that is there is done."""
    out = rewrite(programs, options=options)
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
