"""Making the package importable in executors' Python workers."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def packed() -> bytes:
    """This package as a zip file."""
    root, out = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    return out.getvalue()


def on_one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process (local mode)."""
    return spark.sparkContext.master.startswith(("local[", "local ")) or spark.sparkContext.master == "local"


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per application, by Spark's own file distribution.

    It is placed in the folder that driver and executors share
    (spark.checkpoint.dir).  Without one, on a single machine, it is in a
    temporary one; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return spark
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        target = f"{shared.rstrip('/')}/code-{uuid.uuid4().hex}/scriptloom_pkg.zip"
        path = context._jvm.org.apache.hadoop.fs.Path(target)
        stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
        stream.write(bytearray(packed()))
        stream.close()
    elif not on_one_machine(spark):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    else:
        target = str(Path(tempfile.mkdtemp(prefix="scriptloom-")) / "scriptloom_pkg.zip")
        Path(target).write_bytes(packed())
    context.addPyFile(target)
    _shipped.add(context.applicationId)
    return spark
