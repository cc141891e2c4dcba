"""Where results go."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.functions.columns import escapes


class UnsafePath(ValueError):
    """A module's path would leave the output folder."""


def save_table(df: DataFrame, path: str, force: bool = False) -> None:
    """Results as Parquet; an existing folder is refused unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def check_paths(modules: DataFrame) -> None:
    """Raises UnsafePath, before anything is written, if any module's path leaves its folder."""
    bad = modules.filter(escapes(F.col("path"))).select("path").limit(1).collect()
    if bad:
        raise UnsafePath(bad[0][0])


def save_modules(modules: DataFrame, path: str, force: bool = False) -> None:
    """Bundles as folders file_id=N, each with its modules; the guard comes first."""
    check_paths(modules)
    modules.write.partitionBy("file_id").mode("overwrite" if force else "errorifexists").json(path)


def save_bundle_files(bundle, folder: str) -> None:
    """One bundle as bundle.json and a file for each module, below a local folder."""
    import os

    from scriptloom.js import paths

    for m in bundle.modules.values():
        if paths.escapes(m.path):
            raise UnsafePath(m.path)
    os.makedirs(folder, exist_ok=True)
    listed = {"type": bundle.type, "entryId": bundle.entry_id, "modules": [{"id": m.id, "path": m.path} for m in bundle.modules.values()]}
    with open(os.path.join(folder, "bundle.json"), "w", encoding="utf-8") as f:
        json.dump(listed, f, indent=2)
    for m in bundle.modules.values():
        target = os.path.join(folder, m.path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "w", encoding="utf-8") as f:
            f.write(m.code)
