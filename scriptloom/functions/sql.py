"""SQL functions and table functions over programs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from scriptloom.session import ship


def _safely(f, code: str | None) -> str | None:
    try:
        return None if code is None else f(code)
    except Exception:  # a text that is no program has no result
        return None


def _rewriter(**options):
    def one(code: str) -> str:
        from scriptloom.js.pipeline import Options, rewrite

        return rewrite(code, Options(unpack=False, **options)).code

    @pandas_udf("string")
    def f(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: _safely(one, c))

    return f


def _folder():
    def one(text: str) -> str:
        from scriptloom.js.pipeline import transform

        return transform(f"({text})", ["number-expressions", "merge-strings", "evaluate-globals", "unminify-booleans"]).removesuffix(";")

    @pandas_udf("string")
    def f(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: _safely(one, c))

    return f


@udtf(returnType="node_id int, parent_id int, type string, name string, value string")
class JsNodes:
    def eval(self, code: str):
        from scriptloom.js.parser import parse

        try:
            tree = parse(code or "")
        except Exception:  # a text that is no program has no rows
            return
        ids = {}
        for i, n in enumerate(tree.walk()):
            ids[id(n)] = i
            value = getattr(n, "value", None)
            yield i, ids.get(id(n.parent)), n.type, getattr(n, "name", None) if isinstance(getattr(n, "name", None), str) else None, None if value is None or hasattr(value, "walk") else str(value)


@udtf(returnType="bundle_type string, module_id string, is_entry boolean, path string, code string")
class JsModules:
    def eval(self, code: str):
        from scriptloom.js.pipeline import rewrite

        try:
            b = rewrite(code or "").bundle
        except Exception:
            return
        for m in b.modules.values() if b else ():
            yield b.type, m.id, m.is_entry, m.path, m.code


@udtf(returnType="idx int, value string")
class JsStringArray:
    def eval(self, code: str):
        from scriptloom.js.deobfuscate import find_string_array
        from scriptloom.js.engine import Context
        from scriptloom.js.parser import parse

        try:
            a = find_string_array(Context(parse(code or "")))
        except Exception:
            return
        for i, v in enumerate(a.elements if a else ()):
            yield i, v


def register(spark: SparkSession) -> None:
    """js_unminify, js_deobfuscate, js_mangle, js_fold; js_nodes, js_modules, js_string_array."""
    ship(spark)
    spark.udf.register("js_unminify", _rewriter(deobfuscate=False))
    spark.udf.register("js_deobfuscate", _rewriter())
    spark.udf.register("js_mangle", _rewriter(deobfuscate=False, mangle=True))
    spark.udf.register("js_fold", _folder())
    spark.udtf.register("js_nodes", JsNodes)
    spark.udtf.register("js_modules", JsModules)
    spark.udtf.register("js_string_array", JsStringArray)
