"""Column functions: what of the language needs no parser stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_decoded(c: Column) -> Column:
    """Percent escapes decoded as UTF-8; a plus stays a plus, and a percent sign that starts no escape stays."""
    lone = F.regexp_replace(c, r"%(?![0-9a-fA-F]{2})", "%25")
    return F.url_decode(F.replace(lone, F.lit("+"), F.lit("%2B")))


def bookmarklet_decoded(code: Column) -> Column:
    """The program of a `javascript:` address; other texts as they are."""
    return F.when(code.startswith("javascript:"), percent_decoded(F.substr(code, F.lit(12)))).otherwise(code)


def preview(code: Column) -> Column:
    """At most about a hundred characters: the first 70, an ellipsis, the last 30."""
    return F.when(F.length(code) <= 100, code).otherwise(F.concat(F.substr(code, F.lit(1), F.lit(70)), F.lit(" … "), F.right(code, F.lit(30))))


def module_path(module_id: Column, is_entry: Column) -> Column:
    """Where a module goes unless something names it."""
    return F.when(is_entry, "./index.js").otherwise(F.concat(F.lit("./"), F.regexp_replace(module_id, r"\.js$", ""), F.lit(".js")))


def escapes(path: Column) -> Column:
    """Whether a path could leave the folder it is written below; any step up is suspicious."""
    p = F.translate(path, "\\", "/")
    return p.startswith("/") | p.rlike(r"^[A-Za-z]:") | p.rlike(r"(^|/)\.\.(/|$)")


def title_case(c: Column) -> Column:
    """Words run together, each with a capital; other characters left out."""
    words = F.filter(F.transform(F.split(c, " "), lambda w: F.regexp_replace(w, r"[^A-Za-z0-9_$]", "")), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def identifier_test(c: Column) -> Column:
    """Whether a text is an identifier in ASCII (reserved words aside)."""
    return c.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$")


def to_int32(c: Column) -> Column:
    """A whole number's low 32 bits, signed."""
    low = F.pmod(c.cast("long"), F.lit(1 << 32))
    return F.when(low >= (1 << 31), low - F.lit(1 << 32)).otherwise(low)
