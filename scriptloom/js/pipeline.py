"""From one text to another: all stages over one program."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from collections.abc import Callable

from scriptloom.js import deobfuscate as deob
from scriptloom.js import transpile, unminify
from scriptloom.js.engine import Context, apply
from scriptloom.js.nodes import Node
from scriptloom.js.parser import parse
from scriptloom.js.printer import to_code

STAGES = ("after_parse", "after_prepare", "after_deobfuscate", "after_unminify", "after_unpack")


@dataclass(frozen=True)
class Options:
    """What to do; plugins are callables (program, context) by stage name; mappings name unpacked modules.

    sandbox replaces the restricted interpreter: it is called once with the
    text of a program that ends in a list, and returns the list's values.
    recover leaves statements that cannot be read as they are, and goes on.
    """

    jsx: bool = True
    unpack: bool = True
    deobfuscate: bool = True
    unminify: bool = True
    mangle: bool | Callable[[str], bool] = False
    force_control_flow: bool = False
    recover: bool = False
    steps: int = 3_000_000
    sandbox: Callable[[str], list] | None = None
    plugins: dict = field(default_factory=dict)
    mappings: dict = field(default_factory=dict)


def decode_bookmarklet(code: str) -> str:
    """`javascript:` off, and its percent escapes decoded; a percent sign that starts none stays."""
    if not code.startswith("javascript:"):
        return code
    from scriptloom.js.interp import Thrown, decode_uri

    parts = re.split(r"%(?![0-9a-fA-F]{2})", code[len("javascript:") :])

    def one(p: str) -> str:
        try:
            return decode_uri(p)
        except Thrown:
            return p

    return "%".join(map(one, parts))


def rules_named(names: list[str]) -> list:
    """Rules by name, from all stages."""
    from scriptloom.js import jsx, mangle

    known = {**unminify.BY_NAME, **transpile.BY_NAME, **deob.BY_NAME, **jsx.BY_NAME, **mangle.BY_NAME}
    return [known[n] for n in names]


def transform(code: str, names: list[str]) -> str:
    """Only some rules, in one pass."""
    tree = parse(code)
    apply(Context(tree), rules_named(names))
    return to_code(tree, marks=True)


class Result:
    def __init__(self, code: str, bundle, changes: dict, tree: Node):
        self.code, self.bundle, self.changes, self.tree = code, bundle, changes, tree
        self.errors: list[str] = getattr(tree, "errors", [])


def rewrite(code: str, options: Options = Options()) -> Result:
    """The whole pipeline on one program; raises JsSyntaxError if it is none, unless recover is on."""
    from scriptloom.js import jsx, mangle, unpack

    tree = parse(decode_bookmarklet(code), options.jsx, options.recover)
    ctx = Context(tree)

    def plugins(stage: str) -> None:
        for f in options.plugins.get(stage, ()):
            f(tree, ctx)
            ctx.version += 1

    plugins("after_parse")
    apply(ctx, unminify.PREPARE)
    plugins("after_prepare")
    if options.deobfuscate:
        deob.deobfuscate(ctx, options.force_control_flow, options.steps, options.sandbox)
    plugins("after_deobfuscate")
    if options.unminify:
        apply(ctx, transpile.RULES + unminify.RULES)
    plugins("after_unminify")
    if options.mangle:
        mangle.mangle(ctx, options.mangle if callable(options.mangle) else None)
    last = [deob.SELF_DEFENDING, deob.DEBUG_PROTECTION] * options.deobfuscate + jsx.RULES * options.jsx
    if last:
        apply(ctx, last)
    if options.deobfuscate:
        apply(ctx, [deob.MERGE_OBJECT_ASSIGNMENTS, deob.EVALUATE_GLOBALS])
    out = to_code(tree, marks=True)
    bundle = unpack.unpack(tree, options.mappings) if options.unpack else None
    plugins("after_unpack")
    return Result(out, bundle, dict(ctx.changes), tree)
