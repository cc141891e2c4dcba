"""Stable names by role for variables whose names say nothing."""

from __future__ import annotations

import re
from collections.abc import Callable

from scriptloom.js import numbers
from scriptloom.js.ask import is_, is_ident, is_string, valid_identifier
from scriptloom.js.engine import Context, Rule
from scriptloom.js.interp import from_units, units
from scriptloom.js.nodes import Node
from scriptloom.js.scope import Binding, rename


def title(text: str) -> str:
    """Words run together, each with a capital; what no identifier holds is left out."""
    words = [re.sub(r"[^A-Za-z0-9_$]", "", w) for w in text.split(" ")]
    return "".join(w[:1].upper() + w[1:] for w in words if w)


def hint(n: Node | None) -> str:
    """What an initial value adds to a variable's name."""
    if n is None:
        return ""
    t = n.type
    if t == "Identifier":
        return title(n.name)
    if t == "NumericLiteral":
        return "LN" + re.sub(r"[^A-Za-z0-9_]", "_", numbers.to_text(n.value))
    if t == "StringLiteral":
        return "LS" + title(from_units(units(n.value)[:20]))
    if t in ("BooleanLiteral", "NullLiteral", "RegExpLiteral", "BigIntLiteral"):
        return "L" + {"BooleanLiteral": "B", "NullLiteral": "N", "RegExpLiteral": "R", "BigIntLiteral": "BI"}[t]
    if t == "ObjectExpression":
        return "O"
    if t == "ArrayExpression":
        return "A"
    if t in ("FunctionExpression", "ArrowFunctionExpression"):
        return "F"
    if t == "ClassExpression":
        return "C"
    if t in ("CallExpression", "NewExpression"):
        return hint(n.callee)
    if t == "MemberExpression":
        return hint(n.object) + (title(n.property.name) if not n.computed and n.property.type == "Identifier" else "")
    if t == "AwaitExpression":
        return hint(n.argument)
    if t == "ThisExpression":
        return "This"
    return ""


def required(n: Node | None) -> str | None:
    """A name from require("x")."""
    if is_(n, "CallExpression") and is_ident(n.callee, "require") and len(n.arguments) == 1 and is_string(n.arguments[0]):
        parts = [p for p in re.split(r"[^A-Za-z0-9_$]+", n.arguments[0].value) if p]
        name = "".join(p if i == 0 else p[:1].upper() + p[1:] for i, p in enumerate(parts))
        return name if valid_identifier(name) else None
    return None


def exported(n: Node) -> bool:
    x = n.parent if n.type != "VariableDeclarator" else n.parent.parent
    return x is not None and x.type == "ExportNamedDeclaration"


def role_name(b: Binding) -> str | None:
    """The name for a binding's role, or None to leave it as it is."""
    p = b.path
    if p.type in ("ClassDeclaration", "ClassExpression"):
        return None if p.type == "ClassDeclaration" and exported(p) else "C"
    if p.type in ("FunctionDeclaration", "FunctionExpression") and b.kind in ("hoisted", "local"):
        return None if exported(p) else "f"
    if b.kind == "module":
        return None
    if b.kind == "param":
        inside = b.ident
        while inside is not p:
            if inside.parent.type == "ObjectProperty":
                return None
            inside = inside.parent
        return "p"
    if p.type == "CatchClause":
        return "e"
    if p.type == "VariableDeclarator":
        if exported(p):
            return None
        if p.id.type == "Identifier":
            return required(p.init) or "v" + hint(p.init)
        x = b.ident.parent
        return None if x.type == "ObjectProperty" or (x.type == "AssignmentPattern" and x.parent.type == "ObjectProperty") else "v"
    return None


def mangle(ctx: Context, only: Callable[[str], bool] | None = None) -> int:
    """Renames bindings in the order they are declared; only those that the predicate wants."""
    n, scopes = 0, ctx.scopes
    order = {id(x): i for i, x in enumerate(ctx.program.walk())}
    for b in sorted(scopes.all, key=lambda b: order.get(id(b.ident), 0)):
        if only is not None and not only(b.name):
            continue
        wanted = role_name(b)
        if wanted is None or b.name == wanted:
            continue
        base, i, name = wanted, 2, wanted
        used = {x.name for x in scopes.all if x is not b} | scopes.globals.keys()
        while name in used or not valid_identifier(name):
            name, i = f"{base}{i}", i + 1
        rename(scopes, b, name)
        ctx.changed("mangle")
        ctx.at = ctx.version  # names changed in step with the analysis
        n += 1
    return n


def _program(n, ctx):
    return "done" if mangle(ctx) else None


MANGLE = Rule("mangle", {"Program": _program}, safe=False, scope=True)
BY_NAME = {"mangle": MANGLE}
