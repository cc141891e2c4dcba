"""Questions about single nodes that many rules ask."""

from __future__ import annotations

import re

from scriptloom.js.nodes import FUNCTIONS, Node

IDENTIFIER = re.compile(r"(?:[^\W\d]|[$_])(?:\w|[$\u200c\u200d])*")
# Words that are no identifiers.
RESERVED = set("break case catch class const continue debugger default delete do else enum export extends false finally for function if implements import in instanceof interface let new null package private protected public return static super switch this throw true try typeof var void while with yield await".split())


def is_(n: Node | None, type_: str, **fields) -> bool:
    return n is not None and n.type == type_ and all(n.__dict__.get(k) == v for k, v in fields.items())


def is_ident(n: Node | None, name: str | None = None) -> bool:
    return n is not None and n.type == "Identifier" and (name is None or n.name == name)


def is_string(n: Node | None) -> bool:
    return n is not None and n.type == "StringLiteral"


def is_number(n: Node | None, value=None) -> bool:
    return n is not None and n.type == "NumericLiteral" and (value is None or n.value == value)


def is_literal(n: Node | None) -> bool:
    """A literal of any kind; templates only without expressions."""
    if n is None:
        return False
    return n.type in ("StringLiteral", "NumericLiteral", "BooleanLiteral", "NullLiteral", "BigIntLiteral", "RegExpLiteral") or (n.type == "TemplateLiteral" and not n.expressions)


def is_undefined(n: Node | None) -> bool:
    return is_ident(n, "undefined") or (is_(n, "UnaryExpression", operator="void") and is_number(n.argument, 0))


def is_null(n: Node | None) -> bool:
    return is_(n, "NullLiteral")


def is_true(n: Node | None) -> bool:
    """true, !0, !!1 and !![]."""
    if is_(n, "BooleanLiteral", value=True):
        return True
    if not is_(n, "UnaryExpression", operator="!"):
        return False
    a = n.argument
    return is_number(a, 0) or (is_(a, "UnaryExpression", operator="!") and (is_number(a.argument, 1) or (is_(a.argument, "ArrayExpression") and not a.argument.elements)))


def is_false(n: Node | None) -> bool:
    """false and ![]."""
    return is_(n, "BooleanLiteral", value=False) or (is_(n, "UnaryExpression", operator="!") and is_(n.argument, "ArrayExpression") and not n.argument.elements)


def is_truthy(n: Node | None) -> bool:
    return is_true(n) or (is_(n, "ArrayExpression") and not n.elements)


def is_infinite_loop(n: Node) -> bool:
    """for (;;), for (; true;) and while (true)."""
    if n.type == "ForStatement":
        return n.init is None and n.update is None and (n.test is None or is_truthy(n.test))
    return n.type == "WhileStatement" and is_truthy(n.test)


def is_member(n: Node | None, obj=None, prop: str | None = None) -> bool:
    """a.b or a["b"], with the object's name or test and the property's name, where given."""
    if n is None or n.type != "MemberExpression":
        return False
    if obj is not None and not (is_ident(n.object, obj) if isinstance(obj, str) else obj(n.object)):
        return False
    name = prop_name(n)
    return name is not None if prop is None else name == prop


def prop_name(n: Node) -> str | None:
    """The constant key of a member, property or method."""
    k = n.property if n.type in ("MemberExpression", "OptionalMemberExpression") else n.key
    if not n.computed and k.type == "Identifier":
        return k.name
    if k.type == "StringLiteral":
        return k.value
    if k.type == "NumericLiteral":
        from scriptloom.js.numbers import to_text

        return to_text(k.value)
    return None


def is_anonymous(n: Node | None) -> bool:
    return n is not None and ((n.type == "FunctionExpression" and n.id is None and not n.generator) or n.type == "ArrowFunctionExpression")


def is_iife(n: Node | None) -> bool:
    return is_(n, "CallExpression") and is_anonymous(n.callee)


def valid_identifier(name: str) -> bool:
    return bool(IDENTIFIER.fullmatch(name)) and name not in RESERVED


def function_of(n: Node) -> Node | None:
    return n.find_up(lambda x: x.type in FUNCTIONS)


def is_pure(n: Node | None) -> bool:
    """Whether evaluating it can neither do nor meet anything."""
    if n is None or is_literal(n) or is_undefined(n):
        return True
    t = n.type
    if t == "UnaryExpression":
        return n.operator in ("-", "+", "!", "~", "void", "typeof") and is_pure(n.argument)
    if t in ("BinaryExpression", "LogicalExpression"):
        return is_pure(n.left) and is_pure(n.right)
    if t == "TemplateLiteral":
        return all(map(is_pure, n.expressions))
    if t == "ArrayExpression":
        return all(map(is_pure, n.elements))
    if t == "ObjectExpression":
        return all(p.type == "ObjectProperty" and (not p.computed or is_pure(p.key)) and is_pure(p.value) for p in n.properties)
    return False


def any_sublist(nodes: list[Node], *tests) -> list[Node] | None:
    """The first nodes that fit the tests in this order, others between them, or None."""
    out = []
    for n in nodes:
        if len(out) < len(tests) and tests[len(out)](n):
            out.append(n)
    return out if len(out) == len(tests) else None
