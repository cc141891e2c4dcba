"""Rewrites that undo what minifiers do."""

from __future__ import annotations

import json
import math

from scriptloom.js import numbers
from scriptloom.js.ask import IDENTIFIER, is_, is_ident, is_literal, is_number, is_pure, is_string, is_undefined
from scriptloom.js.engine import DONE, Again, Rule, Skip
from scriptloom.js.nodes import Node, block, boolean, expr, ident, number, string
from scriptloom.js.parser import JsSyntaxError, parse_expression
from scriptloom.js.reuse import as_float, as_int

RULES: list[Rule] = []


def rule(name: str, types: str, **flags):
    """Registers a handler; several handlers of one name make one rule."""

    def add(f):
        known = next((r for r in RULES if r.name == name), None)
        if known is None:
            known = Rule(name, {}, **flags)
            RULES.append(known)
        known.handlers[types] = f
        return f

    return add


def in_list(n: Node) -> bool:
    """Whether statements can be put before a statement."""
    return n.parent is not None and ((n.parent.type in ("Program", "BlockStatement", "StaticBlock") and n.key() == "body") or n.parent.type == "SwitchCase")


def before(n: Node, exprs: list[Node]) -> list[Node]:
    return [*map(expr, exprs), n]


@rule("block-statements", "IfStatement")
def _(n, ctx):
    made = []
    for k in ("consequent", "alternate"):
        x = getattr(n, k)
        if x is not None and x.type not in ("BlockStatement", "EmptyStatement") and not (k == "alternate" and x.type == "IfStatement"):
            made.append(block(x))
            n.set(k, made[-1])
    return Again(*made) if made else None


@rule("block-statements", "ForStatement|ForInStatement|ForOfStatement|WhileStatement|DoWhileStatement")
def _(n, ctx):
    if n.body.type not in ("BlockStatement", "EmptyStatement"):
        n.set("body", block(n.body))
        return Again(n.body)
    return None


@rule("block-statements", "ArrowFunctionExpression")
def _(n, ctx):
    if n.body.type == "SequenceExpression":
        n.set("body", block(Node("ReturnStatement", argument=n.body)))
        return True
    return None


@rule("computed-properties", "MemberExpression|OptionalMemberExpression")
def _(n, ctx):
    if n.computed and is_string(n.property) and IDENTIFIER.fullmatch(n.property.value):
        n.computed = False
        n.set("property", ident(n.property.value))
        return DONE
    return None


@rule("computed-properties", "ObjectProperty|ObjectMethod|ClassMethod|ClassProperty")
def _(n, ctx):
    if not is_string(n.key):
        return None
    name = n.key.value
    if n.computed and (n.type == "ClassMethod" and name == "constructor" or n.type == "ObjectProperty" and name == "__proto__"):
        return None
    if IDENTIFIER.fullmatch(name):
        n.set("key", ident(name))
    elif not n.computed:
        return None
    n.computed = False
    return DONE


@rule("for-to-while", "ForStatement")
def _(n, ctx):
    if n.init is None and n.update is None:
        return Node("WhileStatement", test=n.test or boolean(True), body=n.body)
    return None


@rule("infinity", "BinaryExpression", scope=True)
def _(n, ctx):
    if n.operator != "/" or not is_number(n.right, 0):
        return None
    minus = is_(n.left, "UnaryExpression", operator="-") and is_number(n.left.argument, 1)
    if (minus or is_number(n.left, 1)) and not ctx.scopes.is_bound(n, "Infinity"):
        return Node("UnaryExpression", operator="-", argument=ident("Infinity")) if minus else ident("Infinity")
    return None


# Equality operators and their opposites.
OPPOSITE = {"==": "!=", "===": "!==", "!=": "==", "!==": "==="}


@rule("invert-boolean-logic", "UnaryExpression")
def _(n, ctx):
    a = n.argument
    if n.operator != "!":
        return None
    if a.type == "BinaryExpression" and a.operator in OPPOSITE:
        return Node("BinaryExpression", operator=OPPOSITE[a.operator], left=a.left, right=a.right)
    if a.type != "LogicalExpression" or a.operator == "??":
        return None

    def deny(e: Node) -> Node:
        return Node("UnaryExpression", operator="!", argument=e)

    def turn(e: Node) -> Node:
        if e.type == "LogicalExpression" and e.operator in ("&&", "||"):
            return Node("LogicalExpression", operator="||" if e.operator == "&&" else "&&", left=turn(e.left), right=deny(e.right))
        return deny(e)

    return turn(a)


def json_tree(value) -> Node:
    if value is None:
        return Node("NullLiteral")
    if isinstance(value, bool):
        return boolean(value)
    if isinstance(value, (int, float)):
        return number(value)
    if isinstance(value, str):
        return string(value)
    if isinstance(value, list):
        return Node("ArrayExpression", elements=[json_tree(x) for x in value])
    return Node("ObjectExpression", properties=[Node("ObjectProperty", key=string(k), value=json_tree(v), computed=False, shorthand=False) for k, v in value])


@rule("json-parse", "CallExpression", scope=True)
def _(n, ctx):
    c = n.callee
    if not (c.type == "MemberExpression" and is_ident(c.object, "JSON") and (is_ident(c.property, "parse") and not c.computed or is_string(c.property) and c.property.value == "parse") and len(n.arguments) == 1 and is_string(n.arguments[0])):
        return None
    if ctx.scopes.is_bound(n, "JSON"):
        return None
    try:
        json.loads(n.arguments[0].value, parse_constant=lambda x: json.loads("!"))
        return parse_expression("(" + n.arguments[0].value + ")")
    except (ValueError, JsSyntaxError):
        return None


@rule("logical-to-if", "ExpressionStatement")
def _(n, ctx):
    e = n.expression
    if e.type != "LogicalExpression" or e.operator == "??":
        return None
    test = e.left if e.operator == "&&" else Node("UnaryExpression", operator="!", argument=e.left)
    return Node("IfStatement", test=test, consequent=block(expr(e.right)), alternate=None)


@rule("merge-else-if", "IfStatement")
def _(n, ctx):
    alt = n.alternate
    if is_(alt, "BlockStatement") and len(alt.body) == 1 and alt.body[0].type == "IfStatement":
        n.set("alternate", alt.body[0])
        return DONE
    return None


@rule("merge-strings", "BinaryExpression")
def _(n, ctx):
    if n.operator != "+" or not is_string(n.right):
        return None
    if is_string(n.left):
        return string(n.left.value + n.right.value)
    if is_(n.left, "BinaryExpression", operator="+") and is_string(n.left.right):
        return Node("BinaryExpression", operator="+", left=n.left.left, right=string(n.left.right.value + n.right.value))
    return None


def literal_value(n: Node, turn: int) -> float | str | None:
    """The value of a number expression's part: numbers, strings and what they make.

    A node keeps what was found in a pass, so an operand is worked out once,
    however long the chain above it is.
    """
    if n.type == "NumericLiteral":
        return as_float(n.value)
    if n.type == "StringLiteral":
        return n.value
    if n.type not in ("UnaryExpression", "BinaryExpression"):
        return None
    known = n.__dict__.get("worth")
    if known is None or known[0] != turn:
        known = n.worth = (turn, operated(n, turn))
    return known[1]


def constant_value(n: Node) -> float | str | None:
    """The value of a subtree as it stands now."""
    return literal_value(n, object())


def operated(n: Node, turn: int) -> float | str | None:
    if n.type == "UnaryExpression":
        v = literal_value(n.argument, turn) if n.operator == "-" else None
        return None if v is None else -(v if isinstance(v, float) else numbers.from_text(v))
    if n.operator not in ("+", "-", "/", "%", "*", "**", "&", "|", ">>", ">>>", "<<", "^"):
        return None
    b = literal_value(n.right, turn)
    a = None if b is None else literal_value(n.left, turn)
    if a is None:
        return None
    if n.operator == "+" and (isinstance(a, str) or isinstance(b, str)):
        return (a if isinstance(a, str) else numbers.to_text(a)) + (b if isinstance(b, str) else numbers.to_text(b))
    return numbers.binary(n.operator, *(x if isinstance(x, float) else numbers.from_text(x) for x in (a, b)))


@rule("number-expressions", "UnaryExpression|BinaryExpression")
def _(n, ctx):
    if n.type == "UnaryExpression" and (n.operator != "-" or is_number(n.argument)):
        return None
    n.__dict__.pop("worth", None)  # its parts may have changed since it was asked for
    v = literal_value(n, ctx.turn)
    if isinstance(v, str) and n.type == "BinaryExpression":
        return string(v)
    if not isinstance(v, float) or not (v.is_integer() or math.isfinite(v)):
        return None
    if n.type == "BinaryExpression" and n.operator == "/" and not v.is_integer():
        return None
    return Skip(number(as_int(v) if v.is_integer() and abs(v) < 2**53 else v))


@rule("raw-literals", "StringLiteral|NumericLiteral")
def _(n, ctx):
    if getattr(n, "raw", None) is not None:
        n.raw = None  # the printer spells values, never what was read
    return None


@rule("remove-double-not", "IfStatement|ConditionalExpression|WhileStatement|DoWhileStatement|ForStatement")
def _(n, ctx):
    if is_(n.test, "UnaryExpression", operator="!") and is_(n.test.argument, "UnaryExpression", operator="!"):
        n.set("test", n.test.argument.argument)
        return DONE
    return None


@rule("remove-double-not", "UnaryExpression")
def _(n, ctx):
    a = n.argument
    if n.operator == "!" and is_(a, "UnaryExpression", operator="!") and is_(a.argument, "UnaryExpression", operator="!"):
        return a.argument
    return None


# Array methods that ask their callback for a truth value.
ASKING = {"filter", "find", "findLast", "findIndex", "findLastIndex", "some", "every"}


@rule("remove-double-not", "CallExpression")
def _(n, ctx):
    c = n.callee
    if not (c.type == "MemberExpression" and c.object.type == "ArrayExpression" and (getattr(c.property, "name", None) or getattr(c.property, "value", None)) in ASKING and len(n.arguments) == 1 and n.arguments[0].type == "ArrowFunctionExpression"):
        return None
    b = n.arguments[0].body
    if is_(b, "UnaryExpression", operator="!") and is_(b.argument, "UnaryExpression", operator="!"):
        n.arguments[0].set("body", b.argument.argument)
        return DONE
    return None


@rule("sequence", "ExpressionStatement")
def _(n, ctx):
    e = n.expression
    if e.type == "SequenceExpression":
        return [expr(x) for x in e.expressions]
    return None


def lift(key: str):
    """Puts all but the last of a sequence in a field before the statement."""

    def f(n, ctx):
        e = getattr(n, key)
        if e is None or e.type != "SequenceExpression" or not can_precede(n):
            return None
        n.set(key, e.expressions[-1])
        return before(n, e.expressions[:-1])

    return f


def can_precede(n: Node) -> bool:
    return in_list(n) or (n.parent is not None and n.parent.type in ("IfStatement", "ForStatement", "ForInStatement", "ForOfStatement", "WhileStatement", "DoWhileStatement") and n.key() != "init")


for _types, _key in (("ReturnStatement", "argument"), ("IfStatement", "test"), ("SwitchStatement", "discriminant"), ("ThrowStatement", "argument"), ("ForInStatement|ForOfStatement", "right")):
    rule("sequence", _types)(lift(_key))


@rule("sequence", "ForStatement")
def _(n, ctx):
    out = None
    if is_(n.update, "SequenceExpression") and n.body.type == "EmptyStatement":
        *first, last = n.update.expressions
        n.set("update", last)
        n.set("body", block(*map(expr, first)))
        out = DONE
    if is_(n.init, "SequenceExpression") and can_precede(n):
        first, n.init = n.init.expressions, None
        return before(n, first)
    return out


@rule("sequence", "VariableDeclaration")
def _(n, ctx):
    if len(n.declarations) != 1 or not is_(n.declarations[0].init, "SequenceExpression"):
        return None
    d, s = n.declarations[0], n
    if n.parent.type == "ForStatement":
        s = n.parent
    elif n.parent.type == "ExportNamedDeclaration":
        s = n.parent
    if n.parent.type in ("ForInStatement", "ForOfStatement") or not in_list(s):
        return None
    *first, last = d.init.expressions
    d.set("init", last)
    k, i = s.place()
    new = [*map(expr, first)]
    s.parent.__dict__[k][i:i] = new
    for x in new:
        x.parent = s.parent
    return DONE


# Assignments in which a sequence on the right may go first.
ORDERED = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "|=", "^=", "&="}


def stable_target(n: Node) -> bool:
    """A target that evaluating something else first does not change: a variable, or members of one by constant keys."""
    if n.type == "Identifier":
        return True
    return n.type == "MemberExpression" and n.object.type in ("Identifier", "ThisExpression") and (not n.computed or is_literal(n.property))


@rule("sequence", "AssignmentExpression")
def _(n, ctx):
    if n.operator not in ORDERED or n.right.type != "SequenceExpression" or not stable_target(n.left):
        return None
    *first, last = n.right.expressions
    if n.parent.type == "ExpressionStatement" and in_list(n.parent):
        s = n.parent
        n.set("right", last)
        k, i = s.place()
        new = [*map(expr, first)]
        s.parent.__dict__[k][i:i] = new
        for x in new:
            x.parent = s.parent
        return DONE
    return Node("SequenceExpression", expressions=[*first, Node("AssignmentExpression", operator=n.operator, left=n.left, right=last)])


@rule("sequence", "SequenceExpression")
def _(n, ctx):
    if all(map(is_literal, n.expressions)):
        return n.expressions[-1]
    if any(x.type == "SequenceExpression" for x in n.expressions):
        n.set("expressions", [y for x in n.expressions for y in (x.expressions if x.type == "SequenceExpression" else [x])])
        return DONE
    return None


@rule("split-for-loop-vars", "ForStatement", scope=True)
def _(n, ctx):
    d = n.init
    if not is_(d, "VariableDeclaration", kind="var") or not in_list(n):
        return None
    used = {x.name for part in (n.test, n.update) if part is not None for x in part.walk() if x.type == "Identifier"}
    out = []
    while d.declarations and is_ident(d.declarations[0].id) and d.declarations[0].id.name not in used:
        out.append(Node("VariableDeclaration", kind="var", declarations=[d.declarations.pop(0)]))
    if not out:
        return None
    if not d.declarations:
        n.init = None
    return [*out, n]


@rule("split-variable-declarations", "VariableDeclaration")
def _(n, ctx):
    if len(n.declarations) < 2:
        return None
    p = n.parent
    split = [Node("VariableDeclaration", kind=n.kind, declarations=[x]) for x in n.declarations]
    if p.type == "ExportNamedDeclaration":
        k, i = p.place()
        new = [Node("ExportNamedDeclaration", declaration=x, specifiers=[], source=None) for x in split]
        p.parent.__dict__[k][i : i + 1] = new
        for x in new:
            x.parent = p.parent
        p.parent = None
        return DONE
    if p.type == "ForStatement" and p.init is n:
        if n.kind != "var" or p.test is not None or p.update is not None or not in_list(p):
            return None
        p.init = None
        k, i = p.place()
        p.parent.__dict__[k][i:i] = split
        for x in split:
            x.parent = p.parent
        return DONE
    if in_list(n):
        return split
    if p.type in ("IfStatement", "ForStatement", "ForInStatement", "ForOfStatement", "WhileStatement", "DoWhileStatement") and n.key() in ("body", "consequent", "alternate"):
        return block(*split)
    return None


def template_text(value: str) -> str:
    """A string as raw text of a template."""
    return value.replace("\\", "\\\\").replace("`", "\\`").replace("${", "\\${").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace("\b", "\\b").replace("\f", "\\f").replace("\v", "\\v").replace("\0", "\\0")


@rule("string-literal-in-template", "TemplateLiteral")
def _(n, ctx):
    if n.parent is not None and n.parent.type == "TaggedTemplateExpression":
        return None
    at = next((i for i, e in enumerate(n.expressions) if is_string(e)), None)
    if at is None:
        return None
    while at is not None:
        raw = n.quasis[at].raw + template_text(n.expressions[at].value) + n.quasis[at + 1].raw
        q, e = list(n.quasis), list(n.expressions)
        q[at : at + 2] = [Node("TemplateElement", raw=raw, cooked=raw)]
        del e[at]
        n.set("quasis", q)
        n.set("expressions", e)
        at = next((i for i, x in enumerate(e) if is_string(x)), None)
    return DONE


@rule("ternary-to-if", "ExpressionStatement")
def _(n, ctx):
    e = n.expression
    if e.type == "ConditionalExpression":
        return Node("IfStatement", test=e.test, consequent=block(expr(e.consequent)), alternate=block(expr(e.alternate)))
    return None


@rule("ternary-to-if", "ReturnStatement")
def _(n, ctx):
    e = n.argument
    if is_(e, "ConditionalExpression"):
        return Node("IfStatement", test=e.test, consequent=block(Node("ReturnStatement", argument=e.consequent)), alternate=block(Node("ReturnStatement", argument=e.alternate)))
    return None


@rule("truncate-number-literal", "BinaryExpression")
def _(n, ctx):
    if n.operator not in ("|", "&", "^", "<<", ">>", ">>>"):
        return None
    out = None
    for side in ("left", "right"):
        x = getattr(n, side)
        if not is_number(x):
            continue
        v = numbers.to_int32(float(x.value))
        if side == "right" and n.operator in ("<<", ">>"):
            v &= 31
        if v != x.value:
            n.set(side, number(v))
            out = DONE
    return out


@rule("typeof-undefined", "BinaryExpression")
def _(n, ctx):
    if n.operator in ("<", ">") and is_(n.left, "UnaryExpression", operator="typeof") and is_string(n.right) and n.right.value == "u":
        return Node("BinaryExpression", operator="===" if n.operator == ">" else "!==", left=n.left, right=string("undefined"))
    return None


@rule("unary-expressions", "ExpressionStatement")
def _(n, ctx):
    e = n.expression
    if e.type == "UnaryExpression" and e.operator in ("void", "!", "typeof"):
        return expr(e.argument)
    return None


@rule("unary-expressions", "ReturnStatement")
def _(n, ctx):
    if is_(n.argument, "UnaryExpression", operator="void") and not is_undefined(n.argument):
        return [expr(n.argument.argument), Node("ReturnStatement", argument=None)]
    return None


@rule("unminify-booleans", "UnaryExpression")
def _(n, ctx):
    if n.operator != "!":
        return None
    a = n.argument
    if is_number(a, 0) or is_number(a, 1):
        return boolean(a.value == 0)
    if is_(a, "ArrayExpression") and not a.elements:
        return boolean(False)
    if is_(a, "BooleanLiteral") and n.parent is not None:
        return boolean(not a.value)
    return None


@rule("void-to-undefined", "UnaryExpression", scope=True)
def _(n, ctx):
    if n.operator == "void" and is_number(n.argument, 0) and not ctx.scopes.is_bound(n, "undefined"):
        return ident("undefined")
    return None


# Operators and what they become when their sides change places.
FLIPPED = {"==": "==", "===": "===", "!=": "!=", "!==": "!==", ">": "<", "<": ">", ">=": "<=", "<=": ">=", "*": "*", "^": "^", "&": "&", "|": "|"}


def yoda_value(n: Node) -> bool:
    """What reads better on the right: literals, undefined, and NaN, Infinity and minus of numbers."""
    if n.type == "UnaryExpression" and n.operator == "-":
        return is_number(n.argument) or is_ident(n.argument, "Infinity")
    return is_literal(n) or is_undefined(n) or is_ident(n, "NaN") or is_ident(n, "Infinity") or (n.type in ("ArrayExpression", "ObjectExpression", "UnaryExpression") and is_pure(n))


@rule("yoda", "BinaryExpression")
def _(n, ctx):
    if n.operator in FLIPPED and yoda_value(n.left) and not yoda_value(n.right):
        return Node("BinaryExpression", operator=FLIPPED[n.operator], left=n.right, right=n.left)
    return None


NAMES = [r.name for r in RULES]
BY_NAME = {r.name: r for r in RULES}
PREPARE = [BY_NAME[x] for x in ("block-statements", "sequence", "split-variable-declarations")]
