"""Rewrites that bring back newer syntax from what transpilers made of it."""

from __future__ import annotations

import re

from scriptloom.js.ask import is_, is_ident, is_null, is_number, is_string, is_undefined
from scriptloom.js.engine import DONE, Context, Rule
from scriptloom.js.nodes import Node, boolean, ident, same
from scriptloom.js.scope import Binding
from scriptloom.js.unminify import template_text

RULES: list[Rule] = []


def rule(name: str, types: str, **flags):
    def add(f):
        known = next((r for r in RULES if r.name == name), None)
        if known is None:
            known = Rule(name, {}, **flags)
            RULES.append(known)
        known.handlers[types] = f
        return f

    return add


def temporary(ctx: Context, n: Node | None, reads: int) -> Binding | None:
    """The binding of an identifier that is written once, never initialised, and read so often."""
    if not is_ident(n):
        return None
    b = ctx.scopes.binding(n)
    if b is None or len(b.writes) != 1 or len(b.refs) != reads:
        return None
    if b.kind == "param":
        return b if b.path.type == "Identifier" else None
    return b if b.path.type == "VariableDeclarator" and b.path.init is None else None


def drop(b: Binding) -> None:
    """Removes a temporary's declaration."""
    if b.path.type == "VariableDeclarator" and b.path.parent is not None:
        b.path.remove()
    elif b.kind == "param" and b.path.parent is not None and b.path.parent.params[-1] is b.path:
        b.path.remove()


def assigned(n: Node | None) -> tuple[Node, Node] | None:
    """(variable, value) of `v = value`."""
    return (n.left, n.right) if is_(n, "AssignmentExpression", operator="=") and is_ident(n.left) else None


# default parameters


def argument_index(n: Node | None) -> int | None:
    """i of arguments[i]."""
    return n.property.value if is_(n, "MemberExpression") and is_ident(n.object, "arguments") and is_number(n.property) and n.computed else None


def length_test(n: Node | None, op: str) -> int | None:
    """i of `arguments.length > i` (or another operator)."""
    ok = is_(n, "BinaryExpression", operator=op) and is_(n.left, "MemberExpression") and is_ident(n.left.object, "arguments") and is_ident(n.left.property, "length") and is_number(n.right)
    return n.right.value if ok else None


def compared(n: Node | None, op: str) -> Node | None:
    """x of `x op undefined`."""
    if is_(n, "BinaryExpression", operator=op):
        if is_undefined(n.right):
            return n.left
        if is_undefined(n.left):
            return n.right
    return None


def default_of(e: Node | None) -> tuple[int, Node | None] | None:
    """(index, default or None) of what a transpiler writes for a parameter."""
    if is_(e, "ConditionalExpression"):
        i = length_test(e.test, ">")
        if i is not None and argument_index(e.consequent) == i and is_undefined(e.alternate):
            return i, None
        t = e.test
        if is_(t, "LogicalExpression", operator="&&") and (i := length_test(t.left, ">")) is not None and argument_index(compared(t.right, "!==")) == i and argument_index(e.consequent) == i:
            return i, e.alternate
    if is_(e, "LogicalExpression") and is_(e.left, "LogicalExpression", operator=e.operator):
        i = argument_index(e.right)
        op = e.operator
        if i is not None and op == "&&" and length_test(e.left.left, ">") == i and argument_index(compared(e.left.right, "!==")) == i:
            return i, boolean(False)
        if i is not None and op == "||" and length_test(e.left.left, "<=") == i and argument_index(compared(e.left.right, "===")) == i:
            return i, boolean(True)
    return None


@rule("default-parameters", "FunctionDeclaration|FunctionExpression|ObjectMethod|ClassMethod|ArrowFunctionExpression", safe=False, scope=True)
def _(n, ctx):
    if n.body.type != "BlockStatement":
        return None
    out = None
    while n.body.body:
        s = n.body.body[0]
        if s.type == "VariableDeclaration" and len(s.declarations) == 1 and s.declarations[0].init is not None:
            d = s.declarations[0]
            found = default_of(d.init)
            if found is None or n.type == "ArrowFunctionExpression":
                break
            i, value = int(found[0]), found[1]
            if i < len(n.params) and not (is_ident(n.params[i]) and n.params[i].name.startswith("_param")):
                break
            taken = {x.name for x in n.walk() if x.type == "Identifier"}
            params = list(n.params)
            while len(params) < i:
                k = 1
                while (name := "_param" if k == 1 else f"_param{k}") in taken:
                    k += 1
                taken.add(name)
                params.append(ident(name))
            new = d.id if value is None else Node("AssignmentPattern", left=d.id, right=value)
            params[i : i + 1] = [new]
            s.remove()
            n.set("params", params)
        elif s.type == "IfStatement" and s.alternate is None:
            x = compared(s.test, "===")
            c = s.consequent.body[0] if s.consequent.type == "BlockStatement" and len(s.consequent.body) == 1 else s.consequent
            pair = assigned(c.expression) if c.type == "ExpressionStatement" else None
            if not is_ident(x) or not pair or pair[0].name != x.name:
                break
            at = next((i for i, p in enumerate(n.params) if is_ident(p, x.name)), None)
            if at is None:
                break
            s.remove()
            n.params[at] = p = Node("AssignmentPattern", left=n.params[at], right=pair[1])
            p.parent = n
        else:
            break
        out = DONE
        ctx.version += 1
    return out


# logical assignments


@rule("logical-assignments", "LogicalExpression", safe=True, scope=True)
def _(n, ctx):
    if n.operator not in ("||", "&&") or not is_(n.right, "AssignmentExpression", operator="="):
        return None
    return joined(n, ctx)


def joined(n: Node, ctx: Context) -> Node | None:
    """x op= value of `x op (x = value)`, temporaries for the object and the key of a member filled in."""
    left, target, value = n.left, n.right.left, n.right.right
    if left.type == "Identifier" and same(left, target):
        return Node("AssignmentExpression", operator=n.operator + "=", left=target, right=value)
    if left.type != "MemberExpression" or target.type != "MemberExpression" or left.computed != target.computed:
        return None
    temps = []

    def merged(a: Node, b: Node) -> Node | None:
        """a where b repeats it: the same text, or a temporary that a fills."""
        pair = assigned(a)
        if pair and same(pair[0], b):
            t = temporary(ctx, b, 1)
            if t:
                temps.append(t)
                return pair[1]
            return None
        return a if same(a, b) and a.type in ("Identifier", "ThisExpression", "StringLiteral", "NumericLiteral", "Super", "MemberExpression") else None

    o = merged(left.object, target.object)
    p = merged(left.property, target.property) if left.computed else (left.property if same(left.property, target.property) else None)
    if o is None or p is None:
        return None
    for t in temps:
        drop(t)
    return Node("AssignmentExpression", operator=n.operator + "=", left=Node("MemberExpression", object=o, property=p, computed=left.computed), right=value)


# nullish coalescing


def nullish_test(ctx: Context, test: Node, negative: bool) -> tuple[Node, Node, Binding | None] | None:
    """(value, what stands for it later, temporary) of a test that value is (not) null or undefined."""
    strict_op, loose_op, glue = ("!==", "!=", "&&") if negative else ("===", "==", "||")
    if is_(test, "BinaryExpression", operator=loose_op) and (is_null(test.right) or is_undefined(test.right)):
        a = test.left
        pair = assigned(a)
        return (pair[1], pair[0], None) if pair else (a, a, None)
    if not is_(test, "LogicalExpression", operator=glue):
        return None
    x, y = test.left, test.right
    if not is_(x, "BinaryExpression", operator=strict_op) or not is_(y, "BinaryExpression", operator=strict_op):
        return None
    if not (is_null(x.right) and is_undefined(y.right) or is_undefined(x.right) and is_null(y.right)):
        return None
    pair = assigned(x.left)
    if pair and same(pair[0], y.left):
        return pair[1], pair[0], None
    return (x.left, x.left, None) if same(x.left, y.left) else None


def reads_of(ctx: Context, test: Node) -> int:
    return 1 if test.type == "LogicalExpression" else 0


@rule("nullish-coalescing", "ConditionalExpression", safe=True, scope=True)
def _(n, ctx):
    for negative in (True, False):
        found = nullish_test(ctx, n.test, negative)
        if not found:
            continue
        value, later, _ = found
        kept, other = (n.consequent, n.alternate) if negative else (n.alternate, n.consequent)
        if not same(kept, later):
            continue
        if value is not later:
            t = temporary(ctx, later, reads_of(ctx, n.test) + 1)
            if t is None:
                continue
            drop(t)
        elif later.type not in ("Identifier", "MemberExpression", "ThisExpression"):
            continue
        return Node("LogicalExpression", operator="??", left=value, right=other)
    return None


@rule("nullish-coalescing", "LogicalExpression", scope=True)
def _(n, ctx):
    """(t = v) !== null && t !== undefined || d: only the test is left of what was `v ?? d` where the value is not used."""
    if n.operator != "||":
        return None
    found = nullish_test(ctx, n.left, True)
    if not found or found[0] is found[1] or n.left.type != "LogicalExpression":
        return None
    t = temporary(ctx, found[1], 1)
    if t is None:
        return None
    drop(t)
    return Node("LogicalExpression", operator="??", left=found[0], right=n.right)


@rule("nullish-coalescing", "CallExpression", scope=True)
def _(n, ctx):
    """((v) => v ?? d)(x), which an earlier rewrite leaves of a parameter used as a temporary."""
    f = n.callee
    if f.type == "ArrowFunctionExpression" and not f.params and not n.arguments and not f.is_async and is_(f.body, "LogicalExpression", operator="??"):
        return f.body
    if f.type != "ArrowFunctionExpression" or len(f.params) != 1 or len(n.arguments) != 1 or f.is_async or not is_ident(f.params[0]):
        return None
    b = f.body
    if is_(b, "LogicalExpression", operator="??") and is_ident(b.left, f.params[0].name) and not any(is_ident(x, f.params[0].name) for x in b.right.walk()):
        return Node("LogicalExpression", operator="??", left=n.arguments[0], right=b.right)
    return None


@rule("nullish-coalescing-assignment", "LogicalExpression", scope=True)
def _(n, ctx):
    if n.operator != "??" or not is_(n.right, "AssignmentExpression", operator="="):
        return None
    return joined(n, ctx)


# optional chaining


@rule("optional-chaining", "ConditionalExpression", scope=True)
def _(n, ctx):
    for negative in (False, True):
        found = nullish_test(ctx, n.test, negative)
        if not found:
            continue
        value, later, _ = found
        nothing, used = (n.alternate, n.consequent) if negative else (n.consequent, n.alternate)
        if not is_undefined(nothing):
            continue
        links, at = [], used
        while at is not None and at.type in ("MemberExpression", "CallExpression", "OptionalMemberExpression", "OptionalCallExpression"):
            links.append(at)
            at = at.object if "Member" in at.type else at.callee
            if same(at, later):
                break
        if not links or not same(at, later) or links[-1].type not in ("MemberExpression", "CallExpression"):
            continue
        if value is not later:
            t = temporary(ctx, later, reads_of(ctx, n.test) + 1)
            if t is None:
                continue
            drop(t)
        elif later.type not in ("Identifier", "MemberExpression", "ThisExpression"):
            continue
        out = value
        for x in reversed(links):
            first = x is links[-1]
            optional = first or getattr(x, "optional", False)
            if "Member" in x.type:
                out = Node("OptionalMemberExpression", object=out, property=x.property, computed=x.computed, optional=optional)
            else:
                out = Node("OptionalCallExpression", callee=out, arguments=x.arguments, optional=optional)
        return out
    return None


# template literals


class Template:
    """A template in the making."""

    def __init__(self, raw: str = ""):
        self.raws, self.exprs = [raw], []

    def add(self, e: Node) -> None:
        if is_string(e):
            self.raws[-1] += re.sub(r"(?<!\\)\$", r"\\$", template_text(e.value))
        elif e.type == "TemplateLiteral":
            self.raws[-1] += e.quasis[0].raw
            for q, x in zip(e.quasis[1:], e.expressions, strict=True):
                self.exprs.append(x)
                self.raws.append(q.raw)
        else:
            self.exprs.append(e)
            self.raws.append("")

    def node(self) -> Node:
        return Node("TemplateLiteral", quasis=[Node("TemplateElement", raw=r, cooked=r) for r in self.raws], expressions=self.exprs)


@rule("template-literals", "CallExpression", safe=False)
def _(n, ctx):
    c = n.callee
    if not (c.type == "MemberExpression" and (is_ident(c.property, "concat") and not c.computed) and (is_string(c.object) or c.object.type == "TemplateLiteral") and n.arguments and all(a.type != "SpreadElement" for a in n.arguments)):
        return None
    t = Template()
    for e in (c.object, *n.arguments):
        t.add(e)
    return t.node()


@rule("template-literals", "BinaryExpression", safe=False)
def _(n, ctx):
    if n.operator != "+" or "TemplateLiteral" not in (n.left.type, n.right.type):
        return None
    t = Template()
    t.add(n.left)
    t.add(n.right)
    return t.node()


NAMES = [r.name for r in RULES]
BY_NAME = {r.name: r for r in RULES}
