"""Undoing obfuscation: string arrays, control flow, proxies, dead code, traps."""

from __future__ import annotations

import re

from scriptloom.js import interp
from scriptloom.js.ask import is_, is_ident, is_iife, is_infinite_loop, is_literal, is_member, is_number, is_string, prop_name
from scriptloom.js.engine import DONE, Context, Rule, apply
from scriptloom.js.nodes import FUNCTIONS, LOOPS, Node, block, expr, ident, string
from scriptloom.js.printer import to_code
from scriptloom.js.scope import Binding, Scopes, rename, uid
from scriptloom.js.unminify import BY_NAME as UNMINIFY
from scriptloom.js.unminify import can_precede, constant_value, json_tree

ARRAY_NAME = "__STRING_ARRAY__"


# Inlining by binding


def inline_variable(scopes: Scopes, b: Binding, test=lambda n: True, nearest: bool = False) -> int:
    """Puts a variable's value in place of its reads and drops it; with nearest, each read takes the assignment before it in the text."""
    d = b.path
    if d.type != "VariableDeclarator" or d.id.type != "Identifier":
        return 0
    if b.constant and d.init is not None and test(d.init):
        for r in b.refs:
            r.replace(d.init.copy())
        n = len(b.refs) + 1
        d.remove()
        return n
    if not nearest or not b.writes:
        return 0
    writes = [w for w in b.writes if is_(w, "AssignmentExpression", operator="=") and w.start is not None]
    if len(writes) != len(b.writes):
        return 0
    values = sorted([(w.start, w.right) for w in writes] + ([(d.start, d.init)] if d.init is not None and d.start is not None else []), key=lambda x: x[0])
    n = 0
    for r in b.refs:
        before = [v for at, v in values if r.start is not None and at < r.start]
        if before and test(before[-1]):
            r.replace(before[-1].copy())
            n += 1
    if n == len(b.refs):
        for w in writes:
            if w.parent is not None and w.parent.type == "ExpressionStatement":
                w.remove()
            elif w.parent is not None:
                w.replace(w.right)
        d.remove()
    return n


def read_only_member(r: Node) -> Node | None:
    """The member expression around an object's read, unless it is written, deleted or taken apart."""
    m = r.parent
    if m is None or m.type != "MemberExpression" or m.object is not r:
        return None
    p = m.parent
    if (p.type == "AssignmentExpression" and p.left is m) or p.type == "UpdateExpression" or is_(p, "UnaryExpression", operator="delete"):
        return None
    if p.type in ("ArrayPattern", "RestElement", "ForInStatement", "ForOfStatement") and getattr(p, "right", None) is not m:
        return None
    if (p.type == "AssignmentPattern" and p.left is m) or (p.type == "ObjectProperty" and p.value is m and p.parent.type == "ObjectPattern"):
        return None
    return m


def read_only_object(b: Binding) -> bool:
    return b.constant and all(read_only_member(r) is not None for r in b.refs)


def inline_array_elements(array: Node, members: list[Node]) -> int:
    """arr[i] by a copy of the element."""
    for m in members:
        m.replace(array.elements[int(m.property.value)].copy())
    return len(members)


def properties_of(o: Node) -> dict[str, Node] | None:
    """Values by key of a plain object literal."""
    out = {}
    for p in o.properties:
        if p.type != "ObjectProperty" or (name := prop_name(p)) is None or p.computed and not is_string(p.key):
            return None
        out[name] = p.value
    return out


def inline_object_properties(b: Binding, test=is_literal) -> int:
    """o.k by its value and no object any more, if every read finds its key."""
    o = b.path.init
    values = properties_of(o)
    if not values or not read_only_object(b) or not all(map(test, values.values())):
        return 0
    members = [r.parent for r in b.refs]
    if any(prop_name(m) not in values for m in members):
        return 0
    for m in members:
        m.replace(values[prop_name(m)].copy())
    b.path.remove()
    return len(members) + 1


def single_return(f: Node) -> Node | None:
    """What a function returns whose body is one return."""
    if f.body.type != "BlockStatement":
        return f.body
    return f.body.body[0].argument if len(f.body.body) == 1 and f.body.body[0].type == "ReturnStatement" else None


def inline_function_call(f: Node, c: Node) -> Node | None:
    """The value of a call to a one-return function, arguments in place; a rest parameter spreads the others."""
    out = single_return(f)
    if out is None:
        return None
    out = out.copy()
    if len(f.params) == 2 and f.params[1].type == "RestElement":
        return Node("CallExpression", callee=c.arguments[0].copy(), arguments=[a.copy() for a in c.arguments[1:]])
    names = {p.name: i for i, p in enumerate(f.params) if p.type == "Identifier"}
    holder = expr(out)
    for x in list(out.walk()):
        if x.type == "Identifier" and x.name in names and (x.parent is holder or not (x.parent.type == "MemberExpression" and x.parent.property is x and not x.parent.computed)):
            i = names[x.name]
            x.replace(c.arguments[i].copy() if i < len(c.arguments) else Node("UnaryExpression", operator="void", argument=Node("NumericLiteral", value=0)))
    return holder.expression


def inline_variable_aliases(ctx: Context, b: Binding, target: str | None = None) -> int:
    """var a = decoder, c = a ...: every alias by the name itself."""
    name, n, todo = target or b.name, 0, [b]
    while todo:
        at = todo.pop()
        for r in list(at.refs):
            p = r.parent
            alias = None
            if p is not None and p.type == "VariableDeclarator" and p.init is r and p.id.type == "Identifier":
                alias = ctx.scopes.binding(p.id)
            elif is_(p, "AssignmentExpression", operator="=") and p.right is r and is_ident(p.left) and p.left.name != at.name:
                alias = ctx.scopes.binding(p.left)
                if alias is None or len(alias.writes) != 1 or (alias.path.type == "VariableDeclarator" and alias.path.init is not None):
                    continue
            if alias is None or alias is b or (p.type == "VariableDeclarator" and not alias.constant):
                continue
            todo.append(alias)
            for x in alias.refs:
                x.name = name
                n += 1
                b.refs.append(x)
            if p.type == "VariableDeclarator":
                p.remove()
            elif p.parent is not None and p.parent.type == "ExpressionStatement":
                p.remove()
                if alias.path.type == "VariableDeclarator":
                    alias.path.remove()
            else:
                p.replace(r)
    return n


def inline_function_aliases(ctx: Context, b: Binding) -> int:
    """function w(a, b) { return decoder(b - 1, a); }: calls of such wrappers by what they return, over and over."""
    n, again = 0, True
    while again:
        again = False
        ctx.version += 1
        scopes = ctx.scopes
        now = find(scopes, b.name)
        if now is None:
            break
        for r in list(now.refs):
            c = r.parent
            if c is None or c.type != "CallExpression" or c.callee is not r:
                continue
            f = c.find_up(lambda x: x.type in FUNCTIONS)
            if f is None or single_return(f) is not c or f.type not in ("FunctionDeclaration", "FunctionExpression"):
                continue
            params = {p.name for p in f.params if p.type == "Identifier"}
            if not any(x.type == "Identifier" and x.name in params for a in c.arguments for x in a.walk()):
                continue
            if f.type == "FunctionDeclaration":
                w = scopes.bound.get(id(f.id))
            elif f.parent.type == "VariableDeclarator" and f.parent.init is f and is_ident(f.parent.id):
                w = scopes.bound.get(id(f.parent.id))
            else:
                continue
            if w is None or w is now or not w.constant:
                continue
            calls = [x.parent for x in w.refs]
            if any(x is None or x.type != "CallExpression" or x.callee is not y for x, y in zip(calls, w.refs, strict=True)):
                continue
            for x in calls:
                new = inline_function_call(f, x)
                x.replace(new)
                n += 1
            (f if f.type == "FunctionDeclaration" else f.parent).remove()
            again = True
            break
    ctx.version += 1
    return n


def find(scopes: Scopes, name: str) -> Binding | None:
    return next((b for b in scopes.all if b.name == name), None)


# String arrays


class StringArray:
    def __init__(self, binding: Binding, path: Node, original: str, elements: list):
        self.binding, self.path, self.original, self.elements = binding, path, original, elements


def literal_array(n: Node | None) -> bool:
    return is_(n, "ArrayExpression") and len(n.elements) > 0 and all(is_string(e) or is_ident(e, "undefined") or is_(e, "UnaryExpression", operator="void") for e in n.elements)


def function_and_binding(scopes: Scopes, n: Node):
    """(binding, statement node) of function f(){} or var f = function(){}."""
    if n.type == "FunctionDeclaration" and n.id is not None:
        return scopes.bound.get(id(n.id)), n
    if n.type == "FunctionExpression" and n.parent.type == "VariableDeclarator" and is_ident(n.parent.id):
        return scopes.bound.get(id(n.parent.id)), n.parent
    return None, None


def find_string_array(ctx: Context) -> StringArray | None:
    """A function that replaces itself by one that returns an array of strings; reads of plain constant arrays are inlined on the way."""
    scopes = ctx.scopes
    for n in list(ctx.program.walk()):
        if n.type not in ("FunctionDeclaration", "FunctionExpression") or n.params or not 2 <= len(n.body.body) <= 3:
            continue
        d = n.body.body[0]
        if d.type != "VariableDeclaration" or len(d.declarations) != 1 or not literal_array(d.declarations[0].init):
            continue
        b, path = function_and_binding(scopes, n)
        inner = d.declarations[0].id.name
        if b is None:
            continue

        def gives(f: Node, inner=inner) -> bool:
            return f.type in ("FunctionExpression", "ArrowFunctionExpression") and is_ident(single_return(f), inner)

        replaced = any(is_(x, "AssignmentExpression", operator="=") and is_ident(x.left, b.name) and gives(x.right) for x in n.body.walk())
        last = n.body.body[-1]
        if replaced and last.type == "ReturnStatement":
            elements = [e.value if is_string(e) else None for e in d.declarations[0].init.elements]
            original = b.name
            rename(scopes, b, ARRAY_NAME)
            ctx.changed("string-array")
            return StringArray(b, path, original, elements)
    for b in list(scopes.all):  # plain constant arrays
        if b.kind not in ("const", "let", "var") or b.path.type != "VariableDeclarator" or b.path.id.type != "Identifier" or not literal_array(b.path.init) or not b.constant or not b.refs:
            continue
        members = [read_only_member(r) for r in b.refs]
        size = len(b.path.init.elements)
        if all(m is not None and m.computed and is_number(m.property) and float(m.property.value).is_integer() and 0 <= m.property.value < size for m in members):
            ctx.changed("string-array", inline_array_elements(b.path.init, members))
            b.path.remove()
    return None


def find_rotator(ctx: Context, array: StringArray) -> Node | None:
    """The statement that turns the array until a checksum holds."""
    for s in ctx.program.walk():
        if s.type != "ExpressionStatement":
            continue
        e = s.expression
        e = e.argument if is_(e, "UnaryExpression", operator="!") else e
        calls = e.expressions if e.type == "SequenceExpression" else [e]
        c = next((x for x in calls if is_iife(x)), None)
        if c is None or not any(is_ident(x, array.binding.name) for x in c.walk()):
            continue
        for loop in c.callee.walk():
            if loop.type in LOOPS and is_infinite_loop(loop):
                has_parse = any(is_ident(x, "parseInt") for x in loop.walk())
                tries = [x for x in loop.walk() if x.type == "TryStatement" and x.handler is not None]
                if has_parse and any(turns(t.block) and turns(t.handler.body) for t in tries):
                    return s
    return None


def turns(n: Node) -> bool:
    """push(shift()) somewhere inside."""
    return any(is_(x, "CallExpression") and is_member(x.callee, prop="push") and len(x.arguments) == 1 and is_(x.arguments[0], "CallExpression") and is_member(x.arguments[0].callee, prop="shift") for x in n.walk())


class Decoder:
    def __init__(self, binding: Binding, path: Node, original: str, name: str):
        self.binding, self.path, self.original, self.name = binding, path, original, name


def find_decoders(ctx: Context, array: StringArray, rotator: Node | None) -> list[Decoder]:
    """Functions that fetch the array and take an element of it."""
    scopes, out = ctx.scopes, []
    for r in list(array.binding.refs):
        if r.parent is None or r.parent.type != "CallExpression" or r.parent.callee is not r:
            continue
        if any(x is rotator or x is array.path for x in r.up()):
            continue
        fs = [x for x in r.up() if x.type in ("FunctionDeclaration", "FunctionExpression") and x.params]
        f = next((x for x in reversed(fs) if function_and_binding(scopes, x)[0] is not None), None)
        if f is None or not any(x.type == "MemberExpression" and x.computed for x in f.walk()):
            continue
        b, path = function_and_binding(scopes, f)
        if any(d.path is path for d in out):
            continue
        original, name = b.name, f"__DECODE_{len(out)}__"
        rename(scopes, b, name)
        out.append(Decoder(b, path, original, name))
    return out


def literal_args(args: list[Node]) -> bool:
    return all(is_literal(a) or (is_(a, "UnaryExpression") and is_literal(a.argument)) or (is_(a, "BinaryExpression") and all(map(literal_args, ([a.left], [a.right])))) for a in args)


def collect_calls(ctx: Context, d: Decoder, skip: list[Node]) -> list[Node]:
    """Calls of a decoder whose arguments are literals; a conditional argument makes two calls, and variables are filled in."""
    ctx.version += 1
    scopes, out = ctx.scopes, []
    b = find(scopes, d.name)
    if b is None:
        return out
    for r in list(b.refs):
        c = r.parent
        if c is None or any(x is y for x in r.up() for y in skip):
            continue
        if c.type == "ExpressionStatement":
            c.remove()
            continue
        if c.type != "CallExpression" or c.callee is not r:
            continue
        if c.arguments and is_(c.arguments[0], "ConditionalExpression"):
            q, rest = c.arguments[0], c.arguments[1:]
            if literal_args([q.consequent, q.alternate, *rest]):
                two = [Node("CallExpression", callee=r.copy(), arguments=[x, *(y.copy() for y in rest)]) for x in (q.consequent, q.alternate)]
                c.replace(Node("ConditionalExpression", test=q.test, consequent=two[0], alternate=two[1]))
                out += two
                continue
        for a in c.arguments:
            if is_ident(a) and (v := scopes.binding(a)) is not None:
                inline_variable(scopes, v, lambda x: literal_args([x]), nearest=True)
        if literal_args(c.arguments):
            out.append(c)
    return out


def decode_strings(ctx: Context, array: StringArray, rotator: Node | None, decoders: list[Decoder], steps: int, sandbox=None) -> tuple[int, bool]:
    """Runs array, decoders and rotator in the restricted interpreter, then every call; whether all calls were decoded.

    A sandbox, if given, is called once instead, with the text of a program
    that ends in a list of all calls, and returns the list of their values.
    """
    machine = interp.Interpreter(steps)
    try:
        parts = [array.path, *(d.path for d in decoders), *([rotator] if rotator is not None else [])]
        order = {id(x): i for i, x in enumerate(ctx.program.walk())}
        nodes = []
        for p in sorted(parts, key=lambda x: (x is rotator, order.get(id(x), 0))):
            nodes.append(Node("VariableDeclaration", kind="var", declarations=[p.copy()]) if p.type == "VariableDeclarator" else p.copy())
        if sandbox is None:
            machine.run(Node("Program", body=nodes))
    except (interp.Unsupported, interp.Thrown, RecursionError):
        return 0, False
    calls = [c for d in decoders for c in collect_calls(ctx, d, parts)]
    given = None
    if sandbox is not None:
        listed = expr(Node("ArrayExpression", elements=[c.copy() for c in calls]))
        given = sandbox(to_code(Node("Program", body=[*nodes, listed]), compact=True))
        if not isinstance(given, list) or len(given) != len(calls):
            return 0, False
    done, whole = 0, True
    for i, c in enumerate(calls):
        try:
            v = machine.evaluate(c.copy()) if given is None else given[i]
        except interp.Thrown:
            c.comment = "decode error"
            continue
        except (interp.Unsupported, RecursionError):
            whole = False
            continue
        if isinstance(v, int) and not isinstance(v, bool):
            v = float(v)
        if isinstance(v, str):
            new = string(v)
        elif v is interp.UNDEFINED or v is None or isinstance(v, (bool, float)):
            new = ident("undefined") if v is interp.UNDEFINED else json_tree(v)
            new.comment = "decode error"
        else:
            c.comment = "decode error"
            continue
        c.replace(new)
        done += 1
    return done, whole


# Rules for what is left


def string_comparison(n: Node) -> bool | None:
    """What a comparison of two string literals gives."""
    if is_(n, "UnaryExpression", operator="!"):
        v = string_comparison(n.argument)
        return None if v is None else not v
    if n.type == "BinaryExpression" and n.operator in ("===", "==", "!==", "!=") and is_string(n.left) and is_string(n.right):
        return (n.left.value == n.right.value) == (n.operator in ("===", "=="))
    return None


def dead_code(n, ctx):
    v = string_comparison(n.test)
    if v is None:
        return None
    taken = n.consequent if v else n.alternate
    if n.type == "ConditionalExpression":
        return taken
    if taken is None:
        return [] if can_precede(n) else block()
    if taken.type != "BlockStatement" or not can_precede(n):
        return taken
    scopes = ctx.scopes
    inner = scopes.of_node.get(id(taken))
    if inner is not None:
        for b in list(inner.own.values()):
            if scopes.scope_of(n.parent).find(b.name) is not None or any(g == b.name for g in scopes.globals):
                rename(scopes, b, uid(scopes, b.name))
    return list(taken.body)


DEAD_CODE = Rule("dead-code", {"IfStatement|ConditionalExpression": dead_code}, scope=True)

PROXY_KEY = re.compile(r"[A-Za-z0-9]{5}")


def proxy_function(f: Node) -> bool:
    """function (a, b) { return a + b; }, a(b, ...) or a(...rest)."""
    if f.type not in ("FunctionExpression", "ArrowFunctionExpression") or (e := single_return(f)) is None:
        return False
    names = [p.name for p in f.params if p.type == "Identifier"]
    if e.type in ("BinaryExpression", "LogicalExpression"):
        return len(names) == 2 and len(f.params) == 2 and is_ident(e.left, names[0]) and is_ident(e.right, names[1])
    if e.type == "CallExpression" and names and is_ident(e.callee, names[0]):
        if len(f.params) == 2 and f.params[1].type == "RestElement":
            return len(e.arguments) == 1 and e.arguments[0].type == "SpreadElement"
        return len(names) == len(f.params) and [getattr(a, "name", None) for a in e.arguments] == names[1:]
    return False


def proxy_value(v: Node) -> bool:
    return is_string(v) or proxy_function(v) or (v.type == "MemberExpression" and is_ident(v.object) and prop_name(v) is not None)


def fill_member(m: Node, value: Node) -> None:
    """The proxy's value, or the call of it, in a member's place."""
    c = m.parent
    if value.type in ("FunctionExpression", "ArrowFunctionExpression") and c.type == "CallExpression" and c.callee is m:
        new = inline_function_call(value, c)
        if new is not None:
            c.replace(new)
            return
    m.replace(value.copy())


def collect_assignments(b: Binding, d: Node) -> list[tuple[str, Node, Node]]:
    """(key, value, statement) of o.k = v; right behind o's declaration."""
    s = d.parent
    if s.parent is None or s.parent.type not in ("BlockStatement", "Program", "SwitchCase"):
        return []
    k, i = s.place()
    out = []
    for x in s.parent.__dict__[k][i + 1 :]:
        e = x.expression if x.type == "ExpressionStatement" else None
        if not (is_(e, "AssignmentExpression", operator="=") and is_member(e.left, b.name)):
            break
        if e.right.type == "BinaryExpression" and isinstance(text := constant_value(e.right), str):
            e.set("right", string(text))
        if not proxy_value(e.right):
            break
        out.append((prop_name(e.left), e.right, x))
    return out


def control_flow_object(n, ctx):
    if n.id.type != "Identifier" or not is_(n.init, "ObjectExpression"):
        return None
    values = properties_of(n.init)
    if values is None:
        return None
    b = ctx.scopes.binding(n.id)
    if b is None or not b.constant or not b.refs:
        return None
    later = collect_assignments(b, n)
    added = {k: v for k, v, _ in later}
    values = values | added
    if not values or not all(PROXY_KEY.fullmatch(k) and proxy_value(v) for k, v in values.items()):
        return None
    # An alias of the whole object, made once, stands for it.
    alias = [r.parent for r in b.refs if r.parent.type == "VariableDeclarator" and r.parent.init is r]
    targets = [b]
    if len(alias) == 1 and is_ident(alias[0].id):
        a = ctx.scopes.binding(alias[0].id)
        if a is None or not a.constant:
            return None
        targets.append(a)
    elif alias:
        return None
    written = {id(s.expression.left.object) for _, _, s in later}
    members = []
    for t in targets:
        for r in t.refs:
            if id(r) in written or (alias and r.parent is alias[0]):
                continue
            m = read_only_member(r)
            if m is None or prop_name(m) not in values:
                return None
            members.append(m)
    for m in sorted(members, key=lambda x: (-sum(1 for _ in x.up()), x.parent.type == "CallExpression" and x.parent.callee is x)):  # inner ones first: outer calls copy their arguments
        fill_member(m, values[prop_name(m)])
    for _, _, s in later:
        s.remove()
    if alias:
        alias[0].remove()
    n.remove()
    ctx.version += 1
    return DONE


def literal_object_member(n, ctx):
    """({k: v}).k, and a call of it."""
    o = n.object
    if o.type != "ObjectExpression" or (values := properties_of(o)) is None or (name := prop_name(n)) not in values or not all(map(proxy_value, values.values())):
        return None
    fill_member(n, values[name])
    return DONE


CONTROL_FLOW_OBJECT = Rule("control-flow-object", {"VariableDeclarator": control_flow_object, "MemberExpression": literal_object_member}, scope=True)


def control_flow_switch(n, ctx):
    """const order = "2|0|1".split("|"); let i = 0; while (true) { switch (order[i++]) {...} break; }"""
    body = n.body
    for at, loop in enumerate(body):
        if loop.type not in LOOPS or not is_infinite_loop(loop) or loop.body.type != "BlockStatement" or not loop.body.body or loop.body.body[0].type != "SwitchStatement":
            continue
        sw = loop.body.body[0]
        d = sw.discriminant
        if not (is_(d, "MemberExpression") and d.computed and is_ident(d.object) and is_(d.property, "UpdateExpression", operator="++") and is_ident(d.property.argument)):
            continue
        if len(loop.body.body) > 1 and loop.body.body[1].type != "BreakStatement":
            continue
        order, counter = d.object.name, d.property.argument.name
        sequence, used = None, []
        for s in body[:at]:
            if s.type != "VariableDeclaration" or len(s.declarations) != 1:
                continue
            v = s.declarations[0]
            if is_ident(v.id, order) and is_(v.init, "CallExpression") and is_member(v.init.callee, prop="split") and is_string(v.init.callee.object) and len(v.init.arguments) == 1 and is_string(v.init.arguments[0]):
                sequence = v.init.callee.object.value.split(v.init.arguments[0].value)
                used.append(s)
            elif is_ident(v.id, counter) and v.init is not None:
                used.append(s)
        cases = {c.test.value: c.consequent for c in sw.cases if is_string(c.test)}
        if sequence is None or any(k not in cases for k in sequence):
            continue
        out = []
        for k in sequence:
            part = list(cases[k])
            if part and part[-1].type == "ContinueStatement":
                part.pop()
            out += part
        for s in used:
            s.remove()
        loop.replace(*out)
        return DONE
    return None


CONTROL_FLOW_SWITCH = Rule("control-flow-switch", {"BlockStatement|Program": control_flow_switch})


def inline_object_props(n, ctx):
    if n.id.type != "Identifier" or not is_(n.init, "ObjectExpression") or not n.init.properties:
        return None
    b = ctx.scopes.binding(n.id)
    if b is None or not b.refs:
        return None
    return DONE if inline_object_properties(b, lambda v: is_string(v) or is_number(v)) else None


def literal_member(n, ctx):
    """({k: 1}).k"""
    if n.object.type != "ObjectExpression" or (values := properties_of(n.object)) is None:
        return None
    v = values.get(prop_name(n))
    return v if v is not None and all(is_string(x) or is_number(x) for x in values.values()) else None


INLINE_OBJECT_PROPS = Rule("inline-object-props", {"VariableDeclarator": inline_object_props, "MemberExpression": literal_member}, scope=True)


def merge_object_assignments(n, ctx):
    """const o = {}; o.a = 1; ...: one literal."""
    if len(n.declarations) != 1 or not is_ident(n.declarations[0].id) or not is_(n.declarations[0].init, "ObjectExpression"):
        return None
    if n.parent is None or n.parent.type not in ("Program", "BlockStatement", "SwitchCase"):
        return None
    d = n.declarations[0]
    b = ctx.scopes.binding(d.id)
    if b is None or not b.constant:
        return None
    k, i = n.place()
    merged = 0
    rest = n.parent.__dict__[k]
    while i + 1 < len(rest):
        s = rest[i + 1]
        e = s.expression if s.type == "ExpressionStatement" else None
        if not (is_(e, "AssignmentExpression", operator="=") and is_(e.left, "MemberExpression") and is_ident(e.left.object, b.name)):
            break
        if any(is_ident(x, b.name) or x.type in ("CallExpression", "NewExpression", "OptionalCallExpression", "TaggedTemplateExpression", "AwaitExpression", "YieldExpression") for part in (e.right, e.left.property) for x in part.walk()):
            break
        computed = e.left.computed and e.left.property.type not in ("StringLiteral", "NumericLiteral")
        d.init.properties.append(p := Node("ObjectProperty", key=e.left.property, value=e.right, computed=computed, shorthand=False))
        p.parent = d.init
        b.refs = [r for r in b.refs if r is not e.left.object]
        s.remove()
        merged += 1
    if not merged:
        return None
    ctx.version += 1
    if len(b.refs) == 1 and plain(d.init) and not repeated(b.refs[0], n):
        b.refs[0].replace(d.init)
        n.remove()
    return DONE


def plain(n: Node) -> bool:
    """Objects and arrays of literals."""
    if n.type == "ObjectExpression":
        return all(p.type == "ObjectProperty" and not p.computed and plain(p.value) for p in n.properties)
    if n.type == "ArrayExpression":
        return all(e is None or plain(e) for e in n.elements)
    return is_literal(n) or (is_(n, "UnaryExpression") and is_literal(n.argument))


def repeated(r: Node, declared: Node) -> bool:
    """Whether a read may run more often than the declaration, or stands inside another function or class."""
    for x in r.up():
        if x is declared.parent:
            return False
        if x.type in FUNCTIONS or x.type in LOOPS or x.type.startswith("Class"):
            return True
    return True


MERGE_OBJECT_ASSIGNMENTS = Rule("merge-object-assignments", {"VariableDeclaration": merge_object_assignments}, scope=True)

# Global functions that are evaluated on a literal.
GLOBALS = {"atob": interp.atob, "unescape": interp.unescape, "decodeURI": lambda s: interp.decode_uri(s, ";/?:@&=+$,#"), "decodeURIComponent": interp.decode_uri}


def evaluate_globals(n, ctx):
    if not is_ident(n.callee) or n.callee.name not in GLOBALS or len(n.arguments) != 1 or not is_string(n.arguments[0]) or ctx.scopes.is_bound(n, n.callee.name):
        return None
    try:
        return string(GLOBALS[n.callee.name](n.arguments[0].value))
    except (interp.Thrown, ValueError):
        return None


EVALUATE_GLOBALS = Rule("evaluate-globals", {"CallExpression": evaluate_globals}, scope=True)


def single_call_controller(n: Node) -> bool:
    """(function () { let first = true; return function (context, fn) { const run = first ? function () {...} : function () {}; first = false; return run; }; })()"""
    if not is_iife(n) or n.callee.body.type != "BlockStatement" or len(n.callee.body.body) != 2:
        return False
    d, r = n.callee.body.body
    if d.type != "VariableDeclaration" or r.type != "ReturnStatement" or not is_(r.argument, "FunctionExpression") or len(r.argument.params) != 2:
        return False
    texts = list(r.argument.walk())
    return any(x.type == "ConditionalExpression" for x in texts) and any(is_member(x, prop="apply") for x in texts) and any(is_(x, "AssignmentExpression", operator="=") and (is_(x.right, "BooleanLiteral", value=False) or is_(x.right, "UnaryExpression")) for x in texts)


def self_defending(n, ctx):
    if not is_ident(n.id) or n.init is None or not single_call_controller(n.init):
        return None
    b = ctx.scopes.binding(n.id)
    if b is None:
        return None
    for r in b.refs:
        c = r.parent
        if c.type != "CallExpression" or c.callee is not r:
            continue
        p = c.parent
        if p.type == "CallExpression" and p.callee is c:  # callController(this, function () {...})()
            if p.parent.type == "ExpressionStatement":
                holder = p.parent.find_up(lambda x: x.type in FUNCTIONS)
                outer = holder.parent if holder is not None and is_iife(holder.parent) and len(holder.body.body) == 1 else None
                (outer if outer is not None and outer.parent.type == "ExpressionStatement" else p).remove()
        elif p.type == "VariableDeclarator":  # const check = callController(this, function () {...}); check();
            v = ctx.scopes.binding(p.id)
            for x in v.refs if v else ():
                if x.parent is not None and x.parent.type == "CallExpression" and x.parent.parent is not None and x.parent.parent.type == "ExpressionStatement":
                    x.parent.remove()
            p.remove()
    n.remove()
    ctx.version += 1
    return DONE


SELF_DEFENDING = Rule("self-defending", {"VariableDeclarator": self_defending}, scope=True)


def debug_protection(n, ctx):
    """A function that calls itself with a counter and stops in the debugger, and what calls it at intervals."""
    if n.id is None or len(n.params) != 1 or not any(x.type == "FunctionDeclaration" and debugger_inside(x) for x in n.body.body):
        return None
    b = ctx.scopes.binding(n.id)
    if b is None or not b.constant:
        return None
    for r in b.refs:
        if any(x is n for x in r.up()):
            continue
        s = r.find_up(lambda x: x.type == "ExpressionStatement" and x.parent.type in ("Program", "BlockStatement") and any(is_ident(y, "setInterval") or is_ident(y, n.id.name) for y in x.walk()))
        top = r.find_up(lambda x: x.type == "ExpressionStatement" and is_iife(x.expression) and any(is_ident(y, "setInterval") or is_member(y, prop="setInterval") for y in x.walk()))
        if (top or s) is not None and (top or s).parent is not None:
            (top or s).remove()
    n.remove()
    ctx.version += 1
    return DONE


def debugger_inside(f: Node) -> bool:
    return any(x.type == "DebuggerStatement" or is_string(x) and x.value in ("debugger", "gger", "debu") for x in f.walk()) and any(is_(x, "UpdateExpression", operator="++") for x in f.walk())


def debug_protection_variable(n, ctx):
    """The same as var f = function (n) {...}."""
    f = n.init
    if not is_ident(n.id) or not is_(f, "FunctionExpression") or len(f.params) != 1 or n.parent is None:
        return None
    if not any((x.type == "FunctionDeclaration" or x.type == "VariableDeclaration") and debugger_inside(x) for x in f.body.body):
        return None
    b = ctx.scopes.binding(n.id)
    if b is None or not b.constant:
        return None
    for r in b.refs:
        s = r.find_up(lambda x: x.type == "ExpressionStatement" and x.parent.type == "Program")
        if s is not None and not any(x is f for x in r.up()):
            s.remove()
    n.remove()
    ctx.version += 1
    return DONE


DEBUG_PROTECTION = Rule("debug-protection", {"FunctionDeclaration": debug_protection, "VariableDeclarator": debug_protection_variable}, scope=True)
RULES = [DEAD_CODE, CONTROL_FLOW_OBJECT, CONTROL_FLOW_SWITCH, INLINE_OBJECT_PROPS, MERGE_OBJECT_ASSIGNMENTS, EVALUATE_GLOBALS, SELF_DEFENDING, DEBUG_PROTECTION]
BY_NAME = {r.name: r for r in RULES}


def deobfuscate(ctx: Context, force: bool = False, steps: int = 3_000_000, sandbox=None) -> None:
    """String array, rotator and decoders; then, if there was one (or force), dead code and control flow."""
    array = find_string_array(ctx)
    if array is not None:
        ctx.version += 1
        array.binding = find(ctx.scopes, ARRAY_NAME)
        rotator = find_rotator(ctx, array)
        decoders = find_decoders(ctx, array, rotator)
        apply(ctx, [INLINE_OBJECT_PROPS])
        for d in decoders:
            ctx.version += 1
            b = find(ctx.scopes, d.name)
            if b is not None:
                ctx.changed("inline-decoder-wrappers", inline_variable_aliases(ctx, b) + inline_function_aliases(ctx, b))
        done, whole = decode_strings(ctx, array, rotator, decoders, steps, sandbox)
        if done:
            ctx.changed("inline-decoded-strings", done)
        if whole and (done or not decoders):
            for x in [array.path, *(d.path for d in decoders), *([rotator] if rotator is not None else [])]:
                if x.parent is not None:
                    x.remove()
        ctx.version += 1
    elif not force:
        return
    apply(ctx, [UNMINIFY["merge-strings"], DEAD_CODE, CONTROL_FLOW_OBJECT, CONTROL_FLOW_SWITCH])
