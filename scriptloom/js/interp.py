"""A restricted interpreter for the decoders of string arrays.

It knows functions, closures, loops, exceptions, arrays, plain objects, and
the string, array and number functions that decoders use.  There is no input
or output, no clock and no access to anything outside; a step budget ends
endless loops.  What it does not know raises Unsupported.
"""

from __future__ import annotations

import base64
import math
import re
import urllib.parse

from scriptloom.js import numbers
from scriptloom.js.nodes import FUNCTIONS, Node
from scriptloom.js.scope import pattern_names


class Unsupported(Exception):
    """A construct outside the subset, or the budget's end."""


class Undefined:
    def __repr__(self):
        return "undefined"

    def __bool__(self):
        return False


UNDEFINED = Undefined()


class Thrown(Exception):
    def __init__(self, value):
        self.value = value


class _Break(Exception):
    pass


class _Continue(Exception):
    pass


class _Return(Exception):
    def __init__(self, value):
        self.value = value


class Obj:
    """A plain object, an array (items) or a function."""

    def __init__(self, props=None, items=None):
        self.props, self.items = props or {}, items


class Func(Obj):
    def __init__(self, node, env, this=UNDEFINED, native=None):
        super().__init__({"prototype": Obj()})
        self.node, self.env, self.this, self.native = node, env, this, native


class Env:
    def __init__(self, parent=None):
        self.vars, self.parent = {}, parent

    def home(self, name):
        e = self
        while e is not None:
            if name in e.vars:
                return e
            e = e.parent
        return None


def units(s: str) -> list[int]:
    """UTF-16 code units."""
    b = s.encode("utf-16-le", "surrogatepass")
    return [b[i] | b[i + 1] << 8 for i in range(0, len(b), 2)]


def from_units(u) -> str:
    return b"".join((x & 0xFFFF).to_bytes(2, "little") for x in u).decode("utf-16-le", "surrogatepass")


def to_str(v) -> str:
    if isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return numbers.to_text(v)
    if v is None:
        return "null"
    if v is UNDEFINED:
        return "undefined"
    if isinstance(v, Func):
        if v.node is None:
            return "function () { [native code] }"
        from scriptloom.js.printer import to_code

        return to_code(v.node, compact=True)
    if v.items is not None:
        return ",".join("" if x is None or x is UNDEFINED else to_str(x) for x in v.items)
    return "[object Object]"


def to_num(v) -> float:
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)):
        return float(v)
    if v is None:
        return 0.0
    if v is UNDEFINED:
        return math.nan
    return numbers.from_text(to_str(v))


def truthy(v) -> bool:
    if isinstance(v, float):
        return v != 0 and not math.isnan(v)
    if isinstance(v, Obj):
        return True
    return bool(v)


def type_of(v) -> str:
    if v is UNDEFINED:
        return "undefined"
    if isinstance(v, str):
        return "string"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "function" if isinstance(v, Func) else "object"


def strict(a, b) -> bool:
    if type_of(a) != type_of(b):
        return False
    if isinstance(a, Obj) or isinstance(b, Obj) or a is None or b is None:
        return a is b
    return a == b


def loose(a, b) -> bool:
    nothing = (None, UNDEFINED)
    if any(a is x for x in nothing) or any(b is x for x in nothing):
        return any(a is x for x in nothing) and any(b is x for x in nothing)
    if type_of(a) == type_of(b):
        return strict(a, b)
    if isinstance(a, Obj) or isinstance(b, Obj):
        return to_str(a) == to_str(b) if isinstance(a, str) or isinstance(b, str) or (isinstance(a, Obj) and isinstance(b, Obj)) else to_num(a) == to_num(b)
    return to_num(a) == to_num(b)


def parse_int(s, base=UNDEFINED) -> float:
    s = to_str(s).strip()
    sign = -1 if s.startswith("-") else 1
    s = s.lstrip("+-") if s[:1] in "+-" else s
    b = 0 if base is UNDEFINED else int(to_num(base) if not math.isnan(to_num(base)) else 0)
    if s[:2].lower() == "0x" and b in (0, 16):
        s, b = s[2:], 16
    b = b or 10
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:b]
    n = 0
    while n < len(s) and s[n].lower() in digits:
        n += 1
    return float(sign * int(s[:n], b)) if n else math.nan


def decode_uri(s: str, keep: str = "") -> str:
    out, i = bytearray(), 0
    while i < len(s):
        if s[i] == "%":
            if not re.match(r"%[0-9a-fA-F]{2}", s[i:]):
                raise Thrown("URIError: URI malformed")
            b = int(s[i + 1 : i + 3], 16)
            out += s[i : i + 3].encode() if chr(b) in keep and b < 128 else bytes([b])
            i += 3
        else:
            out += s[i].encode("utf-8", "surrogatepass")
            i += 1
    try:
        return out.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        raise Thrown("URIError: URI malformed") from None


def unescape(s: str) -> str:
    return re.sub(r"%u([0-9a-fA-F]{4})|%([0-9a-fA-F]{2})", lambda m: chr(int(m[1] or m[2], 16)), s)


def atob(s: str) -> str:
    s = re.sub(r"[ \t\n\f\r]", "", s)
    if len(s) % 4 == 0:
        s = re.sub(r"==?$", "", s)
    if len(s) % 4 == 1 or re.search(r"[^A-Za-z0-9+/]", s):
        raise Thrown("InvalidCharacterError")
    return base64.b64decode(s + "=" * (-len(s) % 4)).decode("latin-1")


def encode_uri_component(s: str) -> str:
    return urllib.parse.quote(s, safe="-_.!~*'()")


def guess(f: Node):
    """A fast Python function for what a helper of decoders looks like (base64 in some alphabet, alone or before RC4), or None.

    It is only a guess: the interpreter uses it after its results have agreed
    with the interpreted ones.
    """
    if f.type not in ("FunctionExpression", "FunctionDeclaration") or len(f.params) not in (1, 2):
        return None
    nodes = list(f.body.walk())
    alphabet = next((n.value for n in nodes if n.type == "StringLiteral" and len(n.value) in (64, 65) and len(set(n.value)) == len(n.value)), None)
    if len(f.params) == 1 and alphabet:
        return lambda a: base64_text(a[0], alphabet)
    if len(f.params) == 2 and any(n.type == "BinaryExpression" and n.operator == "^" for n in nodes) and sum(n.type == "ForStatement" for n in nodes) == 3:
        return "rc4"
    return None


def base64_text(s: str, alphabet: str) -> str:
    """Base64 in an alphabet, as UTF-8."""
    at = {c: i for i, c in enumerate(alphabet)}
    bits = n = 0
    out = bytearray()
    for c in s:
        v = at.get(c)
        if v is None or v == 64:
            continue
        bits, n = (bits << 6 | v) & 0xFFFFFF, n + 6
        if n >= 8:
            n -= 8
            out.append(bits >> n & 255)
    try:
        return out.decode("utf-8")
    except UnicodeDecodeError:
        raise Thrown("URIError: URI malformed") from None


def rc4(text: str, key: str) -> str:
    state, j, k = list(range(256)), 0, [ord(c) for c in key]
    if not k:
        raise Unsupported("an empty key")
    for i in range(256):
        j = (j + state[i] + k[i % len(k)]) % 256
        state[i], state[j] = state[j], state[i]
    i = j = 0
    out = []
    for c in text:
        i = (i + 1) % 256
        j = (j + state[i]) % 256
        state[i], state[j] = state[j], state[i]
        out.append(chr(ord(c) ^ state[(state[i] + state[j]) % 256]))
    return "".join(out)


class Interpreter:
    def __init__(self, steps: int = 3_000_000):
        self.steps, self.depth = steps, 0
        self.guesses: dict = {}
        self.trusted: dict = {}
        self.statements = {k[2:]: getattr(self, k) for k in dir(self) if k.startswith("s_")}
        self.expressions = {k[2:]: getattr(self, k) for k in dir(self) if k.startswith("e_")}
        self.globals = Env()
        g = self.globals.vars

        def native(f):
            return Func(None, None, native=f)

        g["undefined"], g["NaN"], g["Infinity"] = UNDEFINED, math.nan, math.inf
        g["parseInt"] = native(lambda t, a: parse_int(arg(a, 0), arg(a, 1)))
        g["parseFloat"] = native(lambda t, a: float(m[0]) if (m := re.match(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", to_str(arg(a, 0)))) else math.nan)
        g["isNaN"] = native(lambda t, a: math.isnan(to_num(arg(a, 0))))
        g["Number"] = native(lambda t, a: to_num(a[0]) if a else 0.0)
        g["Boolean"] = native(lambda t, a: truthy(arg(a, 0)))
        g["String"] = native(lambda t, a: to_str(a[0]) if a else "")
        g["String"].props["fromCharCode"] = native(lambda t, a: from_units(numbers.to_uint32(to_num(x)) for x in a))
        g["decodeURIComponent"] = native(lambda t, a: decode_uri(to_str(arg(a, 0))))
        g["encodeURIComponent"] = native(lambda t, a: encode_uri_component(to_str(arg(a, 0))))
        g["decodeURI"] = native(lambda t, a: decode_uri(to_str(arg(a, 0)), ";/?:@&=+$,#"))
        g["unescape"] = native(lambda t, a: unescape(to_str(arg(a, 0))))
        g["atob"] = native(lambda t, a: atob(to_str(arg(a, 0))))
        g["Array"] = native(lambda t, a: Obj(items=[UNDEFINED] * int(a[0]) if len(a) == 1 and isinstance(a[0], float) and a[0] < 1e6 else list(a)))
        g["Object"] = native(lambda t, a: Obj())
        g["Error"] = native(lambda t, a: Obj({"message": to_str(arg(a, 0))}))
        g["RegExp"] = native(lambda t, a: Obj({"source": to_str(arg(a, 0)), "flags": to_str(arg(a, 1)) if len(a) > 1 else ""}))
        g["Function"] = native(lambda t, a: _no("Function"))
        m = {k: native(lambda t, a, f=f: f(to_num(arg(a, 0)))) for k, f in (("floor", lambda x: float(math.floor(x)) if math.isfinite(x) else x), ("ceil", lambda x: float(math.ceil(x)) if math.isfinite(x) else x), ("abs", abs), ("round", lambda x: float(math.floor(x + 0.5))), ("sqrt", lambda x: math.sqrt(x) if x >= 0 else math.nan))}
        m["pow"] = native(lambda t, a: numbers.power(to_num(arg(a, 0)), to_num(arg(a, 1))))
        m["max"] = native(lambda t, a: max(map(to_num, a), default=-math.inf))
        m["min"] = native(lambda t, a: min(map(to_num, a), default=math.inf))
        g["Math"] = Obj(m)
        g["JSON"] = Obj()
        g["globalThis"] = g["window"] = g["self"] = Obj(g)

    # running

    def tick(self, n: int = 1) -> None:
        self.steps -= n
        if self.steps < 0:
            raise Unsupported("the step budget is used up")

    def run(self, program: Node):
        """Runs a program; later runs see its variables."""
        try:
            return self.body(program.body, self.globals, function=True)
        except RecursionError:
            raise Unsupported("nested too deeply") from None

    def evaluate(self, n: Node):
        return self.e(n, self.globals)

    def hoist(self, nodes: list[Node], env: Env) -> None:
        """Declares what var declares in these statements, functions inside aside."""
        todo = list(nodes)
        while todo:
            n = todo.pop()
            if n.type in FUNCTIONS or n.type in ("ClassDeclaration", "ClassExpression"):
                continue
            if n.type == "VariableDeclaration" and n.kind == "var":
                for d in n.declarations:
                    for x in pattern_names(d.id):
                        env.vars.setdefault(x.name, UNDEFINED)
            todo.extend(n.kids())

    def body(self, nodes: list[Node], env: Env, function: bool = False):
        if function:
            self.hoist(nodes, env)
        for n in nodes:
            if n.type == "FunctionDeclaration":
                env.vars[n.id.name] = Func(n, env)
        for n in nodes:
            self.s(n, env)

    def s(self, n: Node, env: Env) -> None:
        self.steps -= 1
        if self.steps < 0:
            raise Unsupported("the step budget is used up")
        f = self.statements.get(n.type)
        if f is None:
            raise Unsupported(n.type)
        f(n, env)

    def s_ExpressionStatement(self, n, env):
        self.e(n.expression, env)

    def s_EmptyStatement(self, n, env):
        pass

    s_FunctionDeclaration = s_DebuggerStatement = s_EmptyStatement

    def s_BlockStatement(self, n, env):
        self.body(n.body, Env(env) if any(x.type == "FunctionDeclaration" or (x.type == "VariableDeclaration" and x.kind != "var") for x in n.body) else env)

    def s_VariableDeclaration(self, n, env):
        for d in n.declarations:
            if d.init is None and n.kind == "var":
                continue
            value = UNDEFINED if d.init is None else self.e(d.init, env)
            if n.kind == "var":
                self.assign(d.id, value, env)
            else:
                self.bind(d.id, value, env)

    def bind(self, p, value, env):
        if p.type == "Identifier":
            env.vars[p.name] = value
        elif p.type == "AssignmentPattern":
            self.bind(p.left, self.e(p.right, env) if value is UNDEFINED else value, env)
        elif p.type == "ArrayPattern":
            for i, x in enumerate(p.elements):
                if x is not None:
                    if x.type == "RestElement":
                        self.bind(x.argument, Obj(items=list(value.items[i:])), env)
                    else:
                        self.bind(x, self.get(value, float(i)), env)
        else:
            raise Unsupported(p.type)

    def s_ReturnStatement(self, n, env):
        raise _Return(UNDEFINED if n.argument is None else self.e(n.argument, env))

    def s_IfStatement(self, n, env):
        if truthy(self.e(n.test, env)):
            self.s(n.consequent, env)
        elif n.alternate is not None:
            self.s(n.alternate, env)

    def loop(self, n, env) -> bool:
        """One turn of a body; whether the loop goes on."""
        try:
            self.s(n, env)
        except _Break:
            return False
        except _Continue:
            pass
        return True

    def s_WhileStatement(self, n, env):
        while truthy(self.e(n.test, env)):
            if not self.loop(n.body, env):
                break

    def s_DoWhileStatement(self, n, env):
        while self.loop(n.body, env) and truthy(self.e(n.test, env)):
            pass

    def s_ForStatement(self, n, env):
        env = Env(env)
        if n.init is not None:
            self.s(n.init, env) if n.init.type == "VariableDeclaration" else self.e(n.init, env)
        while n.test is None or truthy(self.e(n.test, env)):
            if not self.loop(n.body, env):
                break
            if n.update is not None:
                self.e(n.update, env)

    def s_ForInStatement(self, n, env):
        o = self.e(n.right, env)
        keys = [str(i) for i in range(len(o.items))] if isinstance(o, Obj) and o.items is not None else list(o.props) if isinstance(o, Obj) else []
        self.each(n, keys, env)

    def s_ForOfStatement(self, n, env):
        o = self.e(n.right, env)
        self.each(n, list(o) if isinstance(o, str) else list(o.items or []), env)

    def each(self, n, values, env):
        for v in values:
            inner = Env(env)
            if n.left.type == "VariableDeclaration":
                p = n.left.declarations[0].id
                self.assign(p, v, inner) if n.left.kind == "var" else self.bind(p, v, inner)
            else:
                self.assign(n.left, v, inner)
            if not self.loop(n.body, inner):
                break

    def s_BreakStatement(self, n, env):
        if n.label:
            raise Unsupported("labels")
        raise _Break

    def s_ContinueStatement(self, n, env):
        if n.label:
            raise Unsupported("labels")
        raise _Continue

    def s_ThrowStatement(self, n, env):
        raise Thrown(self.e(n.argument, env))

    def s_TryStatement(self, n, env):
        try:
            self.s(n.block, env)
        except Thrown as t:
            if n.handler is None:
                raise
            inner = Env(env)
            if n.handler.param is not None:
                self.bind(n.handler.param, t.value, inner)
            self.s(n.handler.body, inner)
        finally:
            if n.finalizer is not None:
                self.s(n.finalizer, env)

    def s_SwitchStatement(self, n, env):
        v, env = self.e(n.discriminant, env), Env(env)
        at = next((i for i, c in enumerate(n.cases) if c.test is not None and strict(v, self.e(c.test, env))), None)
        if at is None:
            at = next((i for i, c in enumerate(n.cases) if c.test is None), None)
        if at is None:
            return
        try:
            for c in n.cases[at:]:
                self.body(c.consequent, env)
        except _Break:
            pass

    # expressions

    def e(self, n: Node, env: Env):
        self.steps -= 1
        if self.steps < 0:
            raise Unsupported("the step budget is used up")
        f = self.expressions.get(n.type)
        if f is None:
            raise Unsupported(n.type)
        return f(n, env)

    def e_StringLiteral(self, n, env):
        return n.value

    def e_NumericLiteral(self, n, env):
        return float(n.value)

    def e_BooleanLiteral(self, n, env):
        return n.value

    def e_NullLiteral(self, n, env):
        return None

    def e_TemplateLiteral(self, n, env):
        out = n.quasis[0].cooked
        for q, x in zip(n.quasis[1:], n.expressions, strict=True):
            out += to_str(self.e(x, env)) + q.cooked
        return out

    def e_RegExpLiteral(self, n, env):
        return Obj({"source": n.pattern, "flags": n.flags})

    def e_Identifier(self, n, env):
        name = n.name
        while env is not None:
            found = env.vars
            if name in found:
                return found[name]
            env = env.parent
        raise Thrown(Obj({"message": f"{name} is not defined"}))

    def e_ThisExpression(self, n, env):
        home = env.home("this")
        return home.vars["this"] if home else UNDEFINED

    def e_ArrayExpression(self, n, env):
        out = []
        for x in n.elements:
            if x is not None and x.type == "SpreadElement":
                out += self.e(x.argument, env).items
            else:
                out.append(UNDEFINED if x is None else self.e(x, env))
        return Obj(items=out)

    def e_ObjectExpression(self, n, env):
        o = Obj()
        for p in n.properties:
            if p.type == "SpreadElement":
                o.props.update(self.e(p.argument, env).props)
                continue
            key = to_str(self.e(p.key, env)) if p.computed or p.key.type != "Identifier" else p.key.name
            if p.type == "ObjectMethod":
                if p.kind != "method":
                    raise Unsupported("accessors")
                o.props[key] = Func(p, env)
            else:
                o.props[key] = self.e(p.value, env)
        return o

    def e_FunctionExpression(self, n, env):
        if n.generator or n.is_async:
            raise Unsupported("generators")
        f = Func(n, env)
        if n.id is not None:
            f.env = Env(env)
            f.env.vars[n.id.name] = f
        return f

    def e_ArrowFunctionExpression(self, n, env):
        home = env.home("this")
        return Func(n, env, home.vars["this"] if home else UNDEFINED)

    def e_SequenceExpression(self, n, env):
        for x in n.expressions:
            v = self.e(x, env)
        return v

    def e_ConditionalExpression(self, n, env):
        return self.e(n.consequent if truthy(self.e(n.test, env)) else n.alternate, env)

    def e_LogicalExpression(self, n, env):
        v = self.e(n.left, env)
        stop = truthy(v) if n.operator == "||" else not truthy(v) if n.operator == "&&" else v is not None and v is not UNDEFINED
        return v if stop else self.e(n.right, env)

    def e_UnaryExpression(self, n, env):
        op = n.operator
        if op == "typeof":
            if n.argument.type == "Identifier" and env.home(n.argument.name) is None:
                return "undefined"
            return type_of(self.e(n.argument, env))
        if op == "delete":
            if n.argument.type == "MemberExpression":
                o, k = self.place(n.argument, env)
                o.props.pop(to_str(k), None)
            return True
        v = self.e(n.argument, env)
        if op == "!":
            return not truthy(v)
        if op == "void":
            return UNDEFINED
        if op == "~":
            return float(~numbers.to_int32(to_num(v)))
        return -to_num(v) if op == "-" else to_num(v)

    def operate(self, op, a, b):
        if op == "+":
            if isinstance(a, (str, Obj)) or isinstance(b, (str, Obj)):
                out = to_str(a) + to_str(b)
                self.tick(len(out) // 64)
                return out
            return to_num(a) + to_num(b)
        if op == "===":
            return strict(a, b)
        if op == "!==":
            return not strict(a, b)
        if op == "==":
            return loose(a, b)
        if op == "!=":
            return not loose(a, b)
        if op in ("<", ">", "<=", ">="):
            if isinstance(a, str) and isinstance(b, str):
                a, b = units(a), units(b)
            else:
                a, b = to_num(a), to_num(b)
            return a < b if op == "<" else a > b if op == ">" else a <= b if op == "<=" else a >= b
        if op == "in":
            return to_str(a) in b.props or (b.items is not None and to_str(a).isdigit() and int(to_str(a)) < len(b.items))
        if op == "instanceof":
            return False
        return numbers.binary(op, to_num(a), to_num(b))

    def e_BinaryExpression(self, n, env):
        a, b, op = self.e(n.left, env), self.e(n.right, env), n.operator
        if a.__class__ is float and b.__class__ is float:
            if op == "+":
                return a + b
            if op == "-":
                return a - b
            if op == "*":
                return a * b
            if op == "<":
                return a < b
            if op == "===":
                return a == b
        return self.operate(op, a, b)

    def place(self, n, env):
        o = self.e(n.object, env)
        return o, self.e(n.property, env) if n.computed else n.property.name

    def assign(self, target, value, env):
        if target.type == "Identifier":
            (env.home(target.name) or self.globals).vars[target.name] = value
        elif target.type == "MemberExpression":
            o, k = self.place(target, env)
            self.put(o, k, value)
        elif target.type == "ArrayPattern":
            for i, x in enumerate(target.elements):
                if x is not None:
                    self.assign(x, self.get(value, float(i)), env)
        else:
            raise Unsupported(target.type)

    def e_AssignmentExpression(self, n, env):
        if n.operator == "=":
            v = self.e(n.right, env)
            self.assign(n.left, v, env)
            return v
        old = self.e(n.left, env)
        op = n.operator[:-1]
        if op in ("&&", "||", "??"):
            keep = not truthy(old) if op == "&&" else truthy(old) if op == "||" else old is not None and old is not UNDEFINED
            if keep:
                return old
            v = self.e(n.right, env)
        else:
            v = self.operate(op, old, self.e(n.right, env))
        self.assign(n.left, v, env)
        return v

    def e_UpdateExpression(self, n, env):
        old = to_num(self.e(n.argument, env))
        new = old + (1 if n.operator == "++" else -1)
        self.assign(n.argument, new, env)
        return new if n.prefix else old

    def e_MemberExpression(self, n, env):
        o, k = self.place(n, env)
        return self.get(o, k)

    def e_CallExpression(self, n, env):
        c, this = n.callee, UNDEFINED
        if c.type == "MemberExpression":
            this, k = self.place(c, env)
            f = self.get(this, k)
        else:
            f = self.e(c, env)
        args = []
        for a in n.arguments:
            if a.type == "SpreadElement":
                args += self.e(a.argument, env).items
            else:
                args.append(self.e(a, env))
        return self.call(f, this, args)

    def e_NewExpression(self, n, env):
        f = self.e(n.callee, env)
        args = [self.e(a, env) for a in n.arguments]
        if not isinstance(f, Func):
            raise Thrown("not a constructor")
        if f.native:
            return f.native(UNDEFINED, args)
        o = Obj()
        o.props["__proto__"] = f.props.get("prototype")
        out = self.call(f, o, args)
        return out if isinstance(out, Obj) else o

    def call(self, f, this, args):
        if not isinstance(f, Func):
            raise Thrown(Obj({"message": "not a function"}))
        if f.native:
            self.tick(4)
            return f.native(this, args)
        fast = self.fast_form(f, args)
        if fast is not None:
            trust = self.trusted.get(id(f.node), 0)
            if trust < 0:  # it was wrong once
                return self.interpret(f, this, args)
            if trust >= 3:
                self.tick(len(args[0]) // 8 + 20)
                return fast(args)
            try:
                wanted = fast(args)
            except (Thrown, Unsupported):
                wanted = None
            out = self.interpret(f, this, args)
            self.trusted[id(f.node)] = trust + 1 if wanted == out else -1
            return out
        return self.interpret(f, this, args)

    def fast_form(self, f, args):
        """The guess for a function, if these arguments suit it."""
        key = id(f.node)
        if key not in self.guesses:
            self.guesses[key] = guess(f.node)
        g = self.guesses[key]
        if g is None or not all(isinstance(a, str) for a in args) or len(args) != len(f.node.params):
            return None
        if g == "rc4":  # what it decodes with is a sibling that is known already
            inner = next((x for x in self.guesses.values() if callable(x)), None)
            return (lambda a: rc4(inner([a[0]]), a[1])) if inner else None
        return g

    def interpret(self, f, this, args):
        self.depth += 1
        if self.depth > 400:
            self.depth = 0
            raise Unsupported("calls are nested too deeply")
        try:
            n, env = f.node, Env(f.env)
            arrow = n.type == "ArrowFunctionExpression"
            env.vars["this"] = f.this if arrow else this
            if not arrow:
                env.vars["arguments"] = Obj(items=list(args))
            for i, p in enumerate(n.params):
                if p.type == "RestElement":
                    self.bind(p.argument, Obj(items=list(args[i:])), env)
                else:
                    self.bind(p, args[i] if i < len(args) else UNDEFINED, env)
            if arrow and n.body.type != "BlockStatement":
                return self.e(n.body, env)
            try:
                self.body(n.body.body, env, function=True)
            except _Return as r:
                return r.value
            return UNDEFINED
        finally:
            self.depth -= 1

    # members

    def put(self, o, k, value) -> None:
        if not isinstance(o, Obj):
            if o is None or o is UNDEFINED:
                raise Thrown(Obj({"message": "cannot set a property"}))
            return
        if o.items is not None:
            i = index(k)
            if i is not None:
                if i > len(o.items) + 100_000:
                    raise Unsupported("a sparse array")
                o.items.extend([UNDEFINED] * (i + 1 - len(o.items)))
                o.items[i] = value
                return
            if k == "length":
                n = int(to_num(value))
                del o.items[n:]
                o.items.extend([UNDEFINED] * (n - len(o.items)))
                return
        o.props[to_str(k)] = value

    def get(self, o, k):
        if o is None or o is UNDEFINED:
            raise Thrown(Obj({"message": f"cannot read {to_str(k)} of {to_str(o)}"}))
        if isinstance(o, str):
            i = index(k)
            if i is not None:
                u = units(o) if not o.isascii() else o
                return (u[i] if o.isascii() else from_units([u[i]])) if i < len(u) else UNDEFINED
            if k == "length":
                return float(len(o)) if o.isascii() else float(len(units(o)))
            return method(STRING, k)
        if isinstance(o, Obj):
            if o.items is not None:
                i = index(k)
                if i is not None:
                    return o.items[i] if i < len(o.items) else UNDEFINED
                if k == "length":
                    return float(len(o.items))
                if to_str(k) not in o.props:
                    return self.higher(o, to_str(k)) or method(ARRAY, k)
            k = to_str(k)
            at = o
            while isinstance(at, Obj):
                if k in at.props:
                    return at.props[k]
                at = at.props.get("__proto__")
            if isinstance(o, Func) and k in ("call", "apply", "bind"):
                return self.caller(o, k)
            return method(OBJECT, k)
        return method(NUMBER, k)

    def higher(self, o, k):
        """Array methods that take functions."""
        fs = {
            "forEach": lambda t, a: [self.call(a[0], UNDEFINED, [x, float(i), o]) for i, x in enumerate(list(o.items))] and UNDEFINED,
            "map": lambda t, a: Obj(items=[self.call(a[0], UNDEFINED, [x, float(i), o]) for i, x in enumerate(list(o.items))]),
            "filter": lambda t, a: Obj(items=[x for i, x in enumerate(list(o.items)) if truthy(self.call(a[0], UNDEFINED, [x, float(i), o]))]),
        }
        return Func(None, None, native=fs[k]) if k in fs else None

    def caller(self, f, k):
        if k == "call":
            return Func(None, None, native=lambda t, a: self.call(f, arg(a, 0), a[1:]))
        if k == "apply":
            return Func(None, None, native=lambda t, a: self.call(f, arg(a, 0), list(a[1].items) if len(a) > 1 and isinstance(a[1], Obj) else []))
        return Func(None, None, native=lambda t, a: Func(None, None, native=lambda t2, b: self.call(f, arg(a, 0), [*a[1:], *b])))


def _no(what):
    raise Unsupported(what)


def arg(a, i):
    return a[i] if i < len(a) else UNDEFINED


def index(k) -> int | None:
    if isinstance(k, float) and k >= 0 and k.is_integer():
        return int(k)
    if isinstance(k, str) and k.isascii() and k.isdigit() and (k == "0" or k[0] != "0"):
        return int(k)
    return None


def method(table, k):
    f = table.get(to_str(k))
    return Func(None, None, native=f) if f else UNDEFINED


def _int(a, i, default):
    v = arg(a, i)
    n = to_num(v)
    return default if v is UNDEFINED else 0 if math.isnan(n) else int(max(-1e9, min(1e9, n)))


def _slice(n, a):
    lo, hi = _int(a, 0, 0), _int(a, 1, n)
    lo, hi = (max(0, n + lo) if lo < 0 else min(lo, n)), (max(0, n + hi) if hi < 0 else min(hi, n))
    return lo, max(lo, hi)


def _sub(t, lo, hi):
    return t[lo:hi] if t.isascii() else from_units(units(t)[lo:hi])


def _length(t):
    return len(t) if t.isascii() else len(units(t))


def _substring(t, a):
    n = _length(t)
    lo, hi = (min(n, max(0, x)) for x in (_int(a, 0, 0), _int(a, 1, n)))
    return _sub(t, min(lo, hi), max(lo, hi))


def _replace(t, a):
    p, new = arg(a, 0), to_str(arg(a, 1))
    if isinstance(p, Obj) and "source" in p.props:
        return re.sub(p.props["source"], lambda m: new, t, count=0 if "g" in p.props["flags"] else 1)
    return t.replace(to_str(p), new, 1)


def _search(t, a):
    p = arg(a, 0)
    if to_str(p) == "(((.+)+)+)+$":  # always at the start; slow on purpose
        return 0.0
    m = re.search(p.props["source"] if isinstance(p, Obj) else to_str(p), t)
    return float(m.start()) if m else -1.0


def _splice(o, a):
    lo = _slice(len(o.items), a[:1])[0]
    n = max(0, _int(a, 1, len(o.items)))
    out = o.items[lo : lo + n]
    o.items[lo : lo + n] = a[2:]
    return Obj(items=out)


def _push(t, a):
    t.items.extend(a)
    return float(len(t.items))


def _unshift(t, a):
    t.items[:0] = a
    return float(len(t.items))


def _reverse(t, a):
    t.items.reverse()
    return t


STRING = {
    "charAt": lambda t, a: _sub(t, _int(a, 0, 0), _int(a, 0, 0) + 1) if _int(a, 0, 0) >= 0 else "",
    "charCodeAt": lambda t, a: (float(ord(t[i])) if 0 <= (i := _int(a, 0, 0)) < len(t) else math.nan) if t.isascii() else float(u[i]) if 0 <= (i := _int(a, 0, 0)) < len(u := units(t)) else math.nan,
    "codePointAt": lambda t, a: float(ord(from_units(units(t)[_int(a, 0, 0) :])[0])) if _int(a, 0, 0) < _length(t) else UNDEFINED,
    "indexOf": lambda t, a: float(t.find(to_str(arg(a, 0)), _int(a, 1, 0))),
    "lastIndexOf": lambda t, a: float(t.rfind(to_str(arg(a, 0)))),
    "includes": lambda t, a: to_str(arg(a, 0)) in t,
    "slice": lambda t, a: _sub(t, *_slice(_length(t), a)),
    "substring": _substring,
    "substr": lambda t, a: _sub(t, lo := _slice(_length(t), a[:1])[0], lo + max(0, _int(a, 1, 1 << 30))),
    "split": lambda t, a: Obj(items=[t] if arg(a, 0) is UNDEFINED else list(t) if arg(a, 0) == "" else t.split(to_str(a[0]))),
    "concat": lambda t, a: t + "".join(map(to_str, a)),
    "toString": lambda t, a: t,
    "valueOf": lambda t, a: t,
    "toLowerCase": lambda t, a: t.lower(),
    "toUpperCase": lambda t, a: t.upper(),
    "trim": lambda t, a: t.strip(),
    "repeat": lambda t, a: t * _int(a, 0, 0) if _int(a, 0, 0) * len(t) < 1e7 else _no("a huge string"),
    "replace": _replace,
    "search": _search,
    "padStart": lambda t, a: t.rjust(_int(a, 0, 0), to_str(a[1])[0] if len(a) > 1 else " "),
    "startsWith": lambda t, a: t.startswith(to_str(arg(a, 0))),
    "endsWith": lambda t, a: t.endswith(to_str(arg(a, 0))),
    "at": lambda t, a: _sub(t, i, i + 1) if (i := _int(a, 0, 0) + (_length(t) if _int(a, 0, 0) < 0 else 0)) >= 0 else UNDEFINED,
}
ARRAY = {
    "push": _push,
    "pop": lambda t, a: t.items.pop() if t.items else UNDEFINED,
    "shift": lambda t, a: t.items.pop(0) if t.items else UNDEFINED,
    "unshift": _unshift,
    "slice": lambda t, a: Obj(items=t.items[slice(*_slice(len(t.items), a))]),
    "splice": _splice,
    "join": lambda t, a: (to_str(a[0]) if a and a[0] is not UNDEFINED else ",").join("" if x is None or x is UNDEFINED else to_str(x) for x in t.items),
    "reverse": _reverse,
    "concat": lambda t, a: Obj(items=[*t.items, *(y for x in a for y in (x.items if isinstance(x, Obj) and x.items is not None else [x]))]),
    "indexOf": lambda t, a: float(next((i for i, x in enumerate(t.items) if strict(x, arg(a, 0))), -1)),
    "includes": lambda t, a: any(strict(x, arg(a, 0)) for x in t.items),
    "toString": lambda t, a: to_str(t),
}


def _radix(v: float, base: int) -> str:
    if base == 10 or not math.isfinite(v):
        return numbers.to_text(v)
    if not float(v).is_integer():
        raise Unsupported("fractions in another base")
    digits, n, out = "0123456789abcdefghijklmnopqrstuvwxyz", abs(int(v)), ""
    while n:
        n, d = divmod(n, base)
        out = digits[d] + out
    return ("-" if v < 0 else "") + (out or "0")


NUMBER = {"toString": lambda t, a: to_str(t) if isinstance(t, bool) else _radix(t, _int(a, 0, 10)), "valueOf": lambda t, a: t, "toFixed": lambda t, a: f"{t:.{_int(a, 0, 0)}f}"}
OBJECT = {
    "hasOwnProperty": lambda t, a: to_str(arg(a, 0)) in t.props,
    "toString": lambda t, a: to_str(t),
    "test": lambda t, a: bool(re.search(t.props["source"], to_str(arg(a, 0)))) if "source" in t.props else _no("test"),
}
