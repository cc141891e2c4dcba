"""Taking bundles apart: modules, their paths, and imports and exports again."""

from __future__ import annotations

from collections.abc import Callable

from scriptloom.js import paths
from scriptloom.js.ask import is_, is_ident, is_member, is_number, is_string, prop_name, valid_identifier
from scriptloom.js.nodes import Node, expr, ident, member, string
from scriptloom.js.printer import to_code
from scriptloom.js.scope import Binding, Scopes, rename


class Lazy:
    """A value made when it is first asked for."""

    def __init__(self, make: Callable):
        self.make, self.value = make, None

    def __call__(self):
        if self.value is None:
            self.value = self.make()
        return self.value


class Module:
    def __init__(self, id_: str, tree: Node, entry: bool, path: str | None = None, dependencies: dict[str, str] | None = None):
        self.id, self.tree, self.is_entry, self.dependencies = id_, tree, entry, dependencies or {}
        self.path = path or paths.default_path(id_, entry)
        self.is_esm = False

    @property
    def code(self) -> str:
        return to_code(self.tree, marks=True)


class Bundle:
    def __init__(self, type_: str, entry_id: str, modules: dict[str, Module]):
        self.type, self.entry_id, self.modules = type_, entry_id, modules

    def apply_mappings(self, mappings: dict[str, Callable[[Node], bool]]) -> None:
        """Names modules by tests on their nodes; one test must not fit two modules."""
        seen: set[str] = set()
        for m in self.modules.values():
            nodes = list(m.tree.walk())
            for path, test in mappings.items():
                if any(map(test, nodes)):
                    if path in seen:
                        raise ValueError(f"the mapping {path} fits several modules")
                    seen.add(path)
                    if m.path.startswith("./node_modules/") or path.startswith("node_modules/"):
                        m.path = path
                    else:
                        m.path = path if path.startswith(".") else "./" + path


def is_function(n: Node | None) -> bool:
    return n is not None and n.type in ("FunctionExpression", "ArrowFunctionExpression", "ObjectMethod")


def container(n: Node | None) -> dict[str, Node] | None:
    """Module functions by id, of an array (by index) or an object (by key)."""
    if is_(n, "ArrayExpression"):
        if not n.elements or not all(e is None or is_function(e) or is_(e, "NullLiteral") or is_number(e) for e in n.elements):
            return None
        found = {str(i): e for i, e in enumerate(n.elements) if is_function(e)}
        return found or None
    if is_(n, "ObjectExpression"):
        out = {}
        for p in n.properties:
            name = prop_name(p) if p.type in ("ObjectProperty", "ObjectMethod") else None
            if name is None:
                return None
            f = p if p.type == "ObjectMethod" else p.value
            if is_function(f):
                out[name] = f
            elif not is_string(f):
                return None
        return {k: out[k] for k in paths.key_order(out)} or None
    return None


def is_require(f: Node, modules: str) -> bool:
    """function (id) { ... modules[id](...) or modules[id].call(...) ... }"""
    if f.type != "FunctionDeclaration" or len(f.params) != 1 or not is_ident(f.params[0]):
        return False
    wanted = f.params[0].name
    for c in f.body.walk():
        if c.type != "CallExpression":
            continue
        m = c.callee
        if is_member(m, prop="call") and m.object.type == "MemberExpression":
            m = m.object
        if m.type == "MemberExpression" and m.computed and is_ident(m.object, modules) and is_ident(m.property, wanted):
            return True
    return False


def assigned_entry(b: Binding) -> str | None:
    """The id in require.s = id."""
    for r in b.refs:
        a = r.parent.parent if r.parent is not None else None
        if is_member(r.parent, prop="s") and is_(a, "AssignmentExpression", operator="=") and a.left is r.parent and (is_number(a.right) or is_string(a.right)):
            return str(a.right.value)
    return None


def required_entry(b: Binding) -> str | None:
    """The id in the first require(id)."""
    for r in b.refs:
        c = r.parent
        if is_(c, "CallExpression") and c.callee is r and c.arguments and (is_number(c.arguments[0]) or is_string(c.arguments[0])):
            return str(c.arguments[0].value)
    return None


def program_of(f: Node, names: tuple[str, ...]) -> Node:
    """A module's function as a program, its parameters called by their roles."""
    body = f.body.body if f.body.type == "BlockStatement" else [expr(f.body)]
    holder = Node("Program", body=[expr(Node("FunctionExpression", id=None, params=list(f.params), body=Node("BlockStatement", body=body), generator=False, is_async=False))])
    scopes = Scopes(holder)
    for p, name in zip(f.params, names, strict=False):
        if is_ident(p) and (b := scopes.bound.get(id(p))) is not None:
            rename(scopes, b, name)
    return Node("Program", body=[s for s in body if not getattr(s, "directive", False)])


WEBPACK = ("module", "exports", "require")
BROWSERIFY = ("require", "module", "exports")


def webpack4(n: Node, scopes: Lazy) -> Bundle | None:
    """(function (modules) { function require(id) {...} ... })([...])"""
    if n.type != "CallExpression" or n.callee.type not in ("FunctionExpression", "ArrowFunctionExpression") or len(n.arguments) < 1 or not n.callee.params or n.callee.body.type != "BlockStatement":
        return None
    found = container(n.arguments[0])
    if not found or not is_ident(n.callee.params[0]):
        return None
    name = n.callee.params[0].name
    req = next((f for f in n.callee.body.body if is_require(f, name)), None)
    if req is None:
        return None
    b = scopes().bound[id(req.id)]
    entry = assigned_entry(b) or required_entry(b) or ""
    return webpack(found, entry)


def webpack5(n: Node, scopes: Lazy) -> Bundle | None:
    """{ var modules = {...}; function require(id) {...} ... }"""
    if n.type not in ("BlockStatement", "Program"):
        return None
    for i, s in enumerate(n.body):
        for d in s.declarations if s.type == "VariableDeclaration" else ():
            if not is_ident(d.id):
                continue
            found = container(d.init)
            req = found and next((f for f in n.body[i + 1 :] if is_require(f, d.id.name)), None)
            if req:
                return webpack(found, assigned_entry(scopes().bound[id(req.id)]) or "")
    return None


def webpack_chunk(n: Node, scopes: Lazy) -> Bundle | None:
    """(self.webpackX = self.webpackX || []).push([[ids], modules, ...])"""
    if not (n.type == "CallExpression" and is_member(n.callee, prop="push") and len(n.arguments) == 1 and is_(n.arguments[0], "ArrayExpression") and len(n.arguments[0].elements) >= 2):
        return None
    target = n.callee.object
    if not (is_(target, "AssignmentExpression", operator="=") and is_(target.right, "LogicalExpression", operator="||") and target.left.type == "MemberExpression" and (prop_name(target.left) or "").startswith("webpack")):
        return None
    ids, modules = n.arguments[0].elements[:2]
    if not is_(ids, "ArrayExpression") or not all(is_number(x) or is_string(x) for x in ids.elements):
        return None
    found = container(modules)
    return webpack(found, "") if found else None


def webpack(found: dict[str, Node], entry: str) -> Bundle:
    bundle = Bundle("webpack", entry, {k: Module(k, program_of(f, WEBPACK), k == entry) for k, f in found.items()})
    for m in bundle.modules.values():
        inline_var_injections(m.tree)
    for m in bundle.modules.values():
        m.is_esm = convert_esm(m.tree)
    return bundle


def browserify(n: Node, scopes: Lazy) -> Bundle | None:
    """f({id: [function (require, module, exports) {...}, {name: id}]}, {}, [entry])"""
    if n.type != "CallExpression" or len(n.arguments) != 3:
        return None
    modules, cache, entries = n.arguments
    if not (is_(modules, "ObjectExpression") and modules.properties and is_(cache, "ObjectExpression") and is_(entries, "ArrayExpression") and entries.elements and (is_number(entries.elements[0]) or is_string(entries.elements[0]))):
        return None
    tree: dict[str, dict[str, str]] = {}
    functions: dict[str, Node] = {}
    for p in modules.properties:
        if not (p.type == "ObjectProperty" and is_(p.value, "ArrayExpression") and len(p.value.elements) == 2 and is_function(p.value.elements[0]) and is_(p.value.elements[1], "ObjectExpression")):
            return None
        key, deps = prop_name(p), {}
        for d in p.value.elements[1].properties:
            if d.type != "ObjectProperty" or prop_name(d) is None:
                return None
            if is_number(d.value) or is_string(d.value):  # others are outside the bundle
                deps[str(d.value.value)] = prop_name(d)
        tree[key], functions[key] = deps, p.value.elements[0]
    entry = str(entries.elements[0].value)
    resolved = paths.resolve_tree(tree, entry)
    out = {}
    for k in paths.key_order(functions):
        out[k] = Module(k, program_of(functions[k], BROWSERIFY), k == entry, resolved.get(k), tree[k])
    return Bundle("browserify", entry, out)


def unpack(tree: Node, mappings: dict | None = None) -> Bundle | None:
    """The first bundle in a program, or None; the tree is used up."""
    scopes = Lazy(lambda: Scopes(tree))
    for n in tree.walk():
        for f in (webpack4, webpack_chunk, browserify) if n.type == "CallExpression" else (webpack5,) if n.type in ("BlockStatement", "Program") else ():
            bundle = f(n, scopes)
            if bundle is not None:
                bundle.apply_mappings(mappings or {})
                if bundle.type == "webpack":
                    for m in bundle.modules.values():
                        convert_default_require(m.tree, bundle)
                        replace_require_paths(m, bundle)
                return bundle
    return None


def requires(tree: Node) -> list[Node]:
    """require(x) calls with one literal argument, where require is not declared."""
    scopes = Scopes(tree)
    return [r.parent for r in scopes.globals.get("require", []) if is_(r.parent, "CallExpression") and r.parent.callee is r and len(r.parent.arguments) == 1 and (is_number(r.parent.arguments[0]) or is_string(r.parent.arguments[0]))]


def inline_var_injections(tree: Node) -> None:
    """(function (g) {...}).call(exports, require(7)) as the last statement: var g = require(7), and the body."""
    while tree.body:
        s = tree.body[-1]
        e = s.expression if s.type == "ExpressionStatement" else None
        if not (is_(e, "CallExpression") and is_member(e.callee, prop="call") and e.callee.object.type == "FunctionExpression" and e.arguments):
            break
        f = e.callee.object
        this, *args = e.arguments
        if this.type not in ("ThisExpression", "Identifier", "MemberExpression") or len(args) < len(f.params) or not all(map(is_ident, f.params)):
            break
        declared = [Node("VariableDeclaration", kind="var", declarations=[Node("VariableDeclarator", id=ident(p.name), init=a)]) for p, a in zip(f.params, args, strict=False)]
        s.replace(*declared, *f.body.body)


def convert_esm(tree: Node) -> bool:
    """require.r, require.d and require.hmd at the top level: exports and imports; whether the module was one with exports."""
    esm = any(is_(s, "ExpressionStatement") and is_(s.expression, "CallExpression") and is_member(s.expression.callee, "require", "r") for s in tree.body)
    for s in list(tree.body):
        e = s.expression if s.type == "ExpressionStatement" else None
        if is_(e, "CallExpression") and is_member(e.callee, "require", "r"):
            s.remove()
        elif is_(e, "CallExpression") and is_member(e.callee, "require", "d"):
            own = object_of(tree, e.arguments[0]) if len(e.arguments) == 2 else None
            for name, value in defined(e) if own is not None else reversed(defined(e)):
                if own is None:
                    export(tree, name, value, s)
                else:  # not the module's exports but an object that gathers them
                    own.set("properties", [*own.properties, Node("ObjectProperty", key=ident(name) if valid_identifier(name) else string(name), value=value, computed=False, shorthand=False)])
            s.remove()
        elif is_(e, "AssignmentExpression", operator="=") and is_ident(e.left, "module") and is_(e.right, "CallExpression") and is_member(e.right.callee, prop="hmd"):
            s.remove()
    if esm:
        for s in list(tree.body):
            if s.type != "VariableDeclaration" or len(s.declarations) != 1:
                continue
            d = s.declarations[0]
            if is_ident(d.id) and is_(d.init, "CallExpression") and is_ident(d.init.callee, "require") and len(d.init.arguments) == 1 and is_number(d.init.arguments[0]):
                s.replace(Node("ImportDeclaration", specifiers=[Node("ImportNamespaceSpecifier", local=d.id)], source=d.init.arguments[0]))
    return esm


def object_of(tree: Node, n: Node) -> Node | None:
    """The object literal that a top-level variable other than exports holds."""
    b = Scopes(tree).program.own.get(n.name) if is_ident(n) and n.name != "exports" else None
    return b.path.init if b is not None and b.path.type == "VariableDeclarator" and is_(b.path.init, "ObjectExpression") else None


def defined(c: Node) -> list[tuple[str, Node]]:
    """(name, value) of require.d(exports, "name", function () { return value; }) and of the object form."""
    from scriptloom.js.deobfuscate import single_return

    a = c.arguments
    if len(a) == 3 and is_string(a[1]) and is_function(a[2]) and single_return(a[2]) is not None:
        return [(a[1].value, single_return(a[2]))]
    out = []
    if len(a) == 2 and is_(a[1], "ObjectExpression"):
        for p in a[1].properties:
            f = p if p.type == "ObjectMethod" else getattr(p, "value", None)
            v = single_return(f) if is_function(f) else None
            if v is not None and prop_name(p) is not None:
                out.append((prop_name(p), v))
    return out


def export(tree: Node, name: str, value: Node, at: Node) -> None:
    """Turns a binding into an export of a name; other values are exported as constants."""
    scopes = Scopes(tree)
    b = scopes.program.own.get(value.name) if is_ident(value) else None
    if b is not None:
        p = b.path
        s = p.parent if p.type == "VariableDeclarator" else p
        if s.parent is tree and (p.type in ("FunctionDeclaration", "ClassDeclaration") or (p.type == "VariableDeclarator" and len(s.declarations) == 1 and is_ident(p.id))):
            if name == "default":
                if p.type == "VariableDeclarator":
                    if len(b.refs) <= 1 and b.constant and p.init is not None:
                        s.replace(Node("ExportDefaultDeclaration", declaration=p.init))
                        return
                else:
                    place(s, lambda x: Node("ExportDefaultDeclaration", declaration=x))
                    return
            elif valid_identifier(name):
                rename(scopes, b, name)
                place(s, lambda x: Node("ExportNamedDeclaration", declaration=x, specifiers=[], source=None))
                return
        spec = Node("ExportSpecifier", local=ident(b.name), exported=ident(name))
        append(tree, Node("ExportNamedDeclaration", declaration=None, specifiers=[spec], source=None))
        return
    if name == "default":
        append(tree, Node("ExportDefaultDeclaration", declaration=value))
    elif valid_identifier(name):
        d = Node("VariableDeclaration", kind="let", declarations=[Node("VariableDeclarator", id=ident(name), init=value)])
        append(tree, Node("ExportNamedDeclaration", declaration=d, specifiers=[], source=None))


def place(s: Node, wrap) -> None:
    parent = s.parent
    k, i = s.place()
    new = wrap(s)
    new.parent = parent
    parent.__dict__[k][i] = new


def append(tree: Node, s: Node) -> None:
    tree.body.append(s)
    s.parent = tree


def convert_default_require(tree: Node, bundle: Bundle) -> None:
    """require.n(m): m.default where m's module has exports, else m; also called or with .a behind."""
    scopes = Scopes(tree)
    for r in scopes.globals.get("require", []):
        c = r.parent.parent if r.parent is not None else None
        if not (is_member(r.parent, prop="n") and is_(c, "CallExpression") and c.callee is r.parent and len(c.arguments) == 1 and is_ident(c.arguments[0])):
            continue
        b = scopes.binding(c.arguments[0])
        init = b.path.init if b is not None and b.path.type == "VariableDeclarator" else None
        source = init.arguments[0] if is_(init, "CallExpression") and is_ident(init.callee, "require") and len(init.arguments) == 1 else None
        if b is not None and b.path.type == "ImportNamespaceSpecifier":
            source = b.path.parent.source
        target = bundle.modules.get(str(source.value)) if source is not None and is_number(source) else None
        value = member(ident(b.name), "default") if target is not None and target.is_esm else ident(c.arguments[0].name)
        p = c.parent
        if is_(p, "MemberExpression") and p.object is c and is_member(p, prop="a"):
            p.replace(value)
        elif is_(p, "CallExpression") and p.callee is c:
            p.replace(value)
        elif is_(p, "VariableDeclarator") and is_ident(p.id):
            v = scopes.binding(p.id)
            for x in v.refs if v else ():
                q = x.parent
                if is_(q, "CallExpression") and q.callee is x and not q.arguments or is_member(q, prop="a") and q.object is x:
                    q.replace(x)
            c.replace(value)
        else:
            c.replace(value)


def replace_require_paths(m: Module, bundle: Bundle) -> None:
    """require(id) and imports by id: relative paths; ids that are nowhere in the bundle keep a mark."""

    def path(value) -> tuple[str, bool]:
        target = bundle.modules.get(str(value))
        return paths.relative(m.path, target.path if target else f"./{value}.js"), target is None

    for c in requires(m.tree):
        text, missing = path(c.arguments[0].value)
        c.set("arguments", [string(text)])
        if missing:
            c.arguments[0].comment = "missing"
    for s in m.tree.body:
        if s.type == "ImportDeclaration" and is_number(s.source):
            text, missing = path(s.source.value)
            s.set("source", string(text))
            if missing:
                s.source.comment = "missing"
