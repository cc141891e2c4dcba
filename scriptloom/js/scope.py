"""Scopes, bindings and references of a program."""

from __future__ import annotations

from collections.abc import Iterator

from scriptloom.js.nodes import BACKWARDS, FUNCTIONS, Node

SCOPED = FUNCTIONS | {"Program", "BlockStatement", "ForStatement", "ForInStatement", "ForOfStatement", "CatchClause", "SwitchStatement", "ClassDeclaration", "ClassExpression", "StaticBlock"}

# What declares names or has a scope of its own; and what stands for a name (these have nothing below them).
ENTERED = SCOPED | {"VariableDeclarator", "ImportSpecifier", "ImportDefaultSpecifier", "ImportNamespaceSpecifier"}
NAMES = {"Identifier", "JSXIdentifier"}
HEADED = FUNCTIONS | {"CatchClause"}  # what a block is the body of, in the same scope
WALLS = FUNCTIONS | {"StaticBlock"}  # what holds a var


class Binding:
    """A declared name: where it is declared, read and written."""

    def __init__(self, name: str, kind: str, scope: Scope, ident: Node, path: Node):
        self.name, self.kind, self.scope, self.ident, self.path = name, kind, scope, ident, path
        self.refs: list[Node] = []
        self.writes: list[Node] = []

    @property
    def constant(self) -> bool:
        return not self.writes


class Scope:
    def __init__(self, node: Node, parent: Scope | None):
        self.node, self.parent, self.own = node, parent, {}

    def find(self, name: str) -> Binding | None:
        s = self
        while s is not None:
            if name in s.own:
                return s.own[name]
            s = s.parent
        return None

    def names(self) -> set[str]:
        out, s = set(), self
        while s is not None:
            out |= s.own.keys()
            s = s.parent
        return out


def pattern_names(p: Node | None) -> Iterator[Node]:
    """The identifiers that a pattern binds."""
    todo = [p]
    while todo:
        p = todo.pop()
        if p is None:
            continue
        if p.type == "Identifier":
            yield p
        elif p.type == "ArrayPattern":
            todo += reversed(p.elements)
        elif p.type == "ObjectPattern":
            todo += [x.value if x.type == "ObjectProperty" else x.argument for x in reversed(p.properties)]
        elif p.type == "AssignmentPattern":
            todo.append(p.left)
        elif p.type == "RestElement":
            todo.append(p.argument)


def is_reference(n: Node) -> bool:
    """Whether an identifier stands for a variable's value or place."""
    p = n.parent
    t = p.type
    if t in ("MemberExpression", "OptionalMemberExpression"):
        return p.object is n or p.computed
    if t in ("ObjectProperty", "ClassProperty", "ClassMethod", "ObjectMethod"):
        return p.key is not n or p.computed
    if t in ("LabeledStatement", "BreakStatement", "ContinueStatement", "MetaProperty", "ImportSpecifier", "ImportDefaultSpecifier", "ImportNamespaceSpecifier", "ExportAllDeclaration"):
        return False
    if t == "ExportSpecifier":
        return p.local is n and p.parent.source is None
    return True


class Scopes:
    """The analysis of one tree, as it stands."""

    def __init__(self, program: Node):
        self.of_node: dict[int, Scope] = {}
        self.bound: dict[int, Binding] = {}  # by identifier node
        self.globals: dict[str, list[Node]] = {}
        self.all: list[Binding] = []
        self.program = Scope(program, None)
        self.of_node[id(program)] = self.program
        pending: list[tuple[Node, Scope]] = []
        todo: list[tuple[Node, Scope]] = [(program, self.program)]
        while todo:
            n, s = todo.pop()
            t = n.type
            if t in NAMES:
                pending.append((n, s))
                continue
            if t in ENTERED:
                s = self.enter(n, s)
            fields = BACKWARDS[t]
            if fields:
                own = n.__dict__
                for k in fields:
                    v = own[k]
                    if v.__class__ is list:
                        todo += [(x, s) for x in reversed(v) if x is not None]
                    elif v is not None:
                        todo.append((v, s))
        for n, s in pending:
            self.resolve(n, s)

    def declare(self, scope: Scope, ident: Node, kind: str, path: Node) -> None:
        b = scope.own.get(ident.name)
        if b is None:
            b = scope.own[ident.name] = Binding(ident.name, kind, scope, ident, path)
            self.all.append(b)
        elif not (kind == "param" and b.kind == "param"):
            if kind == "hoisted" or path.type != "VariableDeclarator" or path.init is not None:
                b.writes.append(path)
        self.bound[id(ident)] = b

    def enter(self, n: Node, s: Scope) -> Scope:
        t = n.type
        if t == "FunctionDeclaration" and n.id is not None:
            self.declare(s, n.id, "hoisted", n)
        elif t == "ClassDeclaration" and n.id is not None:
            self.declare(s, n.id, "let", n)
        if t in SCOPED and t != "Program" and not (t == "BlockStatement" and n.parent.type in HEADED):
            s = Scope(n, s)
            self.of_node[id(n)] = s
            if t in FUNCTIONS:
                if t == "FunctionExpression" and n.id is not None:
                    self.declare(s, n.id, "local", n)
                for p in n.params:
                    for x in pattern_names(p):
                        self.declare(s, x, "param", p)
            elif t == "ClassExpression" and n.id is not None:
                self.declare(s, n.id, "local", n)
            elif t == "CatchClause":
                for x in pattern_names(n.param):
                    self.declare(s, x, "let", n)
        elif t == "VariableDeclarator":
            kind = n.parent.kind
            target = s
            if kind == "var":
                while target.parent is not None and target.node.type not in WALLS:
                    target = target.parent
            for x in pattern_names(n.id):
                self.declare(target, x, kind, n)
        elif t in ("ImportSpecifier", "ImportDefaultSpecifier", "ImportNamespaceSpecifier"):
            self.declare(s, n.local, "module", n)
        return s

    def resolve(self, n: Node, s: Scope) -> None:
        if id(n) in self.bound:
            return
        if n.type == "JSXIdentifier":
            if n.parent.type not in ("JSXOpeningElement", "JSXMemberExpression") or (n.parent.type == "JSXMemberExpression" and n.parent.object is not n) or (n.parent.type == "JSXOpeningElement" and n.name[:1].islower()):
                return
        elif not is_reference(n):
            return
        b = s.find(n.name)
        write = written_by(n)
        if b is None:
            self.globals.setdefault(n.name, []).append(n)
            return
        self.bound[id(n)] = b
        if write is not None:
            b.writes.append(write)
            if write.type == "UpdateExpression" or (write.type == "AssignmentExpression" and write.operator != "="):
                b.refs.append(n)
        else:
            b.refs.append(n)

    # questions

    def scope_of(self, n: Node) -> Scope:
        while n is not None:
            if id(n) in self.of_node:
                return self.of_node[id(n)]
            n = n.parent
        return self.program

    def binding(self, n: Node) -> Binding | None:
        """What an identifier node is bound to."""
        return self.bound.get(id(n))

    def is_bound(self, n: Node, name: str) -> bool:
        return self.scope_of(n).find(name) is not None

    def free_name(self, wanted: str, at: Node | None = None) -> str:
        """wanted, wanted2, wanted3 ...: the first that no variable in the program has."""
        used = {b.name for b in self.all} | self.globals.keys()
        name, i = wanted, 2
        while name in used:
            name, i = f"{wanted}{i}", i + 1
        return name


def uid(scopes: Scopes, wanted: str) -> str:
    """_wanted, _wanted2 ...: a name that no variable in the program has."""
    return scopes.free_name("_" + wanted.lstrip("_"))


def written_by(n: Node) -> Node | None:
    """The node that writes to the variable of an identifier, if one does."""
    c, p = n, n.parent
    while p is not None:
        t = p.type
        if t == "AssignmentExpression":
            return p if p.left is c else None
        if t == "UpdateExpression":
            return p
        if t in ("ForInStatement", "ForOfStatement"):
            return p if p.left is c else None
        if t == "AssignmentPattern" and p.left is c or t in ("ArrayPattern", "RestElement", "ObjectPattern"):
            c, p = p, p.parent
        elif t == "ObjectProperty" and p.value is c and p.parent.type == "ObjectPattern":
            c, p = p, p.parent
        else:
            return None
    return None


def rename(scopes: Scopes, b: Binding, name: str) -> None:
    """Gives a binding another name everywhere; a variable of that name in reach is renamed away first."""
    if b.name == name:
        return
    inside = [x for x in scopes.all if x is not b and x.name == name and (x.scope is b.scope or reaches(b, x) or reaches(x, b))]
    for other in inside:
        rename(scopes, other, uid(scopes, name))
    for n in {id(x): x for x in [b.ident, *mentions(scopes, b)]}.values():
        p = n.parent
        if p is not None and p.type == "ObjectProperty" and p.shorthand and (p.value is n or (p.value.type == "AssignmentPattern" and p.value.left is n)):
            p.shorthand = False
        n.name = name
    b.scope.own.pop(b.name, None)
    b.name = name
    b.scope.own[name] = b


def mentions(scopes: Scopes, b: Binding) -> list[Node]:
    """All identifier nodes of a binding."""
    root = b.scope.node
    return [n for n in root.walk() if n.type in ("Identifier", "JSXIdentifier") and scopes.bound.get(id(n)) is b]


def reaches(a: Binding, b: Binding) -> bool:
    """Whether b is mentioned, or declared, inside the scope that a lives in."""
    s = b.scope
    while s is not None:
        if s is a.scope:
            return True
        s = s.parent
    return any(a.scope.node is x for r in b.refs for x in r.up())
