"""Syntax tree nodes: plain objects that know their parent.

Node names and fields follow the common ESTree dialect for JavaScript tools.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

# Trees are deep where programs are.  Calls from Python to Python take no C stack, only memory: a few hundred bytes each.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))

# The child fields of each node type, in source order.
FIELDS = {
    "Program": ("body",), "ExpressionStatement": ("expression",), "BlockStatement": ("body",), "StaticBlock": ("body",), "EmptyStatement": (), "DebuggerStatement": (),
    "WithStatement": ("object", "body"), "ReturnStatement": ("argument",), "LabeledStatement": ("label", "body"), "BreakStatement": ("label",), "ContinueStatement": ("label",),
    "IfStatement": ("test", "consequent", "alternate"), "SwitchStatement": ("discriminant", "cases"), "SwitchCase": ("test", "consequent"), "ThrowStatement": ("argument",),
    "TryStatement": ("block", "handler", "finalizer"), "CatchClause": ("param", "body"), "WhileStatement": ("test", "body"), "DoWhileStatement": ("body", "test"),
    "ForStatement": ("init", "test", "update", "body"), "ForInStatement": ("left", "right", "body"), "ForOfStatement": ("left", "right", "body"),
    "VariableDeclaration": ("declarations",), "VariableDeclarator": ("id", "init"), "FunctionDeclaration": ("id", "params", "body"), "FunctionExpression": ("id", "params", "body"),
    "ArrowFunctionExpression": ("params", "body"), "ClassDeclaration": ("decorators", "id", "superClass", "body"), "ClassExpression": ("decorators", "id", "superClass", "body"), "ClassBody": ("body",),
    "ClassMethod": ("decorators", "key", "params", "body"), "ClassProperty": ("decorators", "key", "value"), "Decorator": ("expression",), "ImportAttribute": ("key", "value"), "UnreadStatement": (), "PrivateName": (), "ObjectExpression": ("properties",), "ObjectProperty": ("key", "value"),
    "ObjectMethod": ("key", "params", "body"), "SpreadElement": ("argument",), "ArrayExpression": ("elements",), "UnaryExpression": ("argument",), "UpdateExpression": ("argument",),
    "BinaryExpression": ("left", "right"), "LogicalExpression": ("left", "right"), "AssignmentExpression": ("left", "right"), "ConditionalExpression": ("test", "consequent", "alternate"),
    "CallExpression": ("callee", "arguments"), "OptionalCallExpression": ("callee", "arguments"), "NewExpression": ("callee", "arguments"), "MemberExpression": ("object", "property"),
    "OptionalMemberExpression": ("object", "property"), "SequenceExpression": ("expressions",), "YieldExpression": ("argument",), "AwaitExpression": ("argument",), "ThisExpression": (),
    "Super": (), "Import": (), "MetaProperty": ("meta", "property"), "Identifier": (), "StringLiteral": (), "NumericLiteral": (), "BooleanLiteral": (), "NullLiteral": (), "BigIntLiteral": (),
    "RegExpLiteral": (), "TemplateLiteral": ("quasis", "expressions"), "TemplateElement": (), "TaggedTemplateExpression": ("tag", "quasi"), "ArrayPattern": ("elements",),
    "ObjectPattern": ("properties",), "AssignmentPattern": ("left", "right"), "RestElement": ("argument",), "ImportDeclaration": ("specifiers", "source", "attributes"), "ImportSpecifier": ("imported", "local"),
    "ImportDefaultSpecifier": ("local",), "ImportNamespaceSpecifier": ("local",), "ExportNamedDeclaration": ("declaration", "specifiers", "source", "attributes"), "ExportSpecifier": ("local", "exported"),
    "ExportDefaultDeclaration": ("declaration",), "ExportAllDeclaration": ("exported", "source", "attributes"), "JSXElement": ("openingElement", "children", "closingElement"),
    "JSXOpeningElement": ("name", "attributes"), "JSXClosingElement": ("name",), "JSXFragment": ("children",), "JSXText": (), "JSXExpressionContainer": ("expression",), "JSXEmptyExpression": (),
    "JSXSpreadChild": ("expression",), "JSXAttribute": ("name", "value"), "JSXSpreadAttribute": ("argument",), "JSXIdentifier": (), "JSXMemberExpression": ("object", "property"), "JSXNamespacedName": ("namespace", "name"),
}

BACKWARDS = {t: fields[::-1] for t, fields in FIELDS.items()}

FUNCTIONS = {"FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression", "ObjectMethod", "ClassMethod"}
LOOPS = {"ForStatement", "ForInStatement", "ForOfStatement", "WhileStatement", "DoWhileStatement"}


class Node:
    """A tree node; every child's `parent` is this node."""

    def __init__(self, type_: str, **fields):
        self.type, self.parent, self.start, self.end, self.comment = type_, None, None, None, None
        self.__dict__.update(fields)
        for k in FIELDS[type_]:
            v = fields.get(k)
            if k not in fields:
                self.__dict__[k] = None
            elif isinstance(v, Node):
                v.parent = self
            elif isinstance(v, list):
                for x in v:
                    if x is not None:
                        x.parent = self

    def __repr__(self) -> str:
        from scriptloom.js.printer import to_code

        return f"<{self.type} {to_code(self, compact=True)[:60]}>"

    def set(self, key: str, value) -> None:
        """Puts a child, or a list of them, in a field."""
        self.__dict__[key] = value
        for x in value if isinstance(value, list) else [value]:
            if isinstance(x, Node):
                x.parent = self

    def kids(self) -> list[Node]:
        """The children, in source order."""
        fields = FIELDS[self.type]
        if not fields:
            return []
        own, out = self.__dict__, []
        for k in fields:
            v = own[k]
            if v.__class__ is list:
                out += [x for x in v if x is not None]
            elif v is not None:
                out.append(v)
        return out

    def walk(self) -> Iterator[Node]:
        """This node and all below, parents first; safe for deep trees."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            fields = BACKWARDS[n.type]
            if fields:
                own = n.__dict__
                for k in fields:
                    v = own[k]
                    if v.__class__ is list:
                        todo += [x for x in reversed(v) if x is not None]
                    elif v is not None:
                        todo.append(v)

    def place(self) -> tuple[str, int | None]:
        """The parent's field that holds this node, and the index in it."""
        for k in FIELDS[self.parent.type]:
            v = self.parent.__dict__[k]
            if v is self:
                return k, None
            if isinstance(v, list):
                for i, x in enumerate(v):
                    if x is self:
                        return k, i
        raise ValueError(f"{self.type} is not a child of its parent")

    def key(self) -> str:
        return self.place()[0]

    def replace(self, *new: Node) -> None:
        """Puts other nodes in this node's place; several where the place is in a list."""
        parent = self.parent
        k, i = self.place()
        if i is None:
            if len(new) != 1:
                if not new or parent.type not in {"IfStatement", "LabeledStatement", "WithStatement"} | LOOPS:
                    raise ValueError("one node is needed here")
                new = (Node("BlockStatement", body=list(new)),)
            parent.set(k, new[0])
        else:
            parent.__dict__[k][i : i + 1] = new
            for x in new:
                x.parent = parent

    def remove(self) -> None:
        """Takes this node out of its list, or empties its field."""
        parent = self.parent
        if parent.type == "VariableDeclaration" and len(parent.declarations) == 1:
            return parent.remove()
        if parent.type == "ExpressionStatement":
            return parent.remove()
        k, i = self.place()
        if i is not None:
            siblings = parent.__dict__[k]
            del siblings[i]
            notes = self.__dict__.get("notes")
            if notes and notes[0] and i < len(siblings):  # comments before it stay
                before, behind = siblings[i].__dict__.get("notes") or ([], [])
                siblings[i].notes = (notes[0] + before, behind)
        elif k in ("body", "consequent"):
            parent.set(k, Node("BlockStatement", body=[]))
        else:
            parent.__dict__[k] = None
        return None

    def up(self) -> Iterator[Node]:
        """The ancestors, nearest first."""
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def find_up(self, test) -> Node | None:
        return next((n for n in self.up() if test(n)), None)

    def copy(self) -> Node:
        out = Node.__new__(Node)
        for k, v in self.__dict__.items():
            if k == "parent":
                out.parent = None
            elif isinstance(v, Node):
                out.__dict__[k] = c = v.copy() if k in FIELDS[self.type] else v
                if k in FIELDS[self.type]:
                    c.parent = out
            elif isinstance(v, list) and k in FIELDS[self.type]:
                out.__dict__[k] = [x and x.copy() for x in v]
                for x in out.__dict__[k]:
                    if x is not None:
                        x.parent = out
            else:
                out.__dict__[k] = v
        return out


def same(a, b) -> bool:
    """Whether two subtrees are the same program text."""
    if a is None or b is None:
        return a is b
    if isinstance(a, list):
        return isinstance(b, list) and len(a) == len(b) and all(map(same, a, b))
    if not isinstance(a, Node):
        return a == b
    if not isinstance(b, Node) or a.type != b.type:
        return False
    skip = {"parent", "start", "end", "comment", "raw", "parens", "directive", "notes", "worth"}
    keys = {k for k in a.__dict__ if k not in skip} | {k for k in b.__dict__ if k not in skip}
    return all(same(a.__dict__.get(k), b.__dict__.get(k)) for k in keys)


def ident(name: str) -> Node:
    return Node("Identifier", name=name)


def string(value: str) -> Node:
    return Node("StringLiteral", value=value)


def number(value) -> Node:
    """A numeric literal; a negative value is a minus before one."""
    if value < 0 or (value == 0 and str(value).startswith("-")):
        return Node("UnaryExpression", operator="-", argument=Node("NumericLiteral", value=-value))
    return Node("NumericLiteral", value=value)


def boolean(value: bool) -> Node:
    return Node("BooleanLiteral", value=value)


def expr(e: Node) -> Node:
    return Node("ExpressionStatement", expression=e)


def block(*body: Node) -> Node:
    return Node("BlockStatement", body=list(body))


def member(o: Node, name: str) -> Node:
    return Node("MemberExpression", object=o, property=ident(name), computed=False)


def call(f: Node, *args: Node) -> Node:
    return Node("CallExpression", callee=f, arguments=list(args))


def undefined() -> Node:
    return Node("UnaryExpression", operator="void", argument=Node("NumericLiteral", value=0))
