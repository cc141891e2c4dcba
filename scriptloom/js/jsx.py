"""Element calls of React, both runtimes, back to JSX."""

from __future__ import annotations

import re

from scriptloom.js.ask import is_, is_ident, is_member, is_number, is_string, is_true
from scriptloom.js.engine import Rule
from scriptloom.js.nodes import Node, ident
from scriptloom.js.scope import rename

# Functions of the automatic runtime.
PRAGMAS = {"jsx", "jsxs", "_jsx", "_jsxs", "jsxDEV", "jsxsDEV"}


class NotJsx(ValueError):
    """A call with parts that JSX cannot say."""


def element_name(n: Node) -> Node | None:
    """A tag from a string, a variable or members of one."""
    if is_string(n):
        return Node("JSXIdentifier", name=n.value) if re.fullmatch(r"[\w$.:-]+", n.value) else None
    if n.type == "Identifier":
        return Node("JSXIdentifier", name=n.name)
    if n.type == "MemberExpression" and not n.computed and n.property.type == "Identifier":
        o = element_name(n.object) if not is_string(n.object) else None
        return o and Node("JSXMemberExpression", object=o, property=Node("JSXIdentifier", name=n.property.name))
    return None


def attribute_value(v: Node) -> Node | None:
    if is_true(v) and v.type == "BooleanLiteral":
        return Node("JSXExpressionContainer", expression=v)
    if is_string(v) and not re.search(r'["\\\n\r\t\x00-\x1f  ]', v.value):
        return v
    if v.type == "JSXElement":
        return Node("JSXExpressionContainer", expression=v)
    return Node("JSXExpressionContainer", expression=v)


def attributes(o: Node | None, skip_children: bool = False) -> list[Node]:
    if o is None or is_(o, "NullLiteral"):
        return []
    out = []
    for p in o.properties:
        if p.type == "SpreadElement":
            out.append(Node("JSXSpreadAttribute", argument=p.argument))
        elif p.type == "ObjectProperty" and not p.computed and p.key.type in ("Identifier", "StringLiteral"):
            name = p.key.name if p.key.type == "Identifier" else p.key.value
            if skip_children and name == "children":
                continue
            key = Node("JSXIdentifier", name=name)
            if ":" in name:
                a, b = name.split(":", 1)
                key = Node("JSXNamespacedName", namespace=Node("JSXIdentifier", name=a), name=Node("JSXIdentifier", name=b))
            out.append(Node("JSXAttribute", name=key, value=attribute_value(p.value)))
        else:
            raise NotJsx(p.type)
    return out


def child(n: Node) -> Node:
    if n.type in ("JSXElement", "JSXFragment"):
        return n
    if n.type == "SpreadElement":
        return Node("JSXSpreadChild", expression=n.argument)
    if is_string(n):
        if re.search(r"[{}<>\r\n]", n.value) or not n.value:
            return Node("JSXExpressionContainer", expression=n)
        return Node("JSXText", value=n.value)
    return Node("JSXExpressionContainer", expression=n)


def element(name: Node, attrs: list[Node], children: list[Node]) -> Node:
    opening = Node("JSXOpeningElement", name=name, attributes=attrs, selfClosing=not children)
    return Node("JSXElement", openingElement=opening, children=children, closingElement=None if not children else Node("JSXClosingElement", name=name.copy()))


def is_fragment(n: Node) -> bool:
    return is_member(n, "React", "Fragment")


def component(n: Node, type_: Node, ctx) -> Node | None:
    """The tag, a variable in lower case renamed to look like a component."""
    if type_.type == "Identifier" and re.match(r"[a-z]", type_.name):
        b = ctx.scopes.binding(type_)
        if b is None:
            return None
        rename(ctx.scopes, b, free_component(ctx, "_Component" if n == "new" else "Component"))
    return element_name(type_)


def free_component(ctx, wanted: str) -> str:
    return ctx.scopes.free_name(wanted)


def properties_only(o: Node | None) -> bool:
    return o is None or is_(o, "NullLiteral") or o.type == "ObjectExpression"


def classic(n, ctx):
    """React.createElement(type, props, ...children)."""
    if not is_member(n.callee, "React", "createElement") or not n.arguments or any(a.type == "SpreadElement" for a in n.arguments[:2]):
        return None
    type_, props, children = n.arguments[0], n.arguments[1] if len(n.arguments) > 1 else None, n.arguments[2:]
    try:
        if props is not None and props.type != "ObjectExpression" and not is_(props, "NullLiteral"):
            attrs = [Node("JSXSpreadAttribute", argument=props)]
        else:
            attrs = attributes(props)
    except NotJsx:
        return None
    kids = [child(c) for c in children]
    if is_fragment(type_) and not attrs:
        return Node("JSXFragment", children=kids)
    name = component("classic", type_, ctx)
    return name and element(name, attrs, kids)


def automatic(n, ctx):
    """jsx(type, {...props, children}, key)."""
    c = n.callee
    if c.type == "SequenceExpression" and len(c.expressions) == 2 and is_number(c.expressions[0], 0):
        c = c.expressions[1]
    if not ((is_ident(c) and c.name in PRAGMAS) or (c.type == "MemberExpression" and not c.computed and c.property.type == "Identifier" and c.property.name in PRAGMAS)):
        return None
    if len(n.arguments) < 2 or n.arguments[1].type != "ObjectExpression":
        return None
    type_, props, key = n.arguments[0], n.arguments[1], n.arguments[2] if len(n.arguments) > 2 else None
    if is_(key, "UnaryExpression", operator="void") or is_ident(key, "undefined"):
        key = None
    try:
        attrs = attributes(props, skip_children=True)
    except NotJsx:
        return None
    kids: list[Node] = []
    for p in props.properties:
        if p.type == "ObjectProperty" and not p.computed and getattr(p.key, "name", getattr(p.key, "value", None)) == "children":
            many = (c.name if is_ident(c) else c.property.name) in ("jsxs", "_jsxs", "jsxsDEV") or (p.value.type == "ArrayExpression" and any(e is not None and e.type in ("JSXElement", "JSXFragment") for e in p.value.elements))
            kids = [child(x) for x in p.value.elements if x is not None] if many and p.value.type == "ArrayExpression" else [child(p.value)]
    if key is not None:
        attrs.insert(0, Node("JSXAttribute", name=Node("JSXIdentifier", name="key"), value=attribute_value(key)))
    if is_fragment(type_) and not attrs:
        return Node("JSXFragment", children=kids)
    name = component("new", type_, ctx)
    if name is None and not is_string(type_) and type_.type != "Identifier":
        s = n.find_up(lambda x: x.parent is not None and x.parent.type in ("Program", "BlockStatement") and x.type != "BlockStatement")
        if s is None:
            return None
        variable = ctx.scopes.free_name("Component")
        k, i = s.place()
        d = Node("VariableDeclaration", kind="const", declarations=[Node("VariableDeclarator", id=ident(variable), init=type_)])
        d.parent = s.parent
        s.parent.__dict__[k].insert(i, d)
        name = Node("JSXIdentifier", name=variable)
    return name and element(name, attrs, kids)


JSX = Rule("jsx", {"CallExpression": classic}, scope=True)
JSX_NEW = Rule("jsx-new", {"CallExpression": automatic}, scope=True)
RULES = [JSX, JSX_NEW]
BY_NAME = {r.name: r for r in RULES}
