"""Syntax tree to text: two-space blocks, double quotes, only needed parentheses."""

from __future__ import annotations

import re

from scriptloom.js import numbers
from scriptloom.js.nodes import Node
from scriptloom.js.parser import BINARY
from scriptloom.js.reuse import Num

SEQUENCE, ASSIGNMENT, CONDITIONAL, UNARY, UPDATE, CALL, PRIMARY = 0, 1, 2, 15, 16, 18, 20
LEVEL = {
    "SequenceExpression": SEQUENCE, "AssignmentExpression": ASSIGNMENT, "ArrowFunctionExpression": ASSIGNMENT, "YieldExpression": ASSIGNMENT, "ConditionalExpression": CONDITIONAL,
    "UnaryExpression": UNARY, "AwaitExpression": UNARY, "UpdateExpression": UPDATE, "CallExpression": CALL, "OptionalCallExpression": CALL, "MemberExpression": CALL, "OptionalMemberExpression": CALL,
    "NewExpression": CALL, "TaggedTemplateExpression": CALL, "SpreadElement": ASSIGNMENT,
}
SHORT = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f", "\v": "\\v", "\\": "\\\\", "\0": "\\0"}


def quoted(value: str) -> str:
    """A string literal in double quotes; only what must be escaped is."""
    out = []
    for i, c in enumerate(value):
        if c == '"':
            out.append('\\"')
        elif c == "\0" and value[i + 1 : i + 2].isdigit():
            out.append("\\x00")
        elif c in SHORT:
            out.append(SHORT[c])
        elif c in "  " or 0xD800 <= ord(c) <= 0xDFFF:
            out.append(f"\\u{ord(c):04X}" if ord(c) >= 0xD800 else f"\\u{ord(c):x}")
        elif ord(c) < 32 or ord(c) == 127:
            out.append(f"\\x{ord(c):02X}")
        else:
            out.append(c)
    return '"' + "".join(out) + '"'


class Printer:
    def __init__(self, compact: bool = False, marks: bool = False):
        self.compact, self.marks = compact, marks
        self.sp, self.nl = ("", "") if compact else (" ", "\n")
        self.wrapped: set[int] = set()

    def indent(self, text: str) -> str:
        return text if self.compact else re.sub(r"(?m)^(?=.)", "  ", text) if "`" not in text else self.indent_lines(text)

    @staticmethod
    def indent_lines(text: str) -> str:
        """Indents lines, but not those that continue a template (marked while printing)."""
        return "\n".join(x if not x or x.startswith("") else "  " + x for x in text.split("\n"))

    # levels

    def level(self, n: Node) -> float:
        if n.type in ("BinaryExpression", "LogicalExpression"):
            return 3 + BINARY[n.operator]
        return LEVEL.get(n.type, PRIMARY)

    def sub(self, n: Node, least: float) -> str:
        """A child expression, in parentheses if it binds less than needed."""
        text = self.p(n)
        return f"({text})" if self.level(n) < least else text

    def p(self, n: Node) -> str:
        text = getattr(self, "n_" + n.type)(n)
        if id(n) in self.wrapped:
            text = f"({text})"
        if n.comment:
            text = f"/*{n.comment}*/{text}"
        return text

    def list(self, nodes, least: float = ASSIGNMENT) -> str:
        return f",{self.sp}".join("" if x is None else self.sub(x, least) for x in nodes)

    # statements

    def body(self, nodes: list[Node]) -> str:
        if self.compact:
            return "".join(self.p(x) for x in nodes)
        out = []
        for x in nodes:
            notes = x.__dict__.get("notes")
            if notes:
                before, behind = notes
                out.append("\n".join([*before, self.p(x)]) + "".join(" " + c for c in behind))
            else:
                out.append(self.p(x))
        return "\n".join(out)

    def braces(self, nodes: list[Node]) -> str:
        if not nodes:
            return "{}"
        return "{" + self.nl + self.indent(self.body(nodes)) + self.nl + "}"

    def n_Program(self, n):
        return self.body(n.body)

    def n_BlockStatement(self, n):
        return self.braces(n.body)

    def n_StaticBlock(self, n):
        return f"static{self.sp}" + self.braces(n.body)

    def n_EmptyStatement(self, n):
        return ";"

    def n_DebuggerStatement(self, n):
        return "debugger;"

    def guarded(self, n: Node, types: tuple[str, ...]) -> str:
        """An expression whose first token must not be that of these kinds: the leftmost one gets parentheses."""
        first = leftmost(n)
        if first.type not in types:
            return self.p(n)
        if first.type == "ObjectPattern":
            first = first.parent
        self.wrapped.add(id(first))
        text = self.p(n)
        self.wrapped.discard(id(first))
        return text

    def n_ExpressionStatement(self, n):
        text = self.guarded(n.expression, ("ObjectExpression", "FunctionExpression", "ClassExpression", "ObjectPattern"))
        return f"({text});" if re.match(r"let\s*\[", text) else text + ";"

    def clause(self, n: Node) -> str:
        """A statement behind a head."""
        if n.type == "EmptyStatement":
            return ";"
        return (self.sp if n.type == "BlockStatement" else " ") + self.p(n)

    def n_IfStatement(self, n):
        out = f"if{self.sp}({self.p(n.test)})"
        yes = n.consequent
        if n.alternate is None:
            return out + self.clause(yes)
        if dangling(yes):
            out += self.sp + "{" + self.nl + self.indent(self.p(yes)) + self.nl + "}"
        else:
            out += self.clause(yes)
        glue = self.sp if out.endswith("}") else " "
        alt = n.alternate
        return out + glue + "else" + (self.clause(alt) if alt.type == "BlockStatement" else ";" if alt.type == "EmptyStatement" else " " + self.p(alt))

    def n_WhileStatement(self, n):
        return f"while{self.sp}({self.p(n.test)})" + self.clause(n.body)

    def n_DoWhileStatement(self, n):
        return "do" + self.clause(n.body) + f"{self.sp}while{self.sp}({self.p(n.test)});"

    def n_WithStatement(self, n):
        return f"with{self.sp}({self.p(n.object)})" + self.clause(n.body)

    def n_ForStatement(self, n):
        init = "" if n.init is None else self.declaration(n.init) if n.init.type == "VariableDeclaration" else self.p(n.init)
        test = self.sp + self.p(n.test) if n.test else ""
        update = self.sp + self.p(n.update) if n.update else ""
        return f"for{self.sp}({init};{test};{update})" + self.clause(n.body)

    def each(self, n, word, head="for"):
        left = self.declaration(n.left) if n.left.type == "VariableDeclaration" else self.p(n.left)
        return f"{head}{self.sp}({left} {word} {self.sub(n.right, ASSIGNMENT) if word == 'of' else self.p(n.right)})" + self.clause(n.body)

    def n_ForInStatement(self, n):
        return self.each(n, "in")

    def n_ForOfStatement(self, n):
        return self.each(n, "of", "for await" if n.wait else "for")

    def n_ReturnStatement(self, n):
        return f"return {self.p(n.argument)};" if n.argument else "return;"

    def n_ThrowStatement(self, n):
        return f"throw {self.p(n.argument)};"

    def n_BreakStatement(self, n):
        return f"break {n.label.name};" if n.label else "break;"

    def n_ContinueStatement(self, n):
        return f"continue {n.label.name};" if n.label else "continue;"

    def n_LabeledStatement(self, n):
        return f"{n.label.name}:{self.sp}{self.p(n.body)}"

    def n_SwitchStatement(self, n):
        head = f"switch{self.sp}({self.p(n.discriminant)}){self.sp}" + "{"
        return head + (self.nl + self.indent(self.body(n.cases)) + self.nl + "}" if n.cases else "}")

    def n_SwitchCase(self, n):
        head = f"case {self.p(n.test)}:" if n.test else "default:"
        return head + (self.nl + self.indent(self.body(n.consequent)) if n.consequent else "")

    def n_TryStatement(self, n):
        out = f"try{self.sp}{self.p(n.block)}"
        if n.handler:
            out += self.sp + self.p(n.handler)
        return out + (f"{self.sp}finally{self.sp}{self.p(n.finalizer)}" if n.finalizer else "")

    def n_CatchClause(self, n):
        return f"catch{self.sp}({self.p(n.param)}){self.sp}{self.p(n.body)}" if n.param else f"catch{self.sp}{self.p(n.body)}"

    def declaration(self, n) -> str:
        parts = [self.p(x) for x in n.declarations]
        if not self.compact and len(parts) > 1 and n.parent is not None and n.parent.type not in ("ForStatement", "ForInStatement", "ForOfStatement") and any(x.init for x in n.declarations):
            return f"{n.kind} " + ",\n  ".join(parts)
        return f"{n.kind} " + f",{self.sp}".join(parts)

    def n_VariableDeclaration(self, n):
        return self.declaration(n) + ";"

    def n_VariableDeclarator(self, n):
        return self.p(n.id) + (f"{self.sp}={self.sp}{self.sub(n.init, ASSIGNMENT)}" if n.init else "")

    # functions and classes

    def params(self, n) -> str:
        return f"({self.list(n.params)})"

    def n_FunctionDeclaration(self, n):
        name = f" {n.id.name}" if n.id else self.sp
        return ("async " if n.is_async else "") + "function" + ("*" if n.generator else "") + name + self.params(n) + self.sp + self.p(n.body)

    n_FunctionExpression = n_FunctionDeclaration

    def n_ArrowFunctionExpression(self, n):
        one = len(n.params) == 1 and n.params[0].type == "Identifier"
        head = ("async " if n.is_async else "") + (n.params[0].name if one else self.params(n)) + f"{self.sp}=>{self.sp}"
        if n.body.type == "BlockStatement":
            return head + self.p(n.body)
        if self.level(n.body) < ASSIGNMENT:
            return f"{head}({self.p(n.body)})"
        return head + self.guarded(n.body, ("ObjectExpression", "ObjectPattern"))

    def n_UnreadStatement(self, n):
        return n.text

    def n_Decorator(self, n):
        e = n.expression
        plain = e.callee if e.type == "CallExpression" else e
        while plain.type == "MemberExpression" and not plain.computed:
            plain = plain.object
        return "@" + (self.p(e) if plain.type == "Identifier" else f"({self.p(e)})")

    def decorated(self, n) -> str:
        return "".join(self.p(d) + (self.nl or " ") for d in n.decorators or ())

    def n_ClassDeclaration(self, n):
        out = self.decorated(n) + "class" + (f" {n.id.name}" if n.id else "") + (f" extends {self.sub(n.superClass, CALL)}" if n.superClass else "")
        return out + self.sp + self.braces(n.body.body)

    n_ClassExpression = n_ClassDeclaration

    def key(self, n) -> str:
        return f"[{self.sub(n.key, ASSIGNMENT)}]" if n.computed else self.p(n.key)

    def n_ClassMethod(self, n):
        kind = f"{n.kind} " if n.kind in ("get", "set") else ""
        return self.decorated(n) + ("static " if n.static else "") + ("async " if n.is_async else "") + kind + ("*" if n.generator else "") + self.key(n) + self.params(n) + self.sp + self.p(n.body)

    def n_ObjectMethod(self, n):
        kind = f"{n.kind} " if n.kind in ("get", "set") else ""
        return ("async " if n.is_async else "") + kind + ("*" if n.generator else "") + self.key(n) + self.params(n) + self.sp + self.p(n.body)

    def n_ClassProperty(self, n):
        return self.decorated(n) + ("static " if n.static else "") + self.key(n) + (f"{self.sp}={self.sp}{self.sub(n.value, ASSIGNMENT)}" if n.value else "") + ";"

    def n_PrivateName(self, n):
        return "#" + n.name

    # expressions

    def n_Identifier(self, n):
        return n.name

    n_JSXIdentifier = n_Identifier

    def n_StringLiteral(self, n):
        return quoted(n.value)

    def n_NumericLiteral(self, n):
        return n.value.mark() if self.marks and type(n.value) is Num else numbers.to_text(n.value)

    def n_BigIntLiteral(self, n):
        return n.value + "n"

    def n_BooleanLiteral(self, n):
        return "true" if n.value else "false"

    def n_NullLiteral(self, n):
        return "null"

    def n_ThisExpression(self, n):
        return "this"

    def n_Super(self, n):
        return "super"

    def n_Import(self, n):
        return "import"

    def n_MetaProperty(self, n):
        return f"{n.meta.name}.{n.property.name}"

    def n_RegExpLiteral(self, n):
        return f"/{n.pattern}/{n.flags}"

    def n_TemplateLiteral(self, n):
        out = "`"
        for i, q in enumerate(n.quasis):
            out += q.raw.replace("\n", "\n")
            if i < len(n.expressions):
                out += "${" + self.p(n.expressions[i]) + "}"
        return out + "`"

    def n_TaggedTemplateExpression(self, n):
        return self.sub(n.tag, CALL) + self.p(n.quasi)

    def n_ArrayExpression(self, n):
        out, last = "[", len(n.elements) - 1
        for i, x in enumerate(n.elements):
            out += "," if x is None else self.sp * bool(i) + self.sub(x, ASSIGNMENT) + "," * (i < last)
        return out + "]"

    n_ArrayPattern = n_ArrayExpression

    def n_ObjectExpression(self, n):
        if not n.properties:
            return "{}"
        return "{" + self.nl + self.indent(f",{self.nl}".join(self.p(x) for x in n.properties)) + self.nl + "}"

    n_ObjectPattern = n_ObjectExpression

    def n_ObjectProperty(self, n):
        v = n.value
        if not n.computed and n.key.type == "Identifier":
            if v.type == "Identifier" and v.name == n.key.name and n.shorthand:
                return n.key.name
            if v.type == "AssignmentPattern" and n.shorthand and v.left.type == "Identifier" and v.left.name == n.key.name:
                return self.p(v)
        return f"{self.key(n)}:{self.sp}{self.sub(v, ASSIGNMENT)}"

    def n_SpreadElement(self, n):
        return "..." + self.sub(n.argument, ASSIGNMENT)

    n_RestElement = n_SpreadElement

    def n_AssignmentPattern(self, n):
        return f"{self.p(n.left)}{self.sp}={self.sp}{self.sub(n.right, ASSIGNMENT)}"

    def n_UnaryExpression(self, n):
        text, op = self.sub(n.argument, UNARY), n.operator
        if op.isalpha():
            return f"{op}{'' if text.startswith('(') and self.compact else ' '}{text}"
        gap = " " if text[:1] == op and op in "+-" else ""
        return op + gap + text

    def n_UpdateExpression(self, n):
        return n.operator + self.sub(n.argument, UNARY) if n.prefix else self.sub(n.argument, CALL) + n.operator

    def n_BinaryExpression(self, n):
        me = self.level(n)
        left = self.sub(n.left, UPDATE if n.operator == "**" else me)
        right = self.sub(n.right, me if n.operator == "**" else me + 1)
        op = n.operator
        if n.type == "LogicalExpression":
            for side, child in (("l", n.left), ("r", n.right)):
                if child.type == "LogicalExpression" and (child.operator == "??") != (op == "??"):
                    wrapped = f"({self.p(child)})"
                    left, right = (wrapped, right) if side == "l" else (left, wrapped)
        if op.isalpha():
            return f"{left} {op} {right}"
        if self.compact:
            gap = " " if op in "+-" and right[:1] == op else ""
            return f"{left}{' ' if left.endswith(op[0]) and op in '+-' else ''}{op}{gap}{right}"
        return f"{left} {op} {right}"

    n_LogicalExpression = n_BinaryExpression

    def n_AssignmentExpression(self, n):
        out = f"{self.sub(n.left, CALL)}{self.sp}{n.operator}{self.sp}{self.sub(n.right, ASSIGNMENT)}"
        return out

    def n_ConditionalExpression(self, n):
        return f"{self.sub(n.test, CONDITIONAL + 1)}{self.sp}?{self.sp}{self.sub(n.consequent, ASSIGNMENT)}{self.sp}:{self.sp}{self.sub(n.alternate, ASSIGNMENT)}"

    def n_SequenceExpression(self, n):
        return self.list(n.expressions)

    def n_YieldExpression(self, n):
        return "yield" + ("*" if n.delegate else "") + (f" {self.sub(n.argument, ASSIGNMENT)}" if n.argument else "")

    def n_AwaitExpression(self, n):
        return f"await {self.sub(n.argument, UNARY)}"

    def n_CallExpression(self, n):
        callee = n.callee
        text = self.sub(callee, CALL)
        if callee.type in ("OptionalMemberExpression", "OptionalCallExpression"):
            text = f"({text})"
        return f"{text}({self.list(n.arguments)})"

    def n_OptionalCallExpression(self, n):
        return f"{self.sub(n.callee, CALL)}{'?.' if n.optional else ''}({self.list(n.arguments)})"

    def n_NewExpression(self, n):
        text = self.sub(n.callee, CALL)
        if any(x.type in ("CallExpression", "OptionalCallExpression", "Import") for x in chain(n.callee)):
            text = f"({text})"
        return f"new {text}({self.list(n.arguments)})"

    def n_MemberExpression(self, n):
        o = n.object
        text = self.sub(o, CALL)
        if o.type in ("OptionalMemberExpression", "OptionalCallExpression") and n.type == "MemberExpression":
            text = f"({text})"
        mark = "?." if getattr(n, "optional", False) else ""
        if n.computed:
            return f"{text}{mark}[{self.p(n.property)}]"
        if o.type == "NumericLiteral" and re.fullmatch(r"\d+", text):
            text += "."
        return f"{text}{mark or '.'}{self.p(n.property)}"

    n_OptionalMemberExpression = n_MemberExpression

    # modules

    def source(self, n) -> str:
        return f" from{self.sp or ' '}{self.p(n.source)}{self.attributes(n)}" if n.source else ""

    def attributes(self, n) -> str:
        if not n.attributes:
            return ""
        return " with {" + self.sp + f",{self.sp}".join(f"{self.p(a.key)}:{self.sp}{self.p(a.value)}" for a in n.attributes) + self.sp + "}"

    def n_ImportDeclaration(self, n):
        if not n.specifiers:
            return f"import {self.p(n.source)}{self.attributes(n)};"
        head = [self.p(x) for x in n.specifiers if x.type != "ImportSpecifier"]
        named = [self.p(x) for x in n.specifiers if x.type == "ImportSpecifier"]
        if named:
            head.append("{" + self.sp + f",{self.sp}".join(named) + self.sp + "}")
        return "import " + f",{self.sp}".join(head) + self.source(n) + ";"

    def n_ImportSpecifier(self, n):
        return self.p(n.imported) + ("" if n.imported.type == "Identifier" and n.imported.name == n.local.name else f" as {n.local.name}")

    def n_ImportDefaultSpecifier(self, n):
        return n.local.name

    def n_ImportNamespaceSpecifier(self, n):
        return f"* as {n.local.name}"

    def n_ExportNamedDeclaration(self, n):
        if n.declaration:
            return "export " + self.p(n.declaration)
        inner = f",{self.sp}".join(self.p(x) for x in n.specifiers)
        return "export {" + (self.sp + inner + self.sp if inner else "") + "}" + self.source(n) + ";"

    def n_ExportSpecifier(self, n):
        a, b = self.p(n.local), self.p(n.exported)
        return a if a == b else f"{a} as {b}"

    def n_ExportDefaultDeclaration(self, n):
        d = n.declaration
        return "export default " + (self.p(d) if d.type.endswith("Declaration") else self.guarded(d, ("FunctionExpression", "ClassExpression")) + ";")

    def n_ExportAllDeclaration(self, n):
        return "export *" + (f" as {self.p(n.exported)}" if n.exported else "") + self.source(n) + ";"

    # JSX

    def n_JSXElement(self, n):
        o = n.openingElement
        head = "<" + self.p(o.name) + "".join(" " + self.p(x) for x in o.attributes)
        if o.selfClosing:
            return head + " />"
        return head + ">" + self.inner(n.children) + f"</{self.p(o.name)}>"

    def inner(self, children: list[Node]) -> str:
        return "".join(self.p(x) for x in children)

    def n_JSXFragment(self, n):
        return "<>" + self.inner(n.children) + "</>"

    def n_JSXText(self, n):
        return n.value

    def n_JSXExpressionContainer(self, n):
        return "{" + self.p(n.expression) + "}"

    def n_JSXEmptyExpression(self, n):
        return ""

    def n_JSXSpreadChild(self, n):
        return "{..." + self.p(n.expression) + "}"

    def n_JSXAttribute(self, n):
        if n.value is None:
            return self.p(n.name)
        value = '"' + n.value.value.replace('"', "&quot;") + '"' if n.value.type == "StringLiteral" else self.p(n.value)
        return f"{self.p(n.name)}={value}"

    def n_JSXSpreadAttribute(self, n):
        return "{..." + self.p(n.argument) + "}"

    def n_JSXMemberExpression(self, n):
        return f"{self.p(n.object)}.{self.p(n.property)}"

    def n_JSXNamespacedName(self, n):
        return f"{self.p(n.namespace)}:{self.p(n.name)}"


LEFT = {"CallExpression": "callee", "OptionalCallExpression": "callee", "MemberExpression": "object", "OptionalMemberExpression": "object", "TaggedTemplateExpression": "tag", "BinaryExpression": "left", "LogicalExpression": "left", "AssignmentExpression": "left", "ConditionalExpression": "test"}


def leftmost(n: Node) -> Node:
    """The node whose text begins an expression's text, parentheses aside."""
    printer = Printer()
    while True:
        if n.type == "SequenceExpression":
            n = n.expressions[0]
        elif n.type == "UpdateExpression" and not n.prefix:
            n = n.argument
        elif n.type in LEFT:
            inner = n.__dict__[LEFT[n.type]]
            least = CALL if LEFT[n.type] in ("callee", "object", "tag") or n.type == "AssignmentExpression" else printer.level(n)
            if printer.level(inner) < least:
                return n  # it gets parentheses
            n = inner
        else:
            return n


def chain(n: Node):
    """An expression and what its members hang on."""
    while n is not None:
        yield n
        n = n.object if n.type in ("MemberExpression", "OptionalMemberExpression") else n.callee if n.type in ("CallExpression", "OptionalCallExpression") else n.tag if n.type == "TaggedTemplateExpression" else None


def dangling(n: Node) -> bool:
    """Whether an `else` behind this statement would go to an `if` at its end."""
    while n is not None:
        if n.type == "IfStatement":
            if n.alternate is None:
                return True
            n = n.alternate
        elif n.type in ("WhileStatement", "ForStatement", "ForInStatement", "ForOfStatement", "LabeledStatement", "WithStatement"):
            n = n.body
        else:
            return False
    return False


def to_code(n: Node, compact: bool = False, marks: bool = False) -> str:
    """The text of a tree; compact leaves out all space that is not needed.

    With marks, which is for texts that no rule reads, unknown numbers stay unknown.
    """
    return Printer(compact, marks).p(n).replace("", "")


def preview(n: Node) -> str:
    """Compact text, its middle left out beyond 100 characters."""
    text = to_code(n, compact=True)
    return text if len(text) <= 100 else f"{text[:70]} … {text[-30:]}"
