"""JavaScript to syntax tree: a scanner driven by the parser, and precedence climbing.

Parsed as a script or a module alike; `return` is allowed anywhere; JSX is on
unless switched off.  Parentheses leave no node.  With recovery, a statement
that cannot be read stays as its text, and reading goes on behind it.
"""

from __future__ import annotations

import html
import re

from scriptloom.js.nodes import Node
from scriptloom.js.reuse import planted


class JsSyntaxError(ValueError):
    """The text is not a program that this parser reads."""


SPACE = re.compile(r"(?:[ \t\v\f\xa0 ﻿\u1680\u2000-\u200a\u202f\u205f\u3000]+|//[^\n\r\u2028\u2029]*|<!--[^\n\r]*|/\*[\s\S]*?\*/|(?:\r\n|[\n\r\u2028\u2029]))*")
COMMENT = re.compile(r"//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/")
TRAILING = re.compile(r"[ \t]*(?:/\*[^\n\r]*?\*/[ \t]*)*(?://[^\n\r\u2028\u2029]*|/\*[^\n\r]*?\*/)")
NEWLINE = re.compile(r"[\n\r\u2028\u2029]")
NAME = re.compile(r"(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|[$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|0[0-7]+(?![\d.eE])|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")
STRING = re.compile(r"\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'")
REGEX = re.compile(r"/((?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+)/([a-zA-Z]*)")
PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.#@]")
STOP = re.compile(r"[;}\n\r\u2028\u2029]")
ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\n\r\u2028\u2029])|([0-3]?[0-7]{1,2})|([\s\S]))")
SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}

KEYWORDS = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}


def unescape(raw: str) -> str:
    """The value of a string's inside; lone halves of surrogate pairs stay as they are."""
    if "\\" not in raw:
        return raw

    def one(m: re.Match) -> str:
        if m[1] or m[2] or m[3]:
            return chr(int(m[1] or m[2] or m[3], 16))
        if m[4]:
            return ""
        if m[5]:
            return chr(int(m[5], 8))
        return SIMPLE.get(m[6], m[6])

    out = ESCAPE.sub(one, raw)
    return re.sub(r"[\ud800-\udbff][\udc00-\udfff]", lambda m: chr(0x10000 + ((ord(m[0][0]) & 0x3FF) << 10) + (ord(m[0][1]) & 0x3FF)), out)


class Parser:
    def __init__(self, text: str, jsx: bool = True, recover: bool = False):
        self.recover, self.errors = recover, []
        self.s, self.jsx, self.pos, self.no_in, self.gap = text, jsx, 0, False, 0
        if text.startswith("#!"):
            self.pos = NEWLINE.search(text + "\n").start()
        try:
            self.advance()
        except JsSyntaxError:  # the first token; the first statement meets it again
            if not recover:
                raise

    # scanning

    def fail(self, what: str | None = None):
        line = self.s.count("\n", 0, self.start) + 1
        raise JsSyntaxError(f"{what or 'unexpected ' + (repr(self.value) if self.kind != 'end' else 'end')} (line {line})")

    def advance(self) -> None:
        """The next token: kind (name, num, str, punct, template, private, end), value."""
        self.last_end = self.pos
        m = SPACE.match(self.s, self.pos)
        self.newline = self.pos == 0 or bool(NEWLINE.search(self.s, self.pos, m.end()))
        self.start = p = m.end()
        if p >= len(self.s):
            self.kind, self.value, self.pos = "end", "", p
            return
        c = self.s[p]
        if c in "\"'":
            m = STRING.match(self.s, p)
            if not m:
                self.kind, self.value = "end", ""
                self.fail("unterminated string")
            self.kind, self.value, self.pos = "str", m[0], m.end()
        elif c.isdigit() or (c == "." and self.s[p + 1 : p + 2].isdigit()):
            m = NUMBER.match(self.s, p)
            self.kind, self.value, self.pos = "num", m[0], m.end()
        elif c == "`":
            self.kind, self.value, self.pos = "template", "`", p + 1
        elif m := NAME.match(self.s, p):
            self.kind, self.value, self.pos = "name", unescape(m[0]) if "\\" in m[0] else m[0], m.end()
            self.escaped = "\\" in m[0]
        elif c == "#" and (m := NAME.match(self.s, p + 1)):
            self.kind, self.value, self.pos = "private", m[0], m.end()
        elif m := PUNCT.match(self.s, p):
            self.kind, self.value, self.pos = "punct", m[0], m.end()
        else:
            self.kind, self.value = "end", c
            self.fail(f"unexpected character {c!r}")

    def state(self):
        return self.pos, self.kind, self.value, self.start, self.newline, self.last_end

    def back(self, state) -> None:
        self.pos, self.kind, self.value, self.start, self.newline, self.last_end = state

    def at(self, value: str) -> bool:
        return self.value == value and self.kind in ("punct", "name")

    def eat(self, value: str) -> bool:
        if self.at(value):
            self.advance()
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.eat(value):
            self.fail(f"expected {value!r}, found {self.value!r}")

    def peek(self):
        """The token after this one, as (kind, value, newline before)."""
        s = self.state()
        self.advance()
        out = self.kind, self.value, self.newline
        self.back(s)
        return out

    def semicolon(self) -> None:
        if self.eat(";") or self.at("}") or self.kind == "end" or self.newline:
            return
        self.fail()

    def node(self, type_: str, start: int, **fields) -> Node:
        n = Node(type_, **fields)
        n.start, n.end = start, self.last_end
        return n

    # statements

    def program(self) -> Node:
        body = []
        while self.kind != "end" or (self.recover and self.start < len(self.s)):
            body.append(self.read_on(True) if self.recover else self.statement())
        out = self.node("Program", 0, body=self.directives(body))
        out.end = len(self.s)
        return out

    def directives(self, body: list[Node]) -> list[Node]:
        for x in body:
            if x.type != "ExpressionStatement" or x.expression.type != "StringLiteral" or self.s[x.start] not in "\"'":
                break
            x.directive = True
        return body

    def read_on(self, outermost: bool) -> Node:
        """A statement, or what stands in its place as text: up to the next semicolon, line or closing brace behind where reading failed."""
        start, no_in = self.start, self.no_in
        try:
            if self.kind == "end":
                self.fail()
            return self.statement()
        except JsSyntaxError as e:
            if self.start >= len(self.s) and not outermost:
                raise  # a block that never ends is its owner's failure
            self.errors.append(str(e))
        m = STOP.search(self.s, max(self.start, start + 1))
        end = len(self.s) if m is None else m.start() if m[0] == "}" and not outermost else m.end()
        n = Node("UnreadStatement", text=self.s[start:end].rstrip())
        n.start, n.end = start, end
        self.pos, self.no_in = end, no_in
        while True:
            try:
                self.advance()
                break
            except JsSyntaxError as e:  # no token starts here: it belongs to what cannot be read
                self.errors.append(str(e))
                m = STOP.search(self.s, self.start + 1)
                self.pos = n.end = len(self.s) if m is None else m.end()
                n.text = self.s[start : n.end].rstrip()
        self.last_end = self.gap = n.end
        return n

    def statement(self) -> Node:
        """A statement, with the comments before it and behind it on its line as notes."""
        before = COMMENT.findall(self.s, self.gap, self.start) if self.start > self.gap else []
        self.gap = self.start
        n = self.bare_statement()
        if before:
            n.notes = (before, [])
        at = self.last_end
        self.gap = at
        m = TRAILING.match(self.s, at) if self.start > at else None
        if m and m.end() <= self.start:
            n.notes = (before, [c for c in COMMENT.findall(m[0])])
            self.gap = m.end()
        return n

    def bare_statement(self) -> Node:
        start, v = self.start, self.value
        if self.kind == "punct":
            if v == "{":
                return self.block()
            if v == ";":
                self.advance()
                return self.node("EmptyStatement", start)
            if v == "@":
                found = self.decorators()
                n = self.statement()
                target = n.declaration if n.type in ("ExportNamedDeclaration", "ExportDefaultDeclaration") else n
                if target is None or target.type != "ClassDeclaration":
                    self.fail("decorators stand before classes")
                target.set("decorators", found)
                return n
        elif self.kind == "name" and not self.escaped:
            f = getattr(self, "s_" + v, None) if v in KEYWORDS else None
            if f and not (v == "import" and self.peek()[1] in ("(", ".")):
                return f(start)
            if v == "async":
                kind, value, newline = self.peek()
                if value == "function" and kind == "name" and not newline:
                    self.advance()
                    return self.function(start, True, True)
            if v == "using" or (v == "await" and self.peek()[1] == "using"):
                declared = self.using(start)
                if declared:
                    return declared
            if v == "let":
                kind, value, _ = self.peek()
                if value in ("[", "{") or (kind == "name" and value not in ("in", "instanceof", "of")):
                    return self.declaration(start)
            if self.peek()[:2] == ("punct", ":") and v not in KEYWORDS:
                label = self.identifier()
                self.advance()
                return self.node("LabeledStatement", start, label=label, body=self.statement())
        e = self.expression()
        self.semicolon()
        return self.node("ExpressionStatement", start, expression=e)

    def block(self) -> Node:
        start = self.start
        self.gap = self.pos
        self.expect("{")
        body = []
        while not self.at("}"):
            body.append(self.read_on(False) if self.recover and self.kind != "end" else self.statement())
        self.advance()
        return self.node("BlockStatement", start, body=body)

    def paren(self) -> Node:
        self.expect("(")
        e = self.expression()
        self.expect(")")
        return e

    def declaration(self, start: int, semicolon: bool = True) -> Node:
        kind = self.value
        self.advance()
        out = []
        while True:
            at = self.start
            target = self.binding()
            init = self.assignment() if self.eat("=") else None
            out.append(self.node("VariableDeclarator", at, id=target, init=init))
            if not self.eat(","):
                break
        if semicolon:
            self.semicolon()
        return self.node("VariableDeclaration", start, kind=kind, declarations=out)

    s_var = s_const = declaration

    def using(self, start: int) -> Node | None:
        """`using x = ...` and `await using x = ...`, or nothing where the words are names."""
        before, wait = self.state(), self.eat("await")
        kind, value, newline = self.peek()
        if kind != "name" or newline or value in ("in", "instanceof", "of", "as"):
            self.back(before)
            return None
        n = self.declaration(start)
        n.kind = "await using" if wait else "using"
        return n

    def s_function(self, start):
        return self.function(start, True)

    def s_class(self, start):
        return self.klass(start, True)

    def s_if(self, start):
        self.advance()
        test, yes = self.paren(), self.statement()
        return self.node("IfStatement", start, test=test, consequent=yes, alternate=self.statement() if self.eat("else") else None)

    def s_while(self, start):
        self.advance()
        return self.node("WhileStatement", start, test=self.paren(), body=self.statement())

    def s_do(self, start):
        self.advance()
        body = self.statement()
        self.expect("while")
        test = self.paren()
        self.eat(";")
        return self.node("DoWhileStatement", start, body=body, test=test)

    def s_with(self, start):
        self.advance()
        return self.node("WithStatement", start, object=self.paren(), body=self.statement())

    def s_for(self, start):
        self.advance()
        wait = self.eat("await")
        self.expect("(")
        init, at = None, self.start
        self.no_in = True
        if self.at(";"):
            pass
        elif self.value in ("var", "const") or (self.value == "let" and self.peek()[1] not in ("in", "of", ";", "=", ",", ".")):
            init = self.declaration(at, False)
        else:
            init = self.expression()
        self.no_in = False
        if init is not None and (self.at("in") or self.at("of")):
            if init.type != "VariableDeclaration":
                init = self.pattern(init)
            of = self.value == "of"
            self.advance()
            right = self.assignment() if of else self.expression()
            self.expect(")")
            return self.node("ForOfStatement" if of else "ForInStatement", start, left=init, right=right, body=self.statement(), **({"wait": wait} if of else {}))
        self.expect(";")
        test = None if self.at(";") else self.expression()
        self.expect(";")
        update = None if self.at(")") else self.expression()
        self.expect(")")
        return self.node("ForStatement", start, init=init, test=test, update=update, body=self.statement())

    def jump(self, start, type_):
        self.advance()
        label = self.identifier() if self.kind == "name" and not self.newline and self.value not in KEYWORDS else None
        self.semicolon()
        return self.node(type_, start, label=label)

    def s_break(self, start):
        return self.jump(start, "BreakStatement")

    def s_continue(self, start):
        return self.jump(start, "ContinueStatement")

    def s_return(self, start):
        self.advance()
        e = None if self.newline or self.kind == "end" or self.value in (";", "}") and self.kind == "punct" else self.expression()
        self.semicolon()
        return self.node("ReturnStatement", start, argument=e)

    def s_throw(self, start):
        self.advance()
        e = self.expression()
        self.semicolon()
        return self.node("ThrowStatement", start, argument=e)

    def s_debugger(self, start):
        self.advance()
        self.semicolon()
        return self.node("DebuggerStatement", start)

    def s_switch(self, start):
        self.advance()
        d = self.paren()
        self.expect("{")
        cases = []
        while not self.eat("}"):
            at = self.start
            test = None
            if self.eat("case"):
                test = self.expression()
            else:
                self.expect("default")
            self.gap = self.pos
            self.expect(":")
            body = []
            while not (self.at("case") or self.at("default") or self.at("}")):
                body.append(self.statement())
            cases.append(self.node("SwitchCase", at, test=test, consequent=body))
        return self.node("SwitchStatement", start, discriminant=d, cases=cases)

    def s_try(self, start):
        self.advance()
        body, handler, final = self.block(), None, None
        at = self.start
        if self.eat("catch"):
            param = None
            if self.eat("("):
                param = self.binding()
                self.expect(")")
            handler = self.node("CatchClause", at, param=param, body=self.block())
        if self.eat("finally"):
            final = self.block()
        if not handler and not final:
            self.fail()
        return self.node("TryStatement", start, block=body, handler=handler, finalizer=final)

    def module_name(self) -> Node:
        return self.literal() if self.kind == "str" else self.identifier(True)

    def s_import(self, start):
        self.advance()
        found = []
        if self.kind != "str":
            if self.kind == "name":
                found.append(self.node("ImportDefaultSpecifier", self.start, local=self.identifier()))
                self.eat(",")
            if self.eat("*"):
                self.expect("as")
                found.append(self.node("ImportNamespaceSpecifier", self.start, local=self.identifier()))
            elif self.eat("{"):
                while not self.eat("}"):
                    name = self.module_name()
                    local = self.identifier() if self.eat("as") else name.copy()
                    found.append(self.node("ImportSpecifier", name.start, imported=name, local=local))
                    self.at("}") or self.expect(",")
            self.expect("from")
        source = self.literal()
        attributes = self.attributes()
        self.semicolon()
        return self.node("ImportDeclaration", start, specifiers=found, source=source, attributes=attributes)

    def attributes(self) -> list[Node] | None:
        """`with { type: "json" }` behind a module's name, also as `assert`."""
        if not (self.at("with") or (self.at("assert") and not self.newline)) or self.peek()[1] != "{":
            return None
        self.advance()
        self.advance()
        out = []
        while not self.eat("}"):
            at, key = self.start, self.module_name()
            self.expect(":")
            out.append(self.node("ImportAttribute", at, key=key, value=self.literal()))
            self.at("}") or self.expect(",")
        return out

    def s_export(self, start):
        self.advance()
        if self.eat("*"):
            name = self.module_name() if self.eat("as") else None
            self.expect("from")
            source = self.literal()
            attributes = self.attributes()
            self.semicolon()
            return self.node("ExportAllDeclaration", start, exported=name, source=source, attributes=attributes)
        if self.eat("default"):
            at = self.start
            if self.at("function") or (self.at("async") and self.peek()[1] == "function"):
                is_async = self.eat("async")
                d = self.function(at, True, is_async)
            elif self.at("class") or self.at("@"):
                d = self.klass(at, True)
            else:
                d = self.assignment()
                self.semicolon()
            return self.node("ExportDefaultDeclaration", start, declaration=d)
        if self.eat("{"):
            found = []
            while not self.eat("}"):
                local = self.module_name()
                exported = self.module_name() if self.eat("as") else local.copy()
                found.append(self.node("ExportSpecifier", local.start, local=local, exported=exported))
                self.at("}") or self.expect(",")
            source = self.literal() if self.eat("from") else None
            attributes = self.attributes() if source else None
            self.semicolon()
            return self.node("ExportNamedDeclaration", start, declaration=None, specifiers=found, source=source, attributes=attributes)
        return self.node("ExportNamedDeclaration", start, declaration=self.statement(), specifiers=[], source=None)

    # functions, classes, patterns

    def function(self, start: int, statement: bool, is_async: bool = False) -> Node:
        self.expect("function")
        gen = self.eat("*")
        name = self.identifier() if self.kind == "name" and not self.at("(") else None
        params, body = self.params(), self.body()
        return self.node("FunctionDeclaration" if statement else "FunctionExpression", start, id=name, params=params, body=body, generator=gen, is_async=is_async)

    def params(self) -> list[Node]:
        self.expect("(")
        out = []
        while not self.eat(")"):
            out.append(self.binding_default() if not self.at("...") else self.rest())
            self.at(")") or self.expect(",")
        return out

    def body(self) -> Node:
        keep, self.no_in = self.no_in, False
        b = self.block()
        self.no_in = keep
        self.directives(b.body)
        return b

    def rest(self) -> Node:
        start = self.start
        self.expect("...")
        return self.node("RestElement", start, argument=self.binding())

    def binding_default(self) -> Node:
        start, target = self.start, self.binding()
        return self.node("AssignmentPattern", start, left=target, right=self.assignment()) if self.eat("=") else target

    def binding(self) -> Node:
        if self.at("[") or self.at("{"):
            return self.pattern(self.primary())
        return self.identifier()

    def pattern(self, e: Node) -> Node:
        """An expression that turned out to be an assignment's target."""
        t = e.type
        if t in ("Identifier", "MemberExpression", "ArrayPattern", "ObjectPattern", "AssignmentPattern", "RestElement"):
            return e
        if t == "AssignmentExpression" and e.operator == "=":
            out = Node("AssignmentPattern", left=self.pattern(e.left), right=e.right)
        elif t == "ArrayExpression":
            out = Node("ArrayPattern", elements=[x and self.pattern(x) for x in e.elements])
        elif t == "SpreadElement":
            out = Node("RestElement", argument=self.pattern(e.argument))
        elif t == "ObjectExpression":
            for p in e.properties:
                if p.type == "ObjectProperty":
                    p.set("value", self.pattern(p.value))
                elif p.type != "SpreadElement":
                    self.fail("not a pattern")
            out = Node("ObjectPattern", properties=[self.pattern(p) if p.type == "SpreadElement" else p for p in e.properties])
        elif t == "OptionalMemberExpression" or t == "CallExpression":
            return e  # an error the tools read over: foo() += 1
        else:
            self.fail("not an assignment target")
        out.start, out.end = e.start, e.end
        return out

    def decorators(self) -> list[Node]:
        """`@name`, `@a.b`, `@a.b(...)` and `@(...)`, one after the other."""
        out = []
        while self.at("@"):
            at = self.start
            self.advance()
            if self.at("("):
                e = self.paren()
            else:
                from_, e = self.start, self.identifier()
                while self.eat("."):
                    prop = self.private() if self.kind == "private" else self.identifier(True)
                    e = self.node("MemberExpression", from_, object=e, property=prop, computed=False)
                if self.at("("):
                    e = self.node("CallExpression", from_, callee=e, arguments=self.args())
            out.append(self.node("Decorator", at, expression=e))
        return out

    def klass(self, start: int, statement: bool) -> Node:
        found = self.decorators()
        self.expect("class")
        name = self.identifier() if self.kind == "name" and self.value not in ("extends",) else None
        parent = self.unary_tail(self.primary()) if self.eat("extends") else None
        at, body = self.start, []
        self.expect("{")
        while not self.eat("}"):
            if not self.eat(";"):
                body.append(self.class_member())
        return self.node("ClassDeclaration" if statement else "ClassExpression", start, id=name, superClass=parent, body=self.node("ClassBody", at, body=body), decorators=found)

    def modifier(self, word: str) -> bool:
        """Whether a word stands before a member's name, and is not the name."""
        if not self.at(word) or self.kind != "name":
            return False
        kind, value, newline = self.peek()
        if kind == "punct" and value in ("(", "=", ";", "}", ",", ":") or (newline and word != "static"):
            return False
        self.advance()
        return True

    def class_member(self) -> Node:
        start = self.start
        found = self.decorators()
        n = self.bare_member(start)
        if found:
            n.set("decorators", found)
        return n

    def bare_member(self, start: int) -> Node:
        static = self.modifier("static")
        if static and self.at("{"):
            b = self.block()
            return self.node("StaticBlock", start, body=b.body)
        is_async = self.modifier("async")
        gen = self.eat("*")
        kind = "method"
        for k in ("get", "set"):
            if not gen and not is_async and self.modifier(k):
                kind = k
        key, computed = self.property_key()
        if self.at("("):
            params, body = self.params(), self.body()
            if not static and not computed and kind == "method" and getattr(key, "name", getattr(key, "value", None)) == "constructor":
                kind = "constructor"
            return self.node("ClassMethod", start, key=key, params=params, body=body, kind=kind, computed=computed, static=static, generator=gen, is_async=is_async)
        value = self.assignment() if self.eat("=") else None
        self.semicolon()
        return self.node("ClassProperty", start, key=key, value=value, computed=computed, static=static)

    def property_key(self) -> tuple[Node, bool]:
        if self.eat("["):
            keep, self.no_in = self.no_in, False
            k = self.assignment()
            self.no_in = keep
            self.expect("]")
            return k, True
        if self.kind in ("str", "num"):
            return self.literal(), False
        if self.kind == "private":
            n = self.node("PrivateName", self.start, name=self.value)
            self.advance()
            return n, False
        return self.identifier(True), False

    # expressions

    def expression(self) -> Node:
        start, e = self.start, self.assignment()
        if not self.at(","):
            return e
        all_ = [e]
        while self.eat(","):
            all_.append(self.assignment())
        return self.node("SequenceExpression", start, expressions=all_)

    def assignment(self) -> Node:
        start = self.start
        if self.kind == "name" and not self.escaped:
            if self.value == "async":
                kind, value, newline = self.peek()
                if kind == "name" and not newline and value not in KEYWORDS and value not in ("of", "in"):
                    s = self.state()
                    self.advance()
                    p = self.identifier()
                    if self.at("=>"):
                        return self.arrow(start, [p], True)
                    self.back(s)
            if self.value == "yield":
                kind, value, newline = self.peek()
                if not (kind == "punct" and value in ("=>", "=", ".", ":", "?")):
                    self.advance()
                    star = self.eat("*")
                    bare = self.newline or self.kind == "end" or (self.kind == "punct" and self.value in (")", "]", "}", ",", ";", ":")) or self.at("in") or self.at("of")
                    return self.node("YieldExpression", start, argument=None if bare and not star else self.assignment(), delegate=star)
        e = self.conditional()
        if self.kind == "punct":
            if self.value == "=>" and not self.newline and (e.type == "Identifier" or getattr(e, "cover", False)):
                e.__dict__.pop("cover", None)
                return self.arrow(start, [e] if e.type == "Identifier" else e.items)
            if self.value in ASSIGN:
                op = self.value
                left = self.pattern(e) if op == "=" else e
                self.advance()
                return self.node("AssignmentExpression", start, operator=op, left=left, right=self.assignment())
        return e

    def arrow(self, start: int, params: list[Node], is_async: bool = False) -> Node:
        params = [self.pattern(p) for p in params]
        self.expect("=>")
        if self.at("{"):
            body = self.body()
        else:
            body = self.assignment()
        return self.node("ArrowFunctionExpression", start, params=params, body=body, is_async=is_async, generator=False)

    def conditional(self) -> Node:
        start, e = self.start, self.binary(0)
        if not self.at("?"):
            return e
        self.advance()
        keep, self.no_in = self.no_in, False
        yes = self.assignment()
        self.no_in = keep
        self.expect(":")
        return self.node("ConditionalExpression", start, test=e, consequent=yes, alternate=self.assignment())

    def binary(self, least: int) -> Node:
        start, left = self.start, self.unary()
        while self.kind in ("punct", "name"):
            op = self.value
            p = BINARY.get(op)
            if p is None or p <= least or (op == "in" and self.no_in):
                break
            self.advance()
            right = self.binary(p - 1 if op == "**" else p)
            left = self.node("LogicalExpression" if p <= 3 else "BinaryExpression", start, operator=op, left=left, right=right)
        return left

    def unary(self) -> Node:
        start, v = self.start, self.value
        if self.kind == "punct" and v in ("!", "~", "+", "-") or self.kind == "name" and v in ("typeof", "void", "delete"):
            self.advance()
            return self.node("UnaryExpression", start, operator=v, argument=self.unary())
        if self.kind == "punct" and v in ("++", "--"):
            self.advance()
            return self.node("UpdateExpression", start, operator=v, prefix=True, argument=self.unary())
        if self.kind == "name" and v == "await":
            kind, value, newline = self.peek()
            if not newline and (kind in ("name", "num", "str", "template") and value not in BINARY or value in ("(", "[", "{", "!", "+", "-", "~", "/") and kind == "punct"):
                self.advance()
                return self.node("AwaitExpression", start, argument=self.unary())
        e = self.unary_tail(self.primary())
        if self.kind == "punct" and self.value in ("++", "--") and not self.newline:
            op = self.value
            self.advance()
            return self.node("UpdateExpression", start, operator=op, prefix=False, argument=e)
        return e

    def args(self) -> list[Node]:
        self.expect("(")
        keep, self.no_in = self.no_in, False
        out = []
        while not self.eat(")"):
            out.append(self.spread() if self.at("...") else self.assignment())
            self.at(")") or self.expect(",")
        self.no_in = keep
        return out

    def spread(self) -> Node:
        start = self.start
        self.expect("...")
        return self.node("SpreadElement", start, argument=self.assignment())

    def unary_tail(self, e: Node, calls: bool = True) -> Node:
        """Members, calls and templates after an expression."""
        start, chain = e.start if e.start is not None else self.start, False
        while True:
            if getattr(e, "cover", False):
                return e
            if self.eat("."):
                prop = self.private() if self.kind == "private" else self.identifier(True)
                e = self.member(start, e, prop, False, chain, False)
            elif self.at("?.") and calls:
                self.advance()
                chain = True
                if self.at("("):
                    e = self.node("OptionalCallExpression", start, callee=e, arguments=self.args(), optional=True)
                elif self.eat("["):
                    prop = self.expression()
                    self.expect("]")
                    e = self.member(start, e, prop, True, True, True)
                else:
                    prop = self.private() if self.kind == "private" else self.identifier(True)
                    e = self.member(start, e, prop, False, True, True)
            elif self.at("["):
                self.advance()
                keep, self.no_in = self.no_in, False
                prop = self.expression()
                self.no_in = keep
                self.expect("]")
                e = self.member(start, e, prop, True, chain, False)
            elif self.at("(") and calls:
                if e.type == "Identifier" and e.name == "async" and not self.newline:
                    args = self.args()
                    if self.at("=>") and not self.newline:
                        return self.arrow(start, args, True)
                    e = self.node("CallExpression", start, callee=e, arguments=args)
                elif chain:
                    e = self.node("OptionalCallExpression", start, callee=e, arguments=self.args(), optional=False)
                else:
                    e = self.node("CallExpression", start, callee=e, arguments=self.args())
            elif self.kind == "template":
                e = self.node("TaggedTemplateExpression", start, tag=e, quasi=self.template())
            else:
                return e

    def member(self, start, o, prop, computed, chain, optional) -> Node:
        if chain:
            return self.node("OptionalMemberExpression", start, object=o, property=prop, computed=computed, optional=optional)
        return self.node("MemberExpression", start, object=o, property=prop, computed=computed)

    def private(self) -> Node:
        n = self.node("PrivateName", self.start, name=self.value)
        self.advance()
        return n

    def identifier(self, any_name: bool = False) -> Node:
        if self.kind != "name" or (not any_name and self.value in KEYWORDS and not self.escaped):
            self.fail()
        start, name = self.start, self.value
        self.advance()
        return self.node("Identifier", start, name=name)

    def literal(self) -> Node:
        start, v = self.start, self.value
        if self.kind == "str":
            self.advance()
            return self.node("StringLiteral", start, value=unescape(v[1:-1]), raw=v)
        if self.kind != "num":
            self.fail()
        self.advance()
        t = v.replace("_", "")
        if t.endswith("n") and not t.lower().startswith("0x") or (t.lower().startswith("0x") and t.endswith("n")):
            return self.node("BigIntLiteral", start, value=t[:-1])
        if t[:2].lower() in ("0x", "0o", "0b"):
            value = int(t, 0)
        elif re.fullmatch(r"0[0-7]+", t):
            value = int(t, 8)
        else:
            value = float(t)
            value = int(value) if value.is_integer() and abs(value) < 2**53 else value
        return self.node("NumericLiteral", start, value=value, raw=v)

    def template(self) -> Node:
        """From just behind a back quote."""
        start, quasis, found, s = self.start, [], [], self.s
        while True:
            p = self.pos
            while p < len(s) and s[p] != "`" and not s.startswith("${", p):
                p += 2 if s[p] == "\\" else 1
            if p >= len(s):
                self.fail("unterminated template")
            raw = s[self.pos : p].replace("\r\n", "\n")
            quasis.append(Node("TemplateElement", raw=raw, cooked=unescape(raw)))
            if s[p] == "`":
                self.pos = p + 1
                self.advance()
                return self.node("TemplateLiteral", start, quasis=quasis, expressions=found)
            self.pos = p + 2
            self.advance()
            found.append(self.expression())
            if not self.at("}"):
                self.fail()
            self.pos = self.start + 1

    def primary(self) -> Node:
        start, v, kind = self.start, self.value, self.kind
        if kind in ("num", "str"):
            return self.literal()
        if kind == "template":
            return self.template()
        if kind == "private":
            return self.private()
        if kind == "punct" and v == "@":
            return self.klass(start, False)
        if kind == "name" and (not self.escaped or v not in KEYWORDS):
            simple = {"this": ("ThisExpression", {}), "null": ("NullLiteral", {}), "true": ("BooleanLiteral", {"value": True}), "false": ("BooleanLiteral", {"value": False}), "super": ("Super", {})}.get(v)
            if simple:
                self.advance()
                return self.node(simple[0], start, **simple[1])
            if v == "function":
                return self.function(start, False)
            if v == "class":
                return self.klass(start, False)
            if v == "async":
                k, x, newline = self.peek()
                if x == "function" and k == "name" and not newline:
                    self.advance()
                    return self.function(start, False, True)
            if v == "new":
                return self.new(start)
            if v == "import":
                self.advance()
                if self.eat("."):
                    return self.node("MetaProperty", start, meta=Node("Identifier", name="import"), property=self.identifier(True))
                return self.node("Import", start)
            return self.identifier()
        if v == "(":
            return self.parenthesis(start)
        if v == "[":
            return self.array(start)
        if v == "{":
            return self.object(start)
        if v in ("/", "/="):
            m = REGEX.match(self.s, start)
            if not m:
                self.fail("unterminated regular expression")
            self.pos = m.end()
            self.advance()
            return self.node("RegExpLiteral", start, pattern=m[1], flags=m[2])
        if v == "<" and self.jsx:
            return self.jsx_element(start)
        return self.fail()

    def new(self, start: int) -> Node:
        self.advance()
        if self.eat("."):
            return self.node("MetaProperty", start, meta=Node("Identifier", name="new"), property=self.identifier(True))
        callee = self.unary_tail(self.new(self.start) if self.at("new") else self.primary(), calls=False)
        return self.node("NewExpression", start, callee=callee, arguments=self.args() if self.at("(") else [])

    def parenthesis(self, start: int) -> Node:
        """A parenthesised expression, or what stands before an arrow."""
        self.advance()
        keep, self.no_in = self.no_in, False
        items, only = [], False
        while not self.at(")"):
            if self.at("..."):
                items.append(self.spread())
                only = True
            else:
                items.append(self.assignment())
            if not self.eat(","):
                break
            only = only or self.at(")")
        self.expect(")")
        self.no_in = keep
        if self.at("=>") and not self.newline:
            return self.cover(items, start)
        if only or not items:
            self.fail()
        if len(items) == 1:
            items[0].parens = True
            return items[0]
        return self.node("SequenceExpression", start, expressions=items)

    def cover(self, items: list[Node], start: int) -> Node:
        n = Node("ThisExpression")
        n.cover, n.items, n.start = True, items, start
        return n

    def array(self, start: int) -> Node:
        self.advance()
        keep, self.no_in = self.no_in, False
        out: list[Node | None] = []
        while not self.at("]"):
            if self.eat(","):
                out.append(None)
                continue
            out.append(self.spread() if self.at("...") else self.assignment())
            self.at("]") or self.expect(",")
        self.advance()
        self.no_in = keep
        return self.node("ArrayExpression", start, elements=out)

    def object(self, start: int) -> Node:
        self.advance()
        keep, self.no_in = self.no_in, False
        out = []
        while not self.eat("}"):
            out.append(self.spread() if self.at("...") else self.property())
            self.at("}") or self.expect(",")
        self.no_in = keep
        return self.node("ObjectExpression", start, properties=out)

    def property(self) -> Node:
        start = self.start
        is_async = self.modifier("async")
        gen = self.eat("*")
        kind = "method"
        for k in ("get", "set"):
            if not gen and not is_async and self.modifier(k):
                kind = k
        word = self.kind == "name"
        key, computed = self.property_key()
        if self.at("("):
            params, body = self.params(), self.body()
            return self.node("ObjectMethod", start, key=key, params=params, body=body, kind=kind, computed=computed, generator=gen, is_async=is_async)
        if self.eat(":"):
            return self.node("ObjectProperty", start, key=key, value=self.assignment(), computed=computed, shorthand=False)
        if not word or computed:
            self.fail()
        value = key.copy()
        if self.eat("="):
            value = self.node("AssignmentPattern", start, left=value, right=self.assignment())
        return self.node("ObjectProperty", start, key=key, value=value, computed=False, shorthand=True)

    # JSX

    def jsx_name(self) -> Node:
        m = re.compile(r"\s*([\w$-]+)").match(self.s, self.start)
        if not m:
            self.fail()
        self.pos = m.end()
        n = Node("JSXIdentifier", name=m[1])
        self.advance()
        if self.at(":"):
            self.advance()
            return Node("JSXNamespacedName", namespace=n, name=self.jsx_name())
        while self.at("."):
            self.advance()
            m = re.compile(r"[\w$-]+").match(self.s, self.start)
            self.pos = m.end()
            n = Node("JSXMemberExpression", object=n, property=Node("JSXIdentifier", name=m[0]))
            self.advance()
        return n

    def jsx_element(self, start: int, inside: bool = False) -> Node:
        """An element or a fragment; this token is its `<`."""
        self.advance()
        if self.at(">"):
            children = self.jsx_children()
            self.expect("/")
            return self.jsx_end(self.node("JSXFragment", start, children=children), inside)
        name, attributes = self.jsx_name(), []
        while not (self.at(">") or self.at("/")):
            if self.eat("{"):
                self.expect("...")
                attributes.append(Node("JSXSpreadAttribute", argument=self.assignment()))
                self.expect("}")
                continue
            key, value = self.jsx_name(), None
            if self.at("="):
                m = re.compile(r"\s*(\"[^\"]*\"|'[^']*')").match(self.s, self.pos)
                if m:
                    value = Node("StringLiteral", value=html.unescape(m[1][1:-1]))
                    self.pos = m.end()
                    self.advance()
                else:
                    self.advance()
                    value = self.jsx_container() if self.at("{") else self.jsx_element(self.start)
            attributes.append(Node("JSXAttribute", name=key, value=value))
        if self.eat("/"):
            opening = Node("JSXOpeningElement", name=name, attributes=attributes, selfClosing=True)
            return self.jsx_end(self.node("JSXElement", start, openingElement=opening, children=[], closingElement=None), inside)
        children = self.jsx_children()
        self.expect("/")
        opening = Node("JSXOpeningElement", name=name, attributes=attributes, selfClosing=False)
        closing = Node("JSXClosingElement", name=self.jsx_name())
        return self.jsx_end(self.node("JSXElement", start, openingElement=opening, children=children, closingElement=closing), inside)

    def jsx_end(self, n: Node, inside: bool) -> Node:
        """Takes the last `>`; inside other elements, text follows and is not scanned as code."""
        if not self.at(">"):
            self.fail()
        n.end = self.start + 1
        if not inside:
            self.advance()
        return n

    def jsx_container(self) -> Node:
        self.expect("{")
        if self.eat("..."):
            n = Node("JSXSpreadChild", expression=self.expression())
        else:
            n = Node("JSXExpressionContainer", expression=Node("JSXEmptyExpression") if self.at("}") else self.expression())
        if not self.at("}"):
            self.fail()
        self.advance()
        return n

    def jsx_children(self) -> list[Node]:
        """What stands behind an opening tag's `>`, up to the `</` of the closing one (the `<` is taken)."""
        out, p = [], self.start + 1
        while True:
            m = re.compile(r"[^<{]*").match(self.s, p)
            if m[0]:
                out.append(Node("JSXText", value=m[0]))
            self.pos = m.end()
            if self.pos >= len(self.s):
                self.fail("unterminated element")
            self.advance()
            at = self.start
            if self.at("{"):
                self.advance()
                if self.eat("..."):
                    out.append(Node("JSXSpreadChild", expression=self.expression()))
                else:
                    out.append(Node("JSXExpressionContainer", expression=Node("JSXEmptyExpression") if self.at("}") else self.expression()))
                if not self.at("}"):
                    self.fail()
                p = self.start + 1
                continue
            if self.peek()[1] == "/":
                self.advance()
                return out
            child = self.jsx_element(at, True)
            out.append(child)
            p = child.end


def parse(text: str, jsx: bool = True, recover: bool = False) -> Node:
    """The program of a text; raises JsSyntaxError.

    With recover, statements that cannot be read are UnreadStatement nodes with
    their text, and the program's errors says why.
    """
    try:
        p = Parser(text, jsx, recover)
        out = p.program()
        out.errors = p.errors
        return planted(out, text)
    except RecursionError as e:
        raise JsSyntaxError("nested too deeply") from e


def parse_expression(text: str) -> Node:
    """One whole expression."""
    p = Parser(text)
    e = p.expression()
    if p.kind != "end":
        p.fail()
    return e
