"""Putting definitions in place of their uses."""

import pytest

from scriptloom.js import deobfuscate as d
from scriptloom.js.ask import is_literal
from scriptloom.js.engine import Context
from scriptloom.js.parser import parse, parse_expression
from scriptloom.js.printer import to_code
from scriptloom.js.scope import Scopes


def flat(tree):
    return " ".join(to_code(tree).split())


VARIABLES = [
    ("const a = 'key'; use(a, a.length);", False, 'use("key", "key".length);'),
    ("var a = 40; function f(n) { return n + a; }", False, "function f(n) { return n + 40; }"),
    ("let a = 5; a = 6; show(a);", False, "let a = 5; a = 6; show(a);"),
    ("var a; a = 7; if (ready) { first(a); } a = 8; last(a);", True, "if (ready) { first(7); } last(8);"),
    ("var a; early(a); a = null; late(a);", True, "var a; early(a); a = null; late(null);"),
    ("let a = run(); show(a);", False, "let a = run(); show(a);"),
]


@pytest.mark.parametrize(("code", "nearest", "text"), VARIABLES)
def test_variables(code, nearest, text):
    tree = parse(code)
    s = Scopes(tree)
    d.inline_variable(s, s.program.own["a"], is_literal, nearest)
    assert flat(tree) == text


def test_object_properties_all_or_none():
    for code, text in (("const o = { a: 1, b: 'x' }; f(o.a, o['b']);", 'f(1, "x");'), ("const o = { a: 1 }; f(o.a, o.c);", "const o = { a: 1 }; f(o.a, o.c);")):
        tree = parse(code)
        d.inline_object_properties(Scopes(tree).program.own["o"])
        assert flat(tree) == text


CALLS = [
    ("function f(a, b) { return a + b; }", "f(1, 2)", "1 + 2"),
    ("function f(a, b, c) { return a + b + c; }", "f(1, 2)", "1 + 2 + void 0"),
    ("function f(a, ...b) { return a(...b); }", "f(x, 1, 2, 3)", "x(1, 2, 3)"),
    ("function f(a) { return o.a + a; }", "f(1)", "o.a + 1"),
]


@pytest.mark.parametrize(("function", "call", "text"), CALLS)
def test_calls(function, call, text):
    assert to_code(d.inline_function_call(parse(function).body[0], parse_expression(call))) == text


def test_aliases_of_aliases():
    tree = parse("function dec(a) {} const b = dec; const c = b; let e; e = c; c(1); e(2); (function () { const g = e; g(3); })();")
    ctx = Context(tree)
    d.inline_variable_aliases(ctx, ctx.scopes.program.own["dec"])
    assert flat(tree) == "function dec(a) {} dec(1); dec(2); (function () { dec(3); })();"


def test_wrappers_of_wrappers():
    tree = parse("function dec(a, b) {} function w(x, y) { return dec(y - 1, x); } function v(p, q, r) { return w(r, p - -2); } v(1, 2, 3); w(4, 5);")
    ctx = Context(tree)
    d.inline_function_aliases(ctx, ctx.scopes.program.own["dec"])
    assert flat(tree) == "function dec(a, b) {} dec(1 - -2 - 1, 3); dec(5 - 1, 4);"
