import pytest

from scriptloom.js import ask
from scriptloom.js.parser import parse, parse_expression


@pytest.mark.parametrize(("test", "yes", "no"), [
    (ask.is_true, ["true", "!0", "!!1", "!![]"], ["1", "!1", "[]", "!a"]),
    (ask.is_false, ["false", "![]"], ["!1", "0", "!0"]),
    (ask.is_truthy, ["true", "[]", "!0"], ["[1]", "1"]),
    (ask.is_undefined, ["undefined", "void 0"], ["void 1", "null"]),
    (ask.is_literal, ["1", "'a'", "`a`", "null", "/a/", "1n"], ["`${a}`", "a", "[1]"]),
    (ask.is_member, ["a.b", "a['b']", "a[1]"], ["a[b]", "a"]),
    (ask.is_iife, ["(function () {})()", "(() => {})()"], ["(function a() {})()", "f()"]),
    (ask.is_pure, ["-1", "[1, 'a']", "({ a: 1 })", "typeof 1"], ["a", "f()", "[a]", "({ [a]: 1 })"]),
])
def test_expressions(test, yes, no):
    assert [test(parse_expression(f"({x})")) for x in yes + no] == [True] * len(yes) + [False] * len(no)


def test_loops():
    codes = ["for (;;);", "for (; true;);", "while (!0);", "while (a);", "for (a;;);", "for (;; a);"]
    assert [ask.is_infinite_loop(parse(c).body[0]) for c in codes] == [True, True, True, False, False, False]


def test_sublists():
    body = parse("a(); b(); c(); d();").body
    named = lambda x: lambda n: n.expression.callee.name == x
    assert ask.any_sublist(body, named("a"), named("c")) == [body[0], body[2]]
    assert ask.any_sublist(body, named("c"), named("a")) is None


@pytest.mark.parametrize(("name", "good"), [("a", True), ("$_1", True), ("ä", True), ("1a", False), ("class", False), ("a-b", False), ("", False)])
def test_identifiers(name, good):
    assert ask.valid_identifier(name) is good
