"""Parser, printer, numbers and scopes."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptloom.js import numbers
from scriptloom.js.ask import valid_identifier
from scriptloom.js.nodes import same
from scriptloom.js.parser import JsSyntaxError, parse
from scriptloom.js.printer import preview, quoted, to_code
from scriptloom.js.scope import Scopes, rename

PRINTED = [
    ("a=>({}).b", "a => ({}).b;"),
    ("(function(){})()", "(function () {})();"),
    ("(()=>{})()", "(() => {})();"),
    ("({a,b=1,...c}=d)", "({\n  a,\n  b = 1,\n  ...c\n} = d);"),
    ("if(a)if(b)c;else d", "if (a) if (b) c; else d;"),
    ("new (a.b())()", "new (a.b())();"),
    ("a?.b?.[c]?.(d)", "a?.b?.[c]?.(d);"),
    ("(a?.b).c", "(a?.b).c;"),
    ("(a??b)||c", "(a ?? b) || c;"),
    ("(-a)**b", "(-a) ** b;"),
    ("a-(b-c)", "a - (b - c);"),
    ("a- -b", "a - -b;"),
    ("typeof(a+b)", "typeof (a + b);"),
    ("for(var i=0,j;;);", "for (var i = 0, j;;);"),
    ("for(const [a]of b)c", "for (const [a] of b) c;"),
    ("a/b/c;/[/]/g.test(a)", "a / b / c;\n/[/]/g.test(a);"),
    ("x=`a${b}c`", "x = `a${b}c`;"),
    ("class A extends B{static #x=1;get y(){return this.#x}}", "class A extends B {\n  static #x = 1;\n  get y() {\n    return this.#x;\n  }\n}"),
    ("import a,{b as c}from'm';export{a as d};export default function(){}", 'import a, { b as c } from "m";\nexport { a as d };\nexport default function () {}'),
    ("async function*f(){for await(const x of y)yield*await x}", "async function* f() {\n  for await (const x of y) yield* await x;\n}"),
    ("a\n++b", "a;\n++b;"),
    ("return\na", "return;\na;"),
    ("x=<a b='c' {...d}>e {f} don't<g/></a>", 'x = <a b="c" {...d}>e {f} don\'t<g /></a>;'),
    ("1..toString()", "1..toString();"),
    ("'use strict';('a')", '"use strict";\n"a";'),
    ("var a=1,b=2", "var a = 1,\n  b = 2;"),
    ("[,a,,]", "[, a,,];"),
    ("x='\\u2028\\x07\"'", 'x = "\\u2028\\x07\\"";'),
    ("label:while(1)continue label", "label: while (1) continue label;"),
    ("async=>async", "async => async;"),
    ("yield_=1_000", "yield_ = 1000;"),
]


@pytest.mark.parametrize(("code", "text"), PRINTED)
def test_printed(code, text):
    assert to_code(parse(code)) == text


@pytest.mark.parametrize("code", [c for c, _ in PRINTED])
def test_printing_loses_nothing(code):
    tree = parse(code)
    assert same(parse(to_code(tree)), tree)
    assert same(parse(to_code(tree, compact=True)), tree)


@pytest.mark.parametrize("code", ["f(", "a b", "'", "`${", "var 1", "(a,)", "{", "x=<a>"])
def test_errors(code):
    with pytest.raises(JsSyntaxError):
        parse(code)


def test_deep_and_wide_programs():
    assert to_code(parse("+".join(["a"] * 3000))).count("a") == 3000
    assert to_code(parse("f(" * 300 + ")" * 300)).count("f") == 300


def test_preview():
    text = preview(parse("f(" + ",".join(map(str, range(200))) + ")"))
    assert len(text) == 103
    assert " … " in text


names = st.text("abcxyz_$", min_size=1, max_size=4).filter(valid_identifier)
leaf = st.one_of(names, st.integers(0, 10**9).map(str), st.text(max_size=5).map(lambda s: quoted("".join(c for c in s if not 0xD800 <= ord(c) <= 0xDFFF))), st.sampled_from(["true", "null", "this", "/a/g", "[]", "{}"]).map(lambda s: f"({s})"))
exprs = st.recursive(
    leaf,
    lambda e: st.one_of(
        st.tuples(e, st.sampled_from("+ - * / % ** && || == === < >>> in".split()), e).map(lambda t: f"({t[0]}) {t[1]} ({t[2]})"),
        st.tuples(st.sampled_from(["!", "-", "typeof ", "void "]), e).map(lambda t: f"{t[0]}({t[1]})"),
        st.tuples(e, e, e).map(lambda t: f"({t[0]}) ? ({t[1]}) : ({t[2]})"),
        st.lists(e, max_size=3).map(lambda x: f"f({', '.join(f'({y})' for y in x)})"),
        st.tuples(names, e).map(lambda t: f"({t[0]} = ({t[1]}))"),
        e.map(lambda x: f"(a => ({x}))"),
        e.map(lambda x: f"function () {{ return ({x}); }}").map(lambda x: f"({x})"),
    ),
    max_leaves=12,
)


@settings(max_examples=150, deadline=None)
@given(exprs)
def test_any_expression_survives_printing(code):
    tree = parse(f"x = ({code});")
    assert same(parse(to_code(tree)), tree)
    assert same(parse(to_code(tree, compact=True)), tree)


@pytest.mark.parametrize(("value", "text"), [(0.1, "0.1"), (1e21, "1e+21"), (123456789012345680000, "123456789012345680000"), (1e-7, "1e-7"), (0.000001, "0.000001"), (-0.0, "0"), (math.nan, "NaN"), (-math.inf, "-Infinity"), (5e-324, "5e-324"), (1.5e300, "1.5e+300"), (100, "100")])
def test_number_texts(value, text):
    assert numbers.to_text(value) == text


@pytest.mark.parametrize(("text", "value"), [("0xa6", 166), (" 12 ", 12), ("", 0), ("1e3", 1000), ("-Infinity", -math.inf), (".5", 0.5)])
def test_numbers_from_text(text, value):
    assert numbers.from_text(text) == value


def test_number_operators():
    assert numbers.binary("<<", 1, 35) == 8
    assert numbers.binary(">>>", -1, 0) == 4294967295
    assert numbers.binary("|", 4294967295, 0) == -1
    assert numbers.binary("%", -5, 3) == -2
    assert math.isinf(numbers.binary("/", 1, 0))
    assert math.isnan(numbers.from_text("12px"))


def test_bindings_and_references():
    s = Scopes(parse("var a=1;function f(a,{b}){var c=a;c++;return()=>a+b+d}a=2;f(a)"))
    got = sorted((b.name, b.kind, len(b.refs), len(b.writes)) for b in s.all)
    assert got == [("a", "param", 2, 0), ("a", "var", 1, 1), ("b", "param", 1, 0), ("c", "var", 1, 1), ("f", "hoisted", 1, 0)]
    assert set(s.globals) == {"d"}


def test_renaming_moves_others_away_and_keeps_keys():
    tree = parse("let a=1;{let b=a;f({a,x:a})}let b=2;b")
    s = Scopes(tree)
    rename(s, s.program.own["a"], "b")
    text = to_code(tree)
    assert text.startswith("let b = 1;")
    assert "a: b" in text
    again = Scopes(tree)
    assert len(again.program.own["b"].refs) == 3


def test_comments_before_and_behind_statements_stay():
    code = "// first\n/* second */ a(); // behind\nif (b) {\n  // inner\n  c();\n}"
    assert to_code(parse(code)) == "// first\n/* second */\na(); // behind\nif (b) {\n  // inner\n  c();\n}"
    assert to_code(parse(code), compact=True) == "a();if(b){c();}"


RENAMED = [
    ("let a = 1; let b = a;", "a", "b", "let b = 1; let _b = b;"),
    ("var a; function a() {}", "a", "b", "var b; function b() {}"),
    ("var a = 1; var a = 2; a++; [a] = [2]; var [a] = [1]; ({ ...a } = {}); for (a of []); for (a in []); delete a;", "a", "b", "var b = 1; var b = 2; b++; [b] = [2]; var [b] = [1]; ({ ...b } = {}); for (b of []); for (b in []); delete b;"),
    ('var _C = "x"; var node = <_C><_C /></_C>; var ref = _C;', "_C", "C", 'var C = "x"; var node = <C><C /></C>; var ref = C;'),
    ("var _n = {}; var x = <_n.Foo />;", "_n", "n", "var n = {}; var x = <n.Foo />;"),
]


@pytest.mark.parametrize(("code", "old", "new", "text"), RENAMED)
def test_renaming(code, old, new, text):
    tree = parse(code)
    s = Scopes(tree)
    rename(s, s.program.own[old], new)
    assert " ".join(to_code(tree).split()) == text


RECOVERED = [
    ("a=1;'no end\nb=2", "a=1;'no end\nb = 2;", 1),
    ("}}}a()", "}}\n}a()", 2),
    ("f(", "f(", 1),
    ("if(x){", "if(x){", 1),
    ("a=#;b=2", "a=#;\nb = 2;", 1),
    ("function g(){c=);d()}\ne()", "function g() {\n  c=);\n  d();\n}\ne();", 1),
    ("ok()", "ok();", 0),
    ("", "", 0),
]


@pytest.mark.parametrize(("code", "text", "n"), RECOVERED)
def test_reading_goes_on_behind_what_cannot_be_read(code, text, n):
    tree = parse(code, recover=True)
    assert to_code(tree) == text
    assert len(tree.errors) == n


@given(st.text(alphabet="a1{}();=+'\"`/\n,.[]#@ ", max_size=40))
@settings(max_examples=300, deadline=None)
def test_recovery_reads_any_text(code):
    tree = parse(code, recover=True)
    to_code(tree)
    try:
        strict = to_code(parse(code))
    except JsSyntaxError:
        assert tree.errors
    else:
        assert not tree.errors
        assert to_code(tree) == strict


@pytest.mark.parametrize("code", ["@a class A {}", "x = @a.b(c) class {};", "using = 1;\nusing;", "export { a } from \"b\" with { c: \"d\" };", "await using x = f();"])
def test_newer_syntax_prints_as_it_is_read(code):
    once = to_code(parse(code))
    assert to_code(parse(once)) == once
    assert once.replace("\n", " ") == code.replace("\n", " ")
    compact = to_code(parse(code), compact=True)
    assert to_code(parse(compact)) == once
