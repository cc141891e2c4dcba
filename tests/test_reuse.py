"""Programs of one shape share a run; each gets what its own run gives."""

import re

import pytest

from scriptloom.js.pipeline import Options, rewrite, transform
from scriptloom.js.reuse import Num, Reuse, Run
from scriptloom.operators import programs
from scriptloom.plans.rules import RULE_QUERIES

VALUES = {"c_name": "Customer#000000001", "c_mktsegment": "AUTOMOBILE", "o_orderpriority": "3-MEDIUM", "n_name": "FRANCE", "p_brand": "Brand#13", "hexkey": "1f"}


def texts(query, keys) -> list[str]:
    """The program of one of a query's cases for each key."""
    return [re.sub(r"\{([a-z]+_[a-z]+|double|big|hexkey)\}", lambda m, k=k: VALUES.get(m[1]) or str(k * 7 % 97 + 1 if m[1] in ("o_custkey", "p_size") else k), query.cases[k % len(query.cases)][1]) for k in keys]


def shared(f, codes, places=None) -> tuple[list, int]:
    """What f gives for programs by way of Reuse, and how many runs that took."""
    runs = 0

    def counted(code):
        nonlocal runs
        runs += 1
        return f(code)

    known, out = Reuse(counted, places), []
    for c in codes:
        columns, what = known.look(c)
        rows = list(zip(*columns, strict=True)) if columns else counted(c)
        if what:
            known.learn(c, rows, what)
        out.append(rows)
    return out, runs


def rows_of(name):
    query = RULE_QUERIES[name]
    if query.rules is None:
        return lambda code: [(rewrite(code, Options()).code, None)]
    return lambda code: [(transform(code, query.rules), None)]


@pytest.mark.parametrize("name", sorted(RULE_QUERIES))
def test_results_are_those_of_own_runs(name):
    codes = texts(RULE_QUERIES[name], [*range(14), *range(95, 110), 10**9, 2**40, 999_999_999_999_999])
    f = rows_of(name)
    assert shared(f, codes)[0] == [f(c) for c in codes]


# queries whose programs are alike but for numbers
SHARED = ["js_pipeline", "js_self_defending", "js_control_flow_object", "js_debug_protection", "js_control_flow", "js_optional_chaining", "js_default_parameters", "js_inline_object_props", "js_nullish", "js_split_for_vars", "js_merge_object", "js_logical_assignments"]


@pytest.mark.parametrize("name", SHARED)
def test_few_runs_for_many_programs(name):
    codes = texts(RULE_QUERIES[name], range(1, 241))
    assert shared(rows_of(name), codes)[1] <= 5 * 6 + 24


@pytest.mark.parametrize(("rules", "program"), [
    (["number-expressions"], "x=K-100;y=5-K;z=K*K;w=K/3;v=K%7;u=-K;t=K+1.5;s=K-K"),
    (["number-expressions"], "x=K*9007199254740;y=K+9007199254740990;z=2**K;q=K&7;r='a'+K"),
    (["unminify-booleans"], "x=!K;y=!1"),
    (["default-parameters"], "function f(){var a=arguments.length>K&&arguments[K]!==undefined?arguments[K]:2;g(a)}"),
    (["dead-code"], "if(K===7){a()}else{b()}"),
    (["yoda", "infinity"], "x=K<a;y=K/0;z=1/0;s='K';t=`K${K}`;u=/K/;v=<a>K</a>;/*K*/w=K.5+aK+1e3;o={K:K}[K];K..f"),
    (["control-flow-object"], "const o={abcde:function(a,b){return a+b}};x=o.abcde(K,K)"),
    (["mangle"], "let q=K;f(q)"),
])
def test_what_rules_ask_of_numbers(rules, program):
    def f(code):
        try:
            return [(transform(code, rules), None)]
        except ValueError as e:
            return [(None, str(e))]

    codes = [program.replace("K", str(k)) for k in [3, 4, 7, 8, 7, 1, 0, 2, 1, 99, 100, 101, 5, 6, 5, 100, 7, *([] if "arguments" in program else [10**14, 10**15 - 1]), 12, 14, 21, 20]]
    assert shared(f, codes)[0] == [f(c) for c in codes]


def test_numbers_that_are_asked_for_are_fixed():
    run = Run("f(1,2,3)")
    a, b, c = (Num(run, f"h[{i}]", frozenset((i,)), i + 1) for i in range(3))
    run.fixed.clear()
    assert isinstance(a, int) and a != "1" and a != 0 and a + b == 3 and not run.fixed
    assert list(run.conditions.values()) == [True, True] and int(b) == 2 and run.fixed == {1}
    assert {c: 1} and run.fixed == {1, 2} and a / 2 == 0.5 and run.fixed == {0, 1, 2}


BUNDLE = "!function(e){var t={};function n(r){if(t[r])return t[r].exports;var o=t[r]={i:r,l:!1,exports:{}};return e[r].call(o.exports,o,o.exports,n),o.l=!0,o.exports}n(n.s=ENTRY)}([function(e,t,n){e.exports=K},function(e,t,n){n(0);n(2)},function(e,t,n){n(TARGET)}]);"


def test_bundles_share_runs(monkeypatch):
    """Ids of modules are asked for, and what a module holds is not."""
    monkeypatch.setattr(programs, "per_program", lambda df, i, c, schema, f, **_: f)
    codes = [BUNDLE.replace("ENTRY", str(k % 3)).replace("TARGET", str(k % 5)).replace("K", str(k)) for k in range(1, 301)]
    for f in (programs.rewrite(None), programs.modules(None)):
        got, runs = shared(f, codes)
        assert got == [f(c) for c in codes] and runs < 120


def test_what_is_kept_is_bounded(monkeypatch):
    monkeypatch.setattr("scriptloom.js.reuse.KEPT", 10_000)
    f = rows_of("js_sequence")
    codes = [f"a{k % 40}(),b({k})" for k in range(400)]
    assert shared(f, codes)[0] == [f(c) for c in codes]


FACTS = [
    "const o={a:K,bK:K};f(o.bK);g(aK,'aK',`aK${K}`);a1=2;K.5;1e5;0x1F;a2b1", "function aK(){return a7+aK}aK();{let a7=K}", "x=<aK b={K}>K</aK>;a5", "\\u0061K=a7;var aK,bK,b7", "for(let iK=K,i3=0;iK<K;iK++)i3+=K/*K*/",
]


@pytest.mark.parametrize("program", FACTS)
@pytest.mark.parametrize("table", ["nodes", "scopes", "bindings", "references"])
def test_facts_are_those_of_own_runs(monkeypatch, table, program):
    monkeypatch.setattr(programs, "per_program", lambda df, i, c, schema, f, **_: f)
    f = getattr(programs, table)(None)
    codes = [program.replace("K", str(k)) for k in [3, 4, 55, 7, 8, 123, 7, 1, 0, 2, 5, 5, 6, 99, 12345, 10**14]]
    got, runs = shared(f, codes, (8, 9) if table == "nodes" else ())
    assert got == [f(c) for c in codes]
    assert program != FACTS[1] or runs < len(codes)


def test_programs_on_spark(spark):
    codes = [(i, "f(" if i % 5 == 0 else f"var a={i}*2,b;'u'>typeof c&&(b=void 0,d(!0))") for i in range(400)]
    got = {r.file_id: (r.code, r.error) for r in programs.rewrite(spark.createDataFrame(codes, "file_id long, code string")).collect()}
    assert all((got[i][0] is None and "JsSyntaxError" in got[i][1]) if i % 5 == 0 else got[i] == (rewrite(c).code, None) for i, c in codes)
