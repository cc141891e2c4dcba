"""Queries that apply one rule to programs made from table columns.

A case is a condition, a program text and what the rule must make of it, with
{column} where values go.  From the same case come the Spark query (the text
is built, parsed, rewritten and printed) and the oracle (SQL that writes the
expected text from the columns alone).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.functions.kernels import spread
from scriptloom.operators import programs


def text_sql(template: str, kind: str, escaped: dict[str, str], derived: int) -> str:
    """A template as SQL concatenation: line feeds as chr(10), columns cast to text."""
    parts = []
    for part in re.split(r"(\{(?:[a-z]_[a-z]+|" + "|".join(DERIVED) + r")\}|\n|\$)", template):
        if part in ("\n", "$"):
            parts.append(f"chr({ord(part)})")  # a dollar sign would ask Spark for a variable
        elif part[:1] == "{" and part[1:-1].replace("_", "").isalpha() and part[-1:] == "}":
            name = part[1:-1]
            parts.append(f"CAST({DERIVED[name][derived] if name in DERIVED else name} AS {kind})")
        elif part:
            parts.append("'" + "".join(escaped.get(c, c) for c in part) + "'")
    return f"concat({', '.join(parts)})"


def spark_text(template: str) -> str:
    return text_sql(template, "STRING", {"\\": "\\\\", "'": "\\'"}, 0)


def duck_text(template: str) -> str:
    return text_sql(template, "VARCHAR", {"'": "''"}, 1)


class RuleQuery:
    """One rule over one table: cases are (condition, program, expected)."""

    def __init__(self, table: str, key: str, rules: list[str] | None, *cases: tuple[str, str, str]):
        self.table, self.key, self.rules, self.cases = table, key, rules, cases

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        text = "CASE " + " ".join(f"WHEN {c} THEN {spark_text(p)}" for c, p, _ in self.cases) + " END"
        made = spread(rows).select(F.col(self.key).cast("long").alias("id"), F.expr(text).alias("code")).filter("code is not null")
        if self.rules is None:
            return programs.rewrite(made, "id").select("id", "code")
        return programs.transform(made, self.rules, "id").select("id", "code")

    def oracle(self) -> str:
        text = "CASE " + " ".join(f"WHEN {c} THEN {duck_text(e)}" for c, _, e in self.cases) + " END"
        some = " OR ".join(f"({c})" for c, _, _ in self.cases)
        return f"SELECT CAST({self.key} AS BIGINT) AS id, {text} AS code FROM {self.table} WHERE {some}"


def K(n: int, i: int, key: str = "o_orderkey") -> str:  # noqa: N802
    return f"{key} % {n} = {i}"


O, C, P, S, N, L = ("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("lineitem", "l_orderkey")  # noqa: E741

RULE_QUERIES: dict[str, RuleQuery] = {
    # unminify
    "js_block_statements": RuleQuery(*O, ["block-statements"], (K(3, 0), "if(a)f({o_orderkey});else g()", "if (a) {\n  f({o_orderkey});\n} else {\n  g();\n}"), (K(3, 1), "while(a)f({o_custkey})", "while (a) {\n  f({o_custkey});\n}"), (K(3, 2), "x=()=>(a,{o_orderkey})", "x = () => {\n  return a, {o_orderkey};\n};")),
    "js_computed_props": RuleQuery(*C, ["computed-properties"], ("true", 'o["{c_mktsegment}"]["{c_custkey}"];y={"{c_mktsegment}":1}', 'o.{c_mktsegment}["{c_custkey}"];\ny = {\n  {c_mktsegment}: 1\n};')),
    "js_for_to_while": RuleQuery(*O, ["for-to-while"], (K(2, 0), "for(;a<{o_orderkey};){}", "while (a < {o_orderkey}) {}"), (K(2, 1), "for(;;){}", "while (true) {}")),
    "js_infinity": RuleQuery(*O, ["infinity"], (K(3, 0), "x{o_orderkey}=1/0", "x{o_orderkey} = Infinity;"), (K(3, 1), "x{o_orderkey}=-1/0", "x{o_orderkey} = -Infinity;"), (K(3, 2), "function f(Infinity){return 1/0}", "function f(Infinity) {\n  return 1 / 0;\n}")),
    "js_invert": RuleQuery(*O, ["invert-boolean-logic"], (K(5, 0), "x=!(a=={o_orderkey})", "x = a != {o_orderkey};"), (K(5, 1), "x=!(a!=={o_orderkey})", "x = a === {o_orderkey};"), (K(5, 2), "x=!(a<{o_orderkey})", "x = !(a < {o_orderkey});"), (K(5, 3), "x=!(a&&b{o_orderkey})", "x = !a || !b{o_orderkey};"), (K(5, 4), "x=!(a||b{o_orderkey})", "x = !a && !b{o_orderkey};")),
    "js_json_parse": RuleQuery(*P, ["json-parse"], (K(2, 0, "p_partkey"), "x=JSON.parse('[{p_size},\"{p_brand}\"]')", 'x = [{p_size}, "{p_brand}"];'), (K(2, 1, "p_partkey"), "function f(JSON){JSON.parse('{p_size}')}", 'function f(JSON) {\n  JSON.parse("{p_size}");\n}')),
    "js_logical_to_if": RuleQuery(*O, ["logical-to-if"], (K(3, 0), "a&&f({o_orderkey})", "if (a) {\n  f({o_orderkey});\n}"), (K(3, 1), "a||f({o_orderkey})", "if (!a) {\n  f({o_orderkey});\n}"), (K(3, 2), "a??f({o_orderkey})", "a ?? f({o_orderkey});")),
    "js_merge_else_if": RuleQuery(*O, ["merge-else-if"], ("true", "if(a){}else{if({o_orderkey}){}}", "if (a) {} else if ({o_orderkey}) {}")),
    "js_merge_strings": RuleQuery(*N, ["merge-strings"], ("true", 'x="{n_name}"+"-{n_nationkey}"+"!"', 'x = "{n_name}-{n_nationkey}!";')),
    "js_number_fold": RuleQuery(*O, ["number-expressions"], ("true", "x=-(-{o_orderkey})+-{o_custkey}*2", "x = {fold};")),
    "js_division_guard": RuleQuery(*P, ["number-expressions"], ("p_partkey % p_size = 0", "x={p_partkey}/{p_size}", "x = {quotient};"), ("p_partkey % p_size <> 0", "x={p_partkey}/{p_size}", "x = {p_partkey} / {p_size};")),
    "js_raw_literals": RuleQuery(*O, ["raw-literals"], ("true", "x=0x{hexkey};y='{o_orderpriority}'", 'x = {o_orderkey};\ny = "{o_orderpriority}";')),
    "js_remove_double_not": RuleQuery(*O, ["remove-double-not"], (K(3, 0), "if(!!f({o_orderkey})){}", "if (f({o_orderkey})) {}"), (K(3, 1), "x=!!!f({o_orderkey})", "x = !f({o_orderkey});"), (K(3, 2), "x=[{o_orderkey}].some(a=>!!a)", "x = [{o_orderkey}].some(a => a);")),
    "js_sequence": RuleQuery(*O, ["sequence"], (K(4, 0), "a(),b({o_orderkey}),c()", "a();\nb({o_orderkey});\nc();"), (K(4, 1), "return a(),{o_orderkey}", "a();\nreturn {o_orderkey};"), (K(4, 2), "if(a(),b)c({o_orderkey})", "a();\nif (b) c({o_orderkey});"), (K(4, 3), "while(a(),{o_orderkey});", "while (a(), {o_orderkey});")),
    "js_split_for_vars": RuleQuery(*O, ["split-for-loop-vars"], (K(2, 0), "for(var a={o_orderkey},i=0;i<9;i++);", "var a = {o_orderkey};\nfor (var i = 0; i < 9; i++);"), (K(2, 1), "for(let a={o_orderkey},i=0;i<9;i++);", "for (let a = {o_orderkey}, i = 0; i < 9; i++);")),
    "js_split_decls": RuleQuery(*O, ["split-variable-declarations"], ("true", "var a={o_orderkey},b,c={o_custkey}", "var a = {o_orderkey};\nvar b;\nvar c = {o_custkey};")),
    "js_string_in_template": RuleQuery(*N, ["string-literal-in-template"], ("true", 'x=`a${"{n_name}"}b${y}`', "x = `a{n_name}b${y}`;")),
    "js_ternary_to_if": RuleQuery(*O, ["ternary-to-if"], (K(2, 0), "a?b({o_orderkey}):c()", "if (a) {\n  b({o_orderkey});\n} else {\n  c();\n}"), (K(2, 1), "return a?{o_orderkey}:c", "if (a) {\n  return {o_orderkey};\n} else {\n  return c;\n}")),
    "js_truncate": RuleQuery(*O, ["truncate-number-literal"], ("true", "x=y|{big}", "x = y | {low};")),
    "js_typeof": RuleQuery(*O, ["typeof-undefined"], (K(2, 0), 'x=typeof a{o_orderkey}>"u"', 'x = typeof a{o_orderkey} === "undefined";'), (K(2, 1), 'x=typeof a{o_orderkey}<"u"', 'x = typeof a{o_orderkey} !== "undefined";')),
    "js_unary_expressions": RuleQuery(*O, ["unary-expressions"], (K(2, 0), "void f({o_orderkey})", "f({o_orderkey});"), (K(2, 1), "return void f({o_orderkey})", "f({o_orderkey});\nreturn;")),
    "js_booleans": RuleQuery(*O, ["unminify-booleans"], (K(4, 0), "x{o_orderkey}=!0", "x{o_orderkey} = true;"), (K(4, 1), "x{o_orderkey}=!1", "x{o_orderkey} = false;"), (K(4, 2), "x{o_orderkey}=!![]", "x{o_orderkey} = true;"), (K(4, 3), "x{o_orderkey}=!{o_orderkey}", "x{o_orderkey} = !{o_orderkey};")),
    "js_void": RuleQuery(*O, ["void-to-undefined"], (K(2, 0), "x{o_orderkey}=void 0", "x{o_orderkey} = undefined;"), (K(2, 1), "function f(undefined){return void 0}", "function f(undefined) {\n  return void 0;\n}")),
    "js_yoda": RuleQuery(*O, ["yoda"], (K(6, 0), "x={o_orderkey}===a", "x = a === {o_orderkey};"), (K(6, 1), "x={o_orderkey}<a", "x = a > {o_orderkey};"), (K(6, 2), "x={o_orderkey}>=a", "x = a <= {o_orderkey};"), (K(6, 3), "x={o_orderkey}-a", "x = {o_orderkey} - a;"), (K(6, 4), "x={o_orderkey}*a", "x = a * {o_orderkey};"), (K(6, 5), "x=a!={o_orderkey}", "x = a != {o_orderkey};")),
    # transpile
    "js_default_parameters": RuleQuery(*O, ["default-parameters"], (K(2, 0), "function f(){var a=arguments.length>0&&arguments[0]!==undefined?arguments[0]:{o_orderkey};g(a)}", "function f(a = {o_orderkey}) {\n  g(a);\n}"), (K(2, 1), "function f(a,b){if(b===undefined){b={o_orderkey}}g(a)}", "function f(a, b = {o_orderkey}) {\n  g(a);\n}")),
    "js_logical_assignments": RuleQuery(*O, ["logical-assignments"], (K(3, 0), "a||(a={o_orderkey})", "a ||= {o_orderkey};"), (K(3, 1), "a.b&&(a.b={o_orderkey})", "a.b &&= {o_orderkey};"), (K(3, 2), "var t;(t=f()).b||(t.b={o_orderkey})", "f().b ||= {o_orderkey};")),
    "js_nullish": RuleQuery(*O, ["nullish-coalescing"], (K(3, 0), "x=a!==null&&a!==undefined?a:{o_orderkey}", "x = a ?? {o_orderkey};"), (K(3, 1), "x=a!=null?a:{o_orderkey}", "x = a ?? {o_orderkey};"), (K(3, 2), "var t;x=(t=f())!==null&&t!==void 0?t:{o_orderkey}", "x = f() ?? {o_orderkey};")),
    "js_nullish_assignment": RuleQuery(*O, ["nullish-coalescing-assignment"], ("true", "a.b??(a.b={o_orderkey})", "a.b ??= {o_orderkey};")),
    "js_optional_chaining": RuleQuery(*O, ["optional-chaining"], (K(2, 0), "x=a===null||a===undefined?undefined:a.b({o_orderkey})", "x = a?.b({o_orderkey});"), (K(2, 1), "var t;x=(t=f({o_orderkey}))===null||t===void 0?void 0:t.b", "x = f({o_orderkey})?.b;")),
    "js_template_literals": RuleQuery(*N, ["template-literals"], ("true", 'x="{n_name}".concat(a,"-{n_nationkey}")', "x = `{n_name}${a}-{n_nationkey}`;")),
    # deobfuscate
    "js_dead_code": RuleQuery(*O, ["dead-code"], (K(3, 0), 'if("a{o_orderkey}"==="a{o_orderkey}"){a()}else{b()}', "a();"), (K(3, 1), 'if("a{o_orderkey}"==="b{o_orderkey}"){a()}else{b({o_orderkey})}', "b({o_orderkey});"), (K(3, 2), 'x="a"!=="b"?{o_orderkey}:0', "x = {o_orderkey};")),
    "js_control_flow_object": RuleQuery(*O, ["control-flow-object"], ("true", 'const o={abcde:function(a,b){return a+b},fghij:function(f,a){return f(a)},klmno:"{o_orderpriority}"};x=o.abcde({o_orderkey},o.klmno);o.fghij(g,{o_custkey})', 'x = {o_orderkey} + "{o_orderpriority}";\ng({o_custkey});')),
    "js_control_flow": RuleQuery(*O, ["control-flow-switch"], ("true", 'function t(){const s="2|0|1".split("|");let i=0;while(true){switch(s[i++]){case"0":b({o_orderkey});continue;case"1":return c;case"2":a({o_custkey});continue}break}}', "function t() {\n  a({o_custkey});\n  b({o_orderkey});\n  return c;\n}")),
    "js_inline_object_props": RuleQuery(*O, ["inline-object-props"], (K(2, 0), 'const o={a:{o_orderkey},b:"{o_orderpriority}"};f(o.a,o.b)', 'f({o_orderkey}, "{o_orderpriority}");'), (K(2, 1), "const o={a:{o_orderkey}};o.a=2;f(o.a)", "const o = {\n  a: {o_orderkey}\n};\no.a = 2;\nf(o.a);")),
    "js_merge_object": RuleQuery(*O, ["merge-object-assignments"], (K(2, 0), 'const o={};o.a={o_orderkey};o["b-c"]="{o_orderpriority}";f(o)', 'f({\n  a: {o_orderkey},\n  "b-c": "{o_orderpriority}"\n});'), (K(2, 1), "const o={};o.a={o_orderkey};g(o);g(o)", "const o = {\n  a: {o_orderkey}\n};\ng(o);\ng(o);")),
    "js_decode_uri": RuleQuery(*N, ["evaluate-globals"], ("true", 'x=decodeURIComponent("{n_name}%20%C3%A9%21")', 'x = "{n_name} é!";')),
    "js_unescape": RuleQuery(*O, ["evaluate-globals"], (K(2, 0), 'x=unescape("%u0041%42-{o_orderkey}")', 'x = "AB-{o_orderkey}";'), (K(2, 1), 'function f(unescape){unescape("%41")}', 'function f(unescape) {\n  unescape("%41");\n}')),
    "js_self_defending": RuleQuery(*O, ["self-defending"], ("true", "const k=function(){let c=true;return function(x,f){const r=c?function(){if(f){const q=f.apply(x,arguments);f=null;return q}}:function(){};c=false;return r}}();k(this,function(){})();g({o_orderkey})", "g({o_orderkey});")),
    "js_debug_protection": RuleQuery(*O, ["debug-protection"], ("true", "function d(r){function e(c){if(c%20===0){debugger}e(++c)}try{if(r){return e}else{e(0)}}catch(x){}}(function(){setInterval(d,4000)})();g({o_orderkey})", "g({o_orderkey});")),
    "js_string_array": RuleQuery(*C, None, ("true", 'function arr(){const s=["{c_mktsegment}","log","{c_name}"];arr=function(){return s};return arr()}function dec(i,k){const a=arr();dec=function(n,m){n=n-100;return a[n]};return dec(i,k)}console[dec(101)](dec(100),dec(102))', 'console.log("{c_mktsegment}", "{c_name}");')),
    "js_string_array_rotated": RuleQuery(*C, None, ("true", '(function(g,n){const d=dec;const a=g();while(true){try{const v=parseInt(d(100));if(v===n)break;else a.push(a.shift())}catch(e){a.push(a.shift())}}})(arr,77);function arr(){const s=["log","{c_name}","77"];arr=function(){return s};return arr()}function dec(i,k){const a=arr();dec=function(n,m){n=n-100;return a[n]};return dec(i,k)}console[dec(101)](dec(102))', 'console.log("{c_name}");')),
    "js_inline_decoder_wrappers": RuleQuery(*C, None, ("true", 'function arr(){const s=["log","{c_name}"];arr=function(){return s};return arr()}function dec(i,k){const a=arr();dec=function(n,m){return a[n]};return dec(i,k)}const q=dec;function w(a,b){return q(b-5,a)}console[w(1,5)](w(2,6))', 'console.log("{c_name}");')),
    # JSX and names
    "js_jsx": RuleQuery(*N, ["jsx"], ("true", 'x=React.createElement("div",{id:"n{n_nationkey}",n:{n_nationkey}},"{n_name}",React.createElement(Foo,null))', 'x = <div id="n{n_nationkey}" n={{n_nationkey}}>{n_name}<Foo /></div>;')),
    "js_jsx_new": RuleQuery(*N, ["jsx-new"], ("true", 'x=jsxs("ul",{children:["{n_name}",jsx(Foo,{n:{n_nationkey}},"k")]})', 'x = <ul>{n_name}<Foo key="k" n={{n_nationkey}} /></ul>;')),
    "js_mangle": RuleQuery(*O, ["mangle"], (K(5, 0), "let q={o_orderkey}", "let vLN{o_orderkey} = {o_orderkey};"), (K(5, 1), "function q(){f({o_orderkey})}", "function f2() {\n  f({o_orderkey});\n}"), (K(5, 2), "class q{}new q({o_orderkey})", "class C {}\nnew C({o_orderkey});"), (K(5, 3), 'const q=require("m{o_orderkey}")', 'const m{o_orderkey} = require("m{o_orderkey}");'), (K(5, 4), "x=(q,r)=>q+r+{o_orderkey}", "x = (p, p2) => p + p2 + {o_orderkey};")),
    # the whole pipeline
    "js_pipeline": RuleQuery(*O, None, ("true", 'var a={o_orderkey}*2,b;"u">typeof c&&(b=void 0,d["e"](!0));', 'var a = {double};\nvar b;\nif (typeof c !== "undefined") {\n  b = undefined;\n  d.e(true);\n}')),
}

#: Columns that templates use beside those of the tables, as (Spark, DuckDB) expressions.
DERIVED = {
    "fold": ("o_orderkey - 2 * o_custkey", "o_orderkey - 2 * o_custkey"),
    "quotient": ("p_partkey div p_size", "p_partkey // p_size"),
    "hexkey": ("lower(hex(o_orderkey))", "lower(to_hex(o_orderkey))"),
    "big": ("o_orderkey * 1000003", "o_orderkey * 1000003"),
    "low": ("((o_orderkey * 1000003 + 2147483648) % 4294967296) - 2147483648", "((o_orderkey * 1000003 + 2147483648) % 4294967296) - 2147483648"),
    "double": ("o_orderkey * 2", "o_orderkey * 2"),
}
