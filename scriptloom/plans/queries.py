"""Named queries over JavaScript and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.functions import columns
from scriptloom.functions.kernels import spread
from scriptloom.operators import detect, programs
from scriptloom.plans.rules import RULE_QUERIES
from scriptloom.sources import readers


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inline scripts of pages as programs; file_id is the page."""
    return readers.inline_scripts(spread(read(spark, sf_dir, "pages"))).select(F.col("page_id").alias("file_id"), "idx", "code")


def inline_scripts(spark, sf_dir):
    return readers.inline_scripts(read(spark, sf_dir, "pages")).select("page_id", "idx", F.col("code").alias("script"))


def call_args(spark, sf_dir):
    """The calls that pages' scripts make, with their numeric argument."""
    found = detect.calls(programs.nodes(scripts(spark, sf_dir)))
    return found.filter("arg_type = 'NumericLiteral'").select(F.col("file_id").alias("page_id"), "callee", F.col("arg").cast("long").alias("arg"))


def node_counts(spark, sf_dir):
    return detect.node_counts(programs.nodes(scripts(spark, sf_dir))).select(F.col("file_id").alias("page_id"), "type", "n")


def results(spark, sf_dir):
    out = programs.rewrite(scripts(spark, sf_dir))
    return out.select(F.col("file_id").alias("page_id"), "code", F.col("error").isNull().alias("ok"))


def made(spark, sf_dir, table, key, text) -> DataFrame:
    return spread(read(spark, sf_dir, table)).select(F.col(key).cast("long").alias("file_id"), F.expr(text).alias("code"))


BINDING_TEXT = r"concat('const a=', c_custkey, ';let b;b=a;b=a+', c_nationkey, ';function f(p){return p+b+a}f(a)')"
OBJECT_TEXT = r"concat('const o={k:', c_custkey, '};f(o.k);', CASE WHEN c_custkey % 3 = 0 THEN 'o.k=1;' WHEN c_custkey % 3 = 1 THEN 'g(o);' ELSE '' END)"
LOOP_TEXT = r"concat(CASE WHEN c_custkey % 4 = 0 THEN 'for(;;)' WHEN c_custkey % 4 = 1 THEN 'while(!0)' WHEN c_custkey % 4 = 2 THEN 'while(a)' ELSE 'for(;a;)' END, '{f(', c_custkey, ')}')"
BUNDLE_TEXT = r"""concat('!function(e){var t={};function n(r){if(t[r])return t[r].exports;var o=t[r]={i:r,l:!1,exports:{}};return e[r].call(o.exports,o,o.exports,n),o.l=!0,o.exports}n(n.s=', c_custkey % 3, ')}([function(e,t,n){e.exports=', c_custkey, '},function(e,t,n){n(0);n(2)},function(e,t,n){n(', c_custkey % 5, ')}]);')"""
BROWSERIFY_TEXT = r"""concat('(function(){})()({1:[function(require,module,exports){require("./b"),require("lib', c_nationkey, '")},{"./b":2,"lib', c_nationkey, '":3}],2:[function(r,m,e){m.exports=', c_custkey, '},{"../c":4}],3:[function(r,m,e){},{}],4:[function(r,m,e){},{}]},{},[1]);')"""


def binding_stats(spark, sf_dir):
    b = programs.bindings(made(spark, sf_dir, "customer", "c_custkey", BINDING_TEXT))
    return b.select(F.col("file_id").alias("id"), "name", "kind", "is_constant", F.col("n_refs").cast("long").alias("n_refs"), F.col("n_writes").cast("long").alias("n_writes"))


def read_only_objects(spark, sf_dir):
    p = made(spark, sf_dir, "customer", "c_custkey", OBJECT_TEXT)
    found = detect.read_only_objects(programs.nodes(p), programs.bindings(p), programs.references(p))
    return found.select(F.col("file_id").alias("id"), "name")


def temporaries(spark, sf_dir):
    text = r"concat('var t;x=(t=f(', c_custkey, '))===null||t', CASE WHEN c_custkey % 2 = 0 THEN '.b' ELSE '' END, ';var u;u=1;', CASE WHEN c_custkey % 3 = 0 THEN 'g(u,u)' ELSE 'g(u)' END, ';var w=1;w=2;g(w)')"
    return detect.temporaries(programs.bindings(made(spark, sf_dir, "customer", "c_custkey", text)), 1).select(F.col("file_id").alias("id"), "name")


def infinite_loops(spark, sf_dir):
    return detect.infinite_loops(programs.nodes(made(spark, sf_dir, "customer", "c_custkey", LOOP_TEXT))).select(F.col("file_id").alias("id"), "type")


def safe_literals(spark, sf_dir):
    text = r"concat('f(', c_custkey, ',\"', c_mktsegment, '\",`a`,`', chr(36), '{b}`,null,!0)')"
    n = detect.safe_literals(programs.nodes(made(spark, sf_dir, "customer", "c_custkey", text)))
    return n.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("file_id").alias("id"), "n")


def iifes(spark, sf_dir):
    text = r"concat(CASE WHEN c_custkey % 3 = 0 THEN '(function(){' WHEN c_custkey % 3 = 1 THEN '(()=>{' ELSE '(function q(){' END, c_custkey, '})()')"
    return detect.iifes(programs.nodes(made(spark, sf_dir, "customer", "c_custkey", text))).select(F.col("file_id").alias("id"), "type")


def constant_members(spark, sf_dir):
    text = r"concat(CASE WHEN c_custkey % 3 = 0 THEN 'o.k' WHEN c_custkey % 3 = 1 THEN 'o[\"k' ELSE 'o[k' END, c_custkey, CASE WHEN c_custkey % 3 = 1 THEN '\"]' WHEN c_custkey % 3 = 2 THEN ']' ELSE '' END)"
    return detect.constant_members(programs.nodes(made(spark, sf_dir, "customer", "c_custkey", text))).select(F.col("file_id").alias("id"), "property_name")


def nearest_assignments(spark, sf_dir):
    """Which of three assignments each of three reads takes."""
    text = r"concat('var a=1', c_custkey, ';f(a);a=2;g(a);a=3;h(a)')"
    p = made(spark, sf_dir, "customer", "c_custkey", text)
    nodes = programs.nodes(p)
    out = detect.nearest_assignments(nodes, programs.references(p))
    return out.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_reads"), F.count("assigned_at").alias("n_assigned"), F.count_distinct("assigned_at").alias("n_sources")).withColumnRenamed("file_id", "id")


def bundle_modules(spark, sf_dir):
    m = programs.modules(made(spark, sf_dir, "customer", "c_custkey", BUNDLE_TEXT))
    return m.select(F.col("file_id").alias("id"), "module_id", "is_entry", "path", "code")


def bundles(spark, sf_dir):
    r = programs.rewrite(made(spark, sf_dir, "customer", "c_custkey", BUNDLE_TEXT))
    return r.select(F.col("file_id").alias("id"), "bundle_type", "entry_id", F.col("n_modules").cast("long").alias("n_modules"))


def dep_paths(spark, sf_dir):
    m = programs.modules(made(spark, sf_dir, "customer", "c_custkey", BROWSERIFY_TEXT))
    return m.select(F.col("file_id").alias("id"), "module_id", "path")


def require_join(spark, sf_dir):
    """Edges of the module graph whose target is in the bundle or not."""
    m = programs.modules(made(spark, sf_dir, "customer", "c_custkey", BROWSERIFY_TEXT))
    e = detect.module_edges(m)
    lost = detect.unresolved(e, m).select("file_id", "target_id", F.lit(True).alias("missing"))
    return e.join(detect.by_sorting(lost), ["file_id", "target_id"], "left").select(F.col("file_id").alias("id"), "module_id", "target_id", "name", F.coalesce("missing", F.lit(False)).alias("missing"))


WEBPACK5_TEXT = r"""concat('(()=>{var m={', c_custkey, ':(e,t,r)=>{r(', c_custkey + 1, ')},', c_custkey + 1, ':e=>{e.exports="', c_mktsegment, '"}};var c={};function q(i){var o=c[i];if(o!==undefined)return o.exports;var x=c[i]={exports:{}};m[i](x,x.exports,q);return x.exports}', CASE WHEN c_custkey % 2 = 0 THEN concat('q(q.s=', c_custkey, ')') ELSE '' END, '})();')"""
CHUNK_TEXT = r"""concat('(self.webpackChunk=self.webpackChunk||[]).push([[', c_custkey, '],{a', c_custkey, ':function(e,t,n){n("b', c_custkey, '")},b', c_custkey, ':function(e){e.exports=', c_nationkey, '}}]);')"""
ESM_TEXT = r"""concat('!function(e){var t={};function n(r){if(t[r])return t[r].exports;var o=t[r]={i:r,l:!1,exports:{}};return e[r].call(o.exports,o,o.exports,n),o.l=!0,o.exports}n(n.s=0)}([function(e,t,n){const a=n(1);const d=n.n(a);f(d())},function(e,t,n){n.r(t);n.d(t,"', CASE WHEN c_custkey % 2 = 0 THEN 'default' ELSE concat('k', c_custkey) END, '",function(){return g});function g(){return ', c_custkey, '}}]);')"""
INJECTION_TEXT = r"""concat('!function(e){var t={};function n(r){if(t[r])return t[r].exports;var o=t[r]={i:r,l:!1,exports:{}};return e[r].call(o.exports,o,o.exports,n),o.l=!0,o.exports}n(n.s=0)}([function(e,t,n){(function(g){g.x=', c_custkey, '}).call(this,n(1))},function(e){}]);')"""


def unpacked(text, options=programs.Options()):
    def query(spark, sf_dir):
        m = programs.modules(made(spark, sf_dir, "customer", "c_custkey", text), options=options)
        return m.select(F.col("file_id").alias("id"), "module_id", "is_entry", "path", "code")

    return query


def mapped_modules(spark, sf_dir):
    """Modules named by what stands in them."""
    options = programs.Options(mappings={"lib/auto.js": lambda n: n.type == "StringLiteral" and n.value == "AUTOMOBILE"})
    return unpacked(WEBPACK5_TEXT, options)(spark, sf_dir).select("id", "module_id", "path")


def plugins(spark, sf_dir):
    """A caller's own step after the rewriting of a program: every string in upper case."""

    def upper(tree, ctx):
        for n in tree.walk():
            if n.type == "StringLiteral":
                n.value = n.value.upper()

    options = programs.Options(plugins={"after_unminify": [upper]})
    p = made(spark, sf_dir, "nation", "n_nationkey", "concat('x=\"', lower(n_name), '\";y=!0')")
    return programs.rewrite(p, options=options).select(F.col("file_id").alias("id"), "code")


def mangle_some(spark, sf_dir):
    """Only names that the predicate wants."""
    options = programs.Options(mangle=lambda name: name.startswith("_0x"), unpack=False)
    p = made(spark, sf_dir, "orders", "o_orderkey", "concat('let _0x', hex(o_orderkey), '=', o_orderkey, ';let keep=2')")
    return programs.rewrite(p, options=options).select(F.col("file_id").alias("id"), "code")


def alias_closure(spark, sf_dir):
    """The variable at the end of a chain of aliases, for every alias: refs joined with bindings, over and over."""
    text = "concat('const d', c_custkey, '=f;const a=d', c_custkey, ';const b=a;const c=b;c(1)')"
    p = made(spark, sf_dir, "customer", "c_custkey", text)
    nodes, b = programs.nodes(p), programs.bindings(p)
    found = detect.alias_roots(nodes, b, programs.references(p))
    return found.select(F.col("file_id").alias("id"), "alias", "root")


def ancestors(spark, sf_dir):
    """The innermost function around each call."""
    text = "concat('function a', c_custkey, '(){b();function c(){d()}}e()')"
    n = programs.nodes(made(spark, sf_dir, "customer", "c_custkey", text))
    return detect.enclosing(n, "CallExpression", "FunctionDeclaration").groupBy("file_id").agg(F.count(F.lit(1)).alias("n_inside"), F.count_distinct("outer_id").alias("n_functions")).withColumnRenamed("file_id", "id")


def unsafe_off(spark, sf_dir):
    """Programs left as they are but for the first stage."""
    options = programs.Options(unminify=False, deobfuscate=False, jsx=False, unpack=False)
    p = made(spark, sf_dir, "orders", "o_orderkey", "concat('if(a)x=!0,y=', o_orderkey)")
    return programs.rewrite(p, options=options).select(F.col("file_id").alias("id"), "code")


def string_array_table(spark, sf_dir):
    text = r"concat('function q(){const s=[\"', c_name, '\",\"', c_mktsegment, '\",undefined];q=function(){return s};return q()}')"
    a = programs.string_arrays(made(spark, sf_dir, "customer", "c_custkey", text))
    return a.select(F.col("file_id").alias("id"), "original_name", F.col("length").cast("long").alias("length"), F.array_join("elements", "|", "undefined").alias("elements"))


def rewrite_counts(spark, sf_dir):
    text = r"concat('x=!0;y=\"a\"+\"', c_mktsegment, '\";', CASE WHEN c_custkey % 2 = 0 THEN 'void f()' ELSE '' END)"
    r = programs.rewrites(made(spark, sf_dir, "customer", "c_custkey", text)).filter("transform in ('unminify-booleans', 'merge-strings', 'unary-expressions')")
    return r.groupBy("transform").agg(F.sum("changes").cast("long").alias("changes"))


def errors(spark, sf_dir):
    text = r"concat('f(', CASE WHEN c_custkey % 7 = 0 THEN '' ELSE ')' END)"
    return programs.rewrite(made(spark, sf_dir, "customer", "c_custkey", text)).select(F.col("file_id").alias("id"), F.col("error").isNotNull().alias("failed"))


def bookmarklets(spark, sf_dir):
    text = r"concat('javascript:', n_name, '%20%3D%201+1%', n_nationkey % 10, 'x')"
    p = readers.bookmarklets(made(spark, sf_dir, "nation", "n_nationkey", text))
    return p.select(F.col("file_id").alias("id"), "code")


def previews(spark, sf_dir):
    text = "repeat(c_mktsegment, 1 + cast(c_custkey % 20 as int))"
    return made(spark, sf_dir, "customer", "c_custkey", text).select(F.col("file_id").alias("id"), columns.preview(F.col("code")).alias("preview"))


def module_paths(spark, sf_dir):
    d = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.col("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, ".js").otherwise("")).alias("m"), (F.col("c_custkey") % 5 == 0).alias("e"))
    return d.select("id", columns.module_path(F.col("m"), F.col("e")).alias("path"))


def path_guard(spark, sf_dir):
    d = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN concat('../', c_name) WHEN c_custkey % 4 = 1 THEN concat('a/..b/', c_name) WHEN c_custkey % 4 = 2 THEN concat('a\\\\..\\\\', c_name) ELSE concat('./', c_name) END").alias("p"))
    return d.select("id", columns.escapes(F.col("p")).alias("escapes"))


def int32(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), columns.to_int32(F.expr("o_orderkey * 1000003 - 2000000000")).alias("v"))


def compact(spark, sf_dir):
    text = r"concat('if (a) {\n  f( ', c_custkey, ' );\n}')"
    return programs.compacted(made(spark, sf_dir, "customer", "c_custkey", text)).select(F.col("file_id").alias("id"), "code")


def sql_fold(spark, sf_dir):
    from scriptloom.functions.sql import register

    register(spark)
    return made(spark, sf_dir, "customer", "c_custkey", "concat(c_custkey, '*2+1')").select(F.col("file_id").alias("id"), F.expr("js_fold(code)").alias("value"))


def facts(text, find, *columns):
    """A detection over the nodes of made programs."""

    def query(spark, sf_dir):
        return find(programs.nodes(made(spark, sf_dir, "customer", "c_custkey", text))).select(F.col("file_id").alias("id"), *columns)

    return query


KEYS_TEXT = r"""concat('x={a', c_custkey, ':1,"b":2,[c]:3,d(){},7:4};class q{e=1;["f"](){}}')"""
FUNCTIONS_TEXT = r"concat('f(function(){},()=>', c_custkey, ',function g(){},function*(){})')"
CONSTANTS_TEXT = r"concat('f(undefined,void 0,void 1', c_custkey, ',!0,!1,!!1,!![],![],true,false)')"
NAMED_TEXT = r"concat('function a', c_custkey, '(){}var b=function(){};let c=()=>1;const d=function e(){}')"
LIST_TEXT = r"concat(CASE WHEN c_custkey % 2 = 0 THEN 'var a=1;' ELSE '' END, 'f(', c_custkey, ');if(a)b();var c')"


def failed_facts(spark, sf_dir):
    """Programs that cannot be read have an error row in every table of facts."""
    p = made(spark, sf_dir, "customer", "c_custkey", r"concat('f(', CASE WHEN c_custkey % 7 = 0 THEN '' ELSE ')' END)")
    tables = {"nodes": programs.nodes, "scopes": programs.scopes, "bindings": programs.bindings, "references": programs.references, "modules": programs.modules, "rewrites": programs.rewrites, "string_arrays": programs.string_arrays}
    out = None
    for name, f in tables.items():
        one = programs.failures(f(p)).select(F.col("file_id").alias("id"), F.lit(name).alias("facts"), F.col("error").startswith("JsSyntaxError").alias("syntax"))
        out = one if out is None else out.unionByName(one)
    return out


def long_chains(spark, sf_dir):
    """Programs with chains of thousands of operators and calls, one after the other."""
    text = "concat('x=y', repeat('+z', 4000 + cast(n_nationkey as int)), ';a', repeat('.b()', 3000), ';s=', repeat('\"q\"+', 2000), '1')"
    r = programs.rewrite(made(spark, sf_dir, "nation", "n_nationkey", text))
    return r.select(F.col("file_id").alias("id"), F.length("code").alias("n_chars"), F.col("error").isNull().alias("ok"))


def sql_scalar(function, text):
    def query(spark, sf_dir):
        from scriptloom.functions.sql import register

        register(spark)
        return made(spark, sf_dir, "customer", "c_custkey", text).select(F.col("file_id").alias("id"), F.expr(f"{function}(code)").alias("code"))

    return query


def sql_table(function, text, *columns):
    def query(spark, sf_dir):
        from scriptloom.functions.sql import register

        register(spark)
        made(spark, sf_dir, "customer", "c_custkey", text).createOrReplaceTempView(f"made_for_{function}")
        return spark.sql(f"SELECT m.file_id AS id, {', '.join(columns)} FROM made_for_{function} m, LATERAL {function}(m.code) f")

    return query


def plugin_stages(spark, sf_dir):
    """A caller's step at each of the five points: each counts the statements that it meets."""

    def counter(mark):
        def f(tree, ctx):
            from scriptloom.js.nodes import call, expr, ident, number

            tree.body.append(expr(call(ident(mark), number(len(tree.body)))))
            tree.body[-1].parent = tree

        return f

    stages = ("after_parse", "after_prepare", "after_deobfuscate", "after_unminify")
    options = programs.Options(plugins={s: [counter(s)] for s in stages}, unpack=False)
    p = made(spark, sf_dir, "nation", "n_nationkey", "concat('a(),b(', n_nationkey, ')')")
    return programs.rewrite(p, options=options).select(F.col("file_id").alias("id"), "code")


def other_sandbox(spark, sf_dir):
    """Decoders evaluated by a caller's own sandbox: here one that knows the answer is upper case."""
    import re

    def sandbox(code: str) -> list:
        return [x.upper() for x in re.findall(r'"(segment_[^"]*)"', code)][:1]

    text = r"""concat('function arr(){const s=["segment_', lower(c_mktsegment), '"];arr=function(){return s};return arr()}function dec(i){i=i-0;return arr()[i]}f(dec(0))')"""
    p = made(spark, sf_dir, "customer", "c_custkey", text)
    return programs.rewrite(p, options=programs.Options(sandbox=sandbox)).select(F.col("file_id").alias("id"), F.col("code").contains("SEGMENT_").alias("by_sandbox"), F.col("error").isNull().alias("ok"))


ATTRIBUTES_TEXT = r"""concat('import a from"./x', c_custkey, '.json"with{type:"json"};export*from"./y.css"assert{type:"css"};using u=f(a)')"""
DECORATORS_TEXT = r"""concat('@one @two.b(', c_custkey, ')class A{@three m(){}@four static x=!0}export default@five class{}')"""
BROKEN_TEXT = r"""concat('x=!0;', chr(10), 'f(', CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ')' END, ';', chr(10), 'function g(){y=!1;', CASE WHEN c_custkey % 3 = 0 THEN 'z=];' ELSE '' END, 'h(', c_custkey, ')}')"""


def rewritten(text, **options):
    def query(spark, sf_dir):
        r = programs.rewrite(made(spark, sf_dir, "customer", "c_custkey", text), options=programs.Options(unpack=False, **options))
        return r.select(F.col("file_id").alias("id"), "code", F.col("error").isNull().alias("whole"))

    return query


def title_cases(spark, sf_dir):
    d = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", F.lower("p_type"), F.lit("a-b"), F.col("p_size").cast("string")).alias("t"))
    return d.select("id", columns.title_case(F.col("t")).alias("title"))


def identifiers(spark, sf_dir):
    d = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey % 4 = 0 THEN concat('_', p_size) WHEN p_partkey % 4 = 1 THEN concat(p_size, 'a') WHEN p_partkey % 4 = 2 THEN concat('a-', p_size) ELSE concat(chr(36), 'x', p_size) END").alias("t"))
    return d.select("id", columns.identifier_test(F.col("t")).alias("ok"))


QUERIES = {
    "js_constant_keys": facts(KEYS_TEXT, detect.constant_keys, "type", "key"), "js_constant_properties": facts(KEYS_TEXT, detect.constant_properties, "key", "value_type", "value"),
    "js_anonymous_functions": facts(FUNCTIONS_TEXT, detect.anonymous_functions, "type"), "js_constants": facts(CONSTANTS_TEXT, detect.constants, "constant"), "js_named_functions": facts(NAMED_TEXT, detect.named_functions, "name"),
    "js_sublists": facts(LIST_TEXT, lambda n: detect.sublists(n, ["VariableDeclaration", "IfStatement", "VariableDeclaration"]), "field"), "js_failed_facts": failed_facts, "js_long_chains": long_chains,
    "js_sql_unminify": sql_scalar("js_unminify", "concat('x=!0;y=void 0;z=', c_custkey)"), "js_sql_deobfuscate": sql_scalar("js_deobfuscate", r"concat('f(decodeURIComponent(\"%41\"),', c_custkey, ')')"), "js_sql_mangle": sql_scalar("js_mangle", "concat('let q=', c_custkey)"),
    "js_sql_nodes": sql_table("js_nodes", "concat('f(', c_custkey, ')')", "f.node_id", "f.parent_id", "f.type", "f.name", "f.value"), "js_sql_modules": sql_table("js_modules", CHUNK_TEXT, "f.bundle_type", "f.module_id", "f.path"),
    "js_sql_string_array": sql_table("js_string_array", r"concat('function q(){const s=[\"', c_name, '\",\"', c_mktsegment, '\"];q=function(){return s};return q()}')", "f.idx", "f.value"),
    "js_import_attributes": rewritten(ATTRIBUTES_TEXT), "js_decorators": rewritten(DECORATORS_TEXT), "js_recovery": rewritten(BROKEN_TEXT, recover=True),
    "js_plugin_stages": plugin_stages, "js_sandbox": other_sandbox, "js_title_case": title_cases, "js_identifiers": identifiers,
    "js_call_args": call_args, "js_inline_scripts": inline_scripts, "js_node_counts": node_counts, "js_results": results, "js_binding_stats": binding_stats, "js_read_only_objects": read_only_objects,
    "js_temporaries": temporaries, "js_infinite_loops": infinite_loops, "js_safe_literals": safe_literals, "js_iifes": iifes, "js_constant_members": constant_members, "js_nearest_assignments": nearest_assignments,
    "js_bundle_modules": bundle_modules, "js_bundles": bundles, "js_dep_paths": dep_paths, "js_require_join": require_join, "js_string_array_table": string_array_table, "js_rewrite_counts": rewrite_counts,
    "js_errors": errors, "js_bookmarklets": bookmarklets, "js_previews": previews, "js_module_paths": module_paths, "js_path_guard": path_guard, "js_int32": int32, "js_compact": compact, "js_sql_fold": sql_fold,
    "js_webpack5_modules": unpacked(WEBPACK5_TEXT), "js_chunk_modules": unpacked(CHUNK_TEXT), "js_esm_modules": unpacked(ESM_TEXT), "js_var_injections": unpacked(INJECTION_TEXT), "js_mappings": mapped_modules,
    "js_plugins": plugins, "js_mangle_some": mangle_some, "js_inline_aliases": alias_closure, "js_enclosing_functions": ancestors, "js_prepare_only": unsafe_off,
    **RULE_QUERIES,
}

ORACLES = {
    "js_constant_keys": "SELECT c_custkey AS id, t.t AS type, CASE WHEN t.k = 'a' THEN 'a' || c_custkey ELSE t.k END AS key FROM customer, (VALUES ('ObjectProperty', 'a'), ('ObjectProperty', 'b'), ('ObjectMethod', 'd'), ('ObjectProperty', '7'), ('ClassProperty', 'e'), ('ClassMethod', 'f')) t(t, k)",
    "js_constant_properties": "SELECT c_custkey AS id, CASE WHEN t.k = 'a' THEN 'a' || c_custkey ELSE t.k END AS key, 'NumericLiteral' AS value_type, t.v AS value FROM customer, (VALUES ('a', '1'), ('b', '2'), ('7', '4')) t(k, v)",
    "js_anonymous_functions": "SELECT c_custkey AS id, t.t AS type FROM customer, (VALUES ('FunctionExpression'), ('ArrowFunctionExpression')) t(t)",
    "js_constants": "SELECT c_custkey AS id, t.c AS constant FROM customer, (VALUES ('undefined'), ('undefined'), ('true'), ('true'), ('true'), ('false'), ('false'), ('true'), ('false')) t(c)",
    "js_named_functions": "SELECT c_custkey AS id, CASE WHEN t.n = 'a' THEN 'a' || c_custkey ELSE t.n END AS name FROM customer, (VALUES ('a'), ('b'), ('d')) t(n)",
    "js_sublists": "SELECT c_custkey AS id, 'body' AS field FROM customer WHERE c_custkey % 2 = 0",
    "js_failed_facts": "SELECT c_custkey AS id, t.f AS facts, true AS syntax FROM customer, (VALUES ('nodes'), ('scopes'), ('bindings'), ('references'), ('modules'), ('rewrites'), ('string_arrays')) t(f) WHERE c_custkey % 7 = 0",
    "js_long_chains": "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(length('x = y') + (4000 + n_nationkey) * length(' + z') + length(';') + 1 + length('a') + 3000 * length('.b()') + length(';') + 1 + length('s = \"') + 2000 + length('1\";') AS INTEGER) AS n_chars, true AS ok FROM nation",
    "js_sql_unminify": "SELECT c_custkey AS id, 'x = true;' || chr(10) || 'y = undefined;' || chr(10) || 'z = ' || c_custkey || ';' AS code FROM customer",
    "js_sql_deobfuscate": "SELECT c_custkey AS id, 'f(\"A\", ' || c_custkey || ');' AS code FROM customer",
    "js_sql_mangle": "SELECT c_custkey AS id, 'let vLN' || c_custkey || ' = ' || c_custkey || ';' AS code FROM customer",
    "js_sql_nodes": "SELECT c_custkey AS id, CAST(t.i AS INTEGER) AS node_id, CAST(t.p AS INTEGER) AS parent_id, t.t AS type, t.n AS name, CASE WHEN t.i = 4 THEN CAST(c_custkey AS VARCHAR) END AS value FROM customer, (VALUES (0, NULL, 'Program', NULL), (1, 0, 'ExpressionStatement', NULL), (2, 1, 'CallExpression', NULL), (3, 2, 'Identifier', 'f'), (4, 2, 'NumericLiteral', NULL)) t(i, p, t, n)",
    "js_sql_modules": "SELECT c_custkey AS id, 'webpack' AS bundle_type, m || c_custkey AS module_id, './' || m || c_custkey || '.js' AS path FROM customer, (VALUES ('a'), ('b')) t(m)",
    "js_sql_string_array": "SELECT c_custkey AS id, CAST(0 AS INTEGER) AS idx, c_name AS value FROM customer UNION ALL SELECT c_custkey, 1, c_mktsegment FROM customer",
    "js_import_attributes": """SELECT c_custkey AS id, 'import a from "./x' || c_custkey || '.json" with { type: "json" };' || chr(10) || 'export * from "./y.css" with { type: "css" };' || chr(10) || 'using u = f(a);' AS code, true AS whole FROM customer""",
    "js_decorators": "SELECT c_custkey AS id, concat_ws(chr(10), '@one', '@two.b(' || c_custkey || ')', 'class A {', '  @three', '  m() {}', '  @four', '  static x = true;', '}', 'export default @five', 'class {}') AS code, true AS whole FROM customer",
    "js_recovery": "SELECT c_custkey AS id, concat_ws(chr(10), 'x = true;', CASE WHEN c_custkey % 2 = 0 THEN 'f(;' ELSE 'f();' END, 'function g() {', '  y = false;', CASE WHEN c_custkey % 3 = 0 THEN '  z=];' END, '  h(' || c_custkey || ');', '}') AS code, c_custkey % 2 <> 0 AND c_custkey % 3 <> 0 AS whole FROM customer",
    "js_plugin_stages": "SELECT CAST(n_nationkey AS BIGINT) AS id, 'a();' || chr(10) || 'b(' || n_nationkey || ');' || chr(10) || 'after_parse(1);' || chr(10) || 'after_prepare(3);' || chr(10) || 'after_deobfuscate(4);' || chr(10) || 'after_unminify(5);' AS code FROM nation",
    "js_sandbox": "SELECT c_custkey AS id, true AS by_sandbox, true AS ok FROM customer",
    "js_title_case": "SELECT p_partkey AS id, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), '') || 'Ab' || p_size AS title FROM part",
    "js_identifiers": "SELECT p_partkey AS id, p_partkey % 4 IN (0, 3) AS ok FROM part",
    "js_call_args": r"SELECT page_id, 'track' AS callee, CAST(regexp_extract(html, 'track\((\d+)\)', 1) AS BIGINT) AS arg FROM pages",
    "js_inline_scripts": r"SELECT page_id, CAST(unnest(range(len(s))) AS INTEGER) AS idx, unnest(s) AS script FROM (SELECT page_id, regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS s FROM pages)",
    "js_node_counts": "SELECT page_id, t.type, CAST(t.n AS BIGINT) AS n FROM pages, (VALUES ('Program', 1), ('VariableDeclaration', 1), ('VariableDeclarator', 1), ('Identifier', 2), ('StringLiteral', 1), ('ExpressionStatement', 1), ('CallExpression', 1), ('NumericLiteral', 1)) t(type, n)",
    "js_results": r"""SELECT page_id, 'var t = "</p>";' || chr(10) || 'track(' || regexp_extract(html, 'track\((\d+)\)', 1) || ');' AS code, true AS ok FROM pages""",
    "js_binding_stats": "SELECT c_custkey AS id, t.name, t.kind, t.c AS is_constant, CAST(t.r AS BIGINT) AS n_refs, CAST(t.w AS BIGINT) AS n_writes FROM customer, (VALUES ('a', 'const', true, 4, 0), ('b', 'let', false, 1, 2), ('f', 'hoisted', true, 1, 0), ('p', 'param', true, 1, 0)) t(name, kind, c, r, w)",
    "js_read_only_objects": "SELECT c_custkey AS id, 'o' AS name FROM customer WHERE c_custkey % 3 = 2",
    "js_temporaries": "SELECT c_custkey AS id, 't' AS name FROM customer UNION ALL SELECT c_custkey, 'u' FROM customer WHERE c_custkey % 3 <> 0",
    "js_infinite_loops": "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'ForStatement' ELSE 'WhileStatement' END AS type FROM customer WHERE c_custkey % 4 < 2",
    "js_safe_literals": "SELECT c_custkey AS id, CAST(5 AS BIGINT) AS n FROM customer",
    "js_iifes": "SELECT c_custkey AS id, 'CallExpression' AS type FROM customer WHERE c_custkey % 3 < 2",
    "js_constant_members": "SELECT c_custkey AS id, 'k' || c_custkey AS property_name FROM customer WHERE c_custkey % 3 < 2",
    "js_nearest_assignments": "SELECT c_custkey AS id, CAST(3 AS BIGINT) AS n_reads, CAST(2 AS BIGINT) AS n_assigned, CAST(2 AS BIGINT) AS n_sources FROM customer",
    "js_bundle_modules": """SELECT c_custkey AS id, CAST(m AS VARCHAR) AS module_id, m = c_custkey % 3 AS is_entry, CASE WHEN m = c_custkey % 3 THEN './index.js' ELSE './' || m || '.js' END AS path,
        CASE WHEN m = 0 THEN 'module.exports = ' || c_custkey || ';'
             WHEN m = 1 THEN 'require("' || CASE WHEN c_custkey % 3 = 0 THEN './index.js' ELSE './0.js' END || '");' || chr(10) || 'require("' || CASE WHEN c_custkey % 3 = 2 THEN './index.js' ELSE './2.js' END || '");'
             ELSE 'require(' || CASE WHEN c_custkey % 5 > 2 THEN '/*missing*/' ELSE '' END || '"' || CASE WHEN c_custkey % 5 = c_custkey % 3 THEN './index.js' ELSE './' || (c_custkey % 5) || '.js' END || '");' END AS code
        FROM customer, range(3) t(m)""",
    "js_bundles": "SELECT c_custkey AS id, 'webpack' AS bundle_type, CAST(c_custkey % 3 AS VARCHAR) AS entry_id, CAST(3 AS BIGINT) AS n_modules FROM customer",
    "js_dep_paths": "SELECT c_custkey AS id, t.m AS module_id, CASE t.m WHEN '1' THEN 'tmp0/index.js' WHEN '2' THEN 'tmp0/b.js' WHEN '3' THEN 'node_modules/lib' || c_nationkey || '/index.js' ELSE 'c.js' END AS path FROM customer, (VALUES ('1'), ('2'), ('3'), ('4')) t(m)",
    "js_require_join": "SELECT c_custkey AS id, t.m AS module_id, t.g AS target_id, CASE t.g WHEN '3' THEN 'lib' || c_nationkey ELSE t.n END AS name, false AS missing FROM customer, (VALUES ('1', '2', './b'), ('1', '3', ''), ('2', '4', '../c')) t(m, g, n)",
    "js_string_array_table": "SELECT c_custkey AS id, 'q' AS original_name, CAST(3 AS BIGINT) AS length, c_name || '|' || c_mktsegment || '|undefined' AS elements FROM customer",
    "js_rewrite_counts": "SELECT 'unminify-booleans' AS transform, count(*) AS changes FROM customer UNION ALL SELECT 'merge-strings', count(*) FROM customer UNION ALL SELECT 'unary-expressions', count(*) FROM customer WHERE c_custkey % 2 = 0",
    "js_errors": "SELECT c_custkey AS id, c_custkey % 7 = 0 AS failed FROM customer",
    "js_bookmarklets": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name || ' = 1+1%' || (n_nationkey % 10) || 'x' AS code FROM nation",
    "js_previews": "SELECT c_custkey AS id, CASE WHEN length(r) <= 100 THEN r ELSE substr(r, 1, 70) || ' … ' || right(r, 30) END AS preview FROM (SELECT c_custkey, repeat(c_mktsegment, 1 + c_custkey % 20) AS r FROM customer)",
    "js_module_paths": "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN './index.js' ELSE './' || c_custkey || '.js' END AS path FROM customer",
    "js_path_guard": "SELECT c_custkey AS id, c_custkey % 4 IN (0, 2) AS escapes FROM customer",
    "js_int32": "SELECT o_orderkey AS id, ((o_orderkey * 1000003 - 2000000000 + 2147483648 + 4294967296) % 4294967296) - 2147483648 AS v FROM orders",
    "js_compact": "SELECT c_custkey AS id, 'if(a){f(' || c_custkey || ');}' AS code FROM customer",
    "js_sql_fold": "SELECT c_custkey AS id, CAST(c_custkey * 2 + 1 AS VARCHAR) AS value FROM customer",
    "js_webpack5_modules": """SELECT c_custkey AS id, CAST(c_custkey + m AS VARCHAR) AS module_id, m = 0 AND c_custkey % 2 = 0 AS is_entry, CASE WHEN m = 0 AND c_custkey % 2 = 0 THEN './index.js' ELSE './' || (c_custkey + m) || '.js' END AS path,
        CASE WHEN m = 0 THEN 'require("./' || (c_custkey + 1) || '.js");' ELSE 'module.exports = "' || c_mktsegment || '";' END AS code FROM customer, range(2) t(m)""",
    "js_chunk_modules": """SELECT c_custkey AS id, m || c_custkey AS module_id, false AS is_entry, './' || m || c_custkey || '.js' AS path,
        CASE WHEN m = 'a' THEN 'require("./b' || c_custkey || '.js");' ELSE 'module.exports = ' || c_nationkey || ';' END AS code FROM customer, (VALUES ('a'), ('b')) t(m)""",
    "js_esm_modules": """SELECT c_custkey AS id, CAST(m AS VARCHAR) AS module_id, m = 0 AS is_entry, CASE WHEN m = 0 THEN './index.js' ELSE './1.js' END AS path,
        CASE WHEN m = 0 THEN 'const a = require("./1.js");' || chr(10) || 'const d = a.default;' || chr(10) || 'f(d);'
             ELSE 'export ' || CASE WHEN c_custkey % 2 = 0 THEN 'default function g' ELSE 'function k' || c_custkey END || '() {' || chr(10) || '  return ' || c_custkey || ';' || chr(10) || '}' END AS code FROM customer, range(2) t(m)""",
    "js_var_injections": """SELECT c_custkey AS id, CAST(m AS VARCHAR) AS module_id, m = 0 AS is_entry, CASE WHEN m = 0 THEN './index.js' ELSE './1.js' END AS path,
        CASE WHEN m = 0 THEN 'var g = require("./1.js");' || chr(10) || 'g.x = ' || c_custkey || ';' ELSE '' END AS code FROM customer, range(2) t(m)""",
    "js_mappings": """SELECT c_custkey AS id, CAST(c_custkey + m AS VARCHAR) AS module_id, CASE WHEN m = 1 AND c_mktsegment = 'AUTOMOBILE' THEN './lib/auto.js' WHEN m = 0 AND c_custkey % 2 = 0 THEN './index.js' ELSE './' || (c_custkey + m) || '.js' END AS path FROM customer, range(2) t(m)""",
    "js_plugins": """SELECT CAST(n_nationkey AS BIGINT) AS id, 'x = "' || upper(n_name) || '";' || chr(10) || 'y = true;' AS code FROM nation""",
    "js_mangle_some": "SELECT o_orderkey AS id, 'let vLN' || o_orderkey || ' = ' || o_orderkey || ';' || chr(10) || 'let keep = 2;' AS code FROM orders",
    "js_inline_aliases": "SELECT c_custkey AS id, a AS alias, 'd' || c_custkey AS root FROM customer, (VALUES ('a'), ('b'), ('c')) t(a)",
    "js_enclosing_functions": "SELECT c_custkey AS id, CAST(2 AS BIGINT) AS n_inside, CAST(2 AS BIGINT) AS n_functions FROM customer",
    "js_prepare_only": "SELECT o_orderkey AS id, 'if (a) {' || chr(10) || '  x = !0;' || chr(10) || '  y = ' || o_orderkey || ';' || chr(10) || '}' AS code FROM orders",
    **{k: q.oracle() for k, q in RULE_QUERIES.items()},
}
