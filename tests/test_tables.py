"""The engine on Spark: kernels, tables, detection, SQL functions, sources, sinks, streaming."""

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptloom.functions import sql
from scriptloom.operators import detect, programs
from scriptloom.plans.queries import ORACLES, QUERIES
from scriptloom.sources import readers, sinks
from scriptloom.streaming.rewriting import arriving_files, rewrite_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def some(spark):
    return spark.createDataFrame([(1, "x=!0"), (2, "f("), (3, None), (4, "var a=1;g(a)")], "file_id long, code string").selectExpr("*", "'z' as error", "1 as type")


def test_one_bad_program_does_not_fail_the_job(some):
    got = {r.file_id: (r.code, r.error is None) for r in programs.rewrite(some).collect()}
    assert got == {1: ("x = true;", True), 2: (None, False), 3: ("", True), 4: ("var a = 1;\ng(a);", True)}
    assert programs.rewrite(some.limit(0)).count() == 0


def test_tables_fit_together(some):
    tables = [f(some) for f in (programs.nodes, programs.bindings, programs.references, programs.scopes)]
    assert [[(r.file_id, r.error[:13]) for r in programs.failures(t).collect()] for t in tables] == [[(2, "JsSyntaxError")]] * 4
    nodes, bindings, refs, scopes = (t.filter("error is null").drop("error").cache() for t in tables)
    assert nodes.filter("parent_id is null").count() == 3
    assert nodes.join(nodes.select("file_id", F.col("node_id").alias("parent_id")), ["file_id", "parent_id"], "left_anti").filter("parent_id is not null").count() == 0
    assert [(r.name, r.kind, r.n_refs) for r in bindings.collect()] == [("a", "var", 1)]
    assert refs.join(nodes, ["file_id", "node_id"]).first().name == "a"
    assert scopes.count() == 3
    assert detect.node_counts(nodes).filter("type = 'Program'").count() == 3
    assert detect.anti_read_write(bindings).count() == 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_oracles(spark, name):
    c = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[k] for k in columns)) for r in df.collect())
    found = c.execute(ORACLES[name])
    at = [[d[0] for d in found.description].index(k) for k in columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["js_results"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan
    assert "CartesianProduct" not in plan


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("select js_unminify('x=!0') a, js_fold('2*3+1') b, js_mangle('let q=1') c, js_deobfuscate('f(') d, js_unminify(null) e").first()
    assert tuple(r) == ("x = true;", "7", "let vLN1 = 1;", None, None)
    assert spark.sql("select count(*) n from js_nodes('f(1)') where type = 'NumericLiteral'").first().n == 1
    assert [tuple(x) for x in spark.sql("select * from js_string_array('function q(){const s=[\"a\",\"b\"];q=function(){return s};return q()}')").collect()] == [(0, "a"), (1, "b")]
    assert spark.sql("select count(*) n from js_modules('f(')").first().n == 0


def test_files_in_and_results_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.js").write_text("x=!0\ny=!1")
    out = programs.rewrite(readers.read_files(spark, str(tmp_path / "in")))
    sinks.save_table(out, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().code == "x = true;\ny = false;"
    with pytest.raises(Exception, match="exists"):
        sinks.save_table(out, str(tmp_path / "out"))
    sinks.save_table(out, str(tmp_path / "out"), force=True)
    assert readers.from_texts(spark, ["a", "b"]).count() == 2


def test_guard_of_module_paths(spark, tmp_path):
    bad = spark.createDataFrame([(1, "../x.js", "c")], "file_id long, path string, code string")
    with pytest.raises(sinks.UnsafePath):
        sinks.save_modules(bad, str(tmp_path / "m"))
    assert not (tmp_path / "m").exists()
    sinks.save_modules(bad.withColumn("path", F.lit("./x.js")), str(tmp_path / "m"))
    assert (tmp_path / "m" / "file_id=1").exists()


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.js").write_text("x=!0")
    q = rewrite_stream(arriving_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().code == "x = true;"


def test_a_program_that_takes_too_long_has_an_error(some):
    import time

    from scriptloom.functions.kernels import TimeBudgetError, per_program, within

    with pytest.raises(TimeBudgetError), within(0.05):
        time.sleep(2)
    with within(5):
        pass

    def slow(code):
        time.sleep(20 if "g(a)" in code else 0)
        return [(len(code),)]

    got = {r.file_id: (r.n, r.error) for r in per_program(some, "file_id", "code", "n int", slow, seconds=0.5).collect()}
    assert got == {1: (4, None), 2: (2, None), 3: (0, None), 4: (None, "TimeBudgetError: more than 0.5 seconds")}


def test_aliases_of_any_length_and_rings(spark):
    chain = "const a0=f;" + "".join(f"const a{i + 1}=a{i};" for i in range(200)) + "const p=q,q=p;"
    p = spark.createDataFrame([(1, "var f=1;" + chain)], "file_id long, code string")
    got = {r.alias: r.root for r in detect.alias_roots(programs.nodes(p), programs.bindings(p), programs.references(p)).collect()}
    assert got == {f"a{i}": "f" for i in range(201)}


def test_enclosing_functions_of_many_calls(spark):
    code = "a();" * 300 + "function f(){" + "b();" * 300 + "function g(){c()}d()}" + "e();function h(){}i()"
    p = spark.createDataFrame([(1, code)], "file_id long, code string")
    nodes = programs.nodes(p).cache()
    got = detect.enclosing(nodes, "CallExpression", "FunctionDeclaration").groupBy("outer_id").count().collect()
    assert sorted(r["count"] for r in got) == [1, 301]


def test_files_to_files(spark, tmp_path):
    """Read from a folder, rewritten, saved and read back."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.js").write_text("x=!0")
    (folder / "two.js").write_text("f(void 0)")
    out = programs.rewrite(readers.read_files(spark, f"file://{folder}"))
    sinks.save_table(out, f"file://{tmp_path}/out")
    saved = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(r.code for r in saved.collect()) == ["f(undefined);", "x = true;"]
