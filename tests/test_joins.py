"""Tables of facts are never sent whole to the driver."""

import pytest

from scriptloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"

JOINS = ["js_nearest_assignments", "js_read_only_objects", "js_require_join", "js_constant_properties", "js_inline_aliases", "js_enclosing_functions", "js_constants"]


@pytest.mark.parametrize("name", JOINS)
def test_facts_are_not_broadcast(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "FlatMapGroupsInPandas" not in plan


def test_spellings_of_constants(spark):
    """Nested, in lists, and beside what only looks like them; the table of nodes is made once."""
    from scriptloom.operators import detect, programs

    code = "f(undefined,void 0,void 1,!0,!1,!!1,!!0,![],!![],!!!1,![1],!![,],[undefined,[!0]],-0,!-1,o.undefined,true,!false)"
    p = spark.createDataFrame([(1, code), (2, ""), (3, "f("), (4, "x=[]")], "file_id long, code string")
    found = detect.constants(programs.nodes(p))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    nodes = {(r.file_id, r.node_id): r for r in programs.nodes(p).collect()}
    got = sorted((code[n.start : n.end], r.constant) for r in found.collect() for n in [nodes[r.file_id, r.node_id]])
    want = [("undefined", "undefined")] * 3 + [("void 0", "undefined"), ("!0", "true"), ("!0", "true"), ("!0", "true"), ("!!1", "true"), ("!!1", "true"), ("![]", "false"), ("![]", "false"), ("!![]", "true"), ("true", "true"), ("false", "false")]
    assert got == sorted([*want, ("![,]", "false"), ("!![,]", "true")])
