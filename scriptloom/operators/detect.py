"""Detection as relational algebra over the tables of facts.

Inputs are the nodes, bindings and refs tables; every operator is joins,
filters and aggregations on (file_id, ...), so Catalyst plans it, and tables
written by file_id bucket join without a shuffle.  Error rows of these tables
have no node and match nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Literal node types.
LITERALS = ("StringLiteral", "NumericLiteral", "BooleanLiteral", "NullLiteral", "BigIntLiteral", "RegExpLiteral")


def by_sorting(facts: DataFrame) -> DataFrame:
    """Facts to be joined by sorting.

    A program has tens of facts, but the planner takes their table to be as small as that of the programs, and would send
    it whole to the driver and to every executor.
    """
    return facts.hint("merge")


def child(nodes: DataFrame, field: str, prefix: str, idx: int | None = None) -> DataFrame:
    """Children in a field, columns prefixed, keyed by file_id and parent."""
    c = nodes.filter(F.col("field") == field)
    if idx is not None:
        c = c.filter(F.col("idx") == idx)
    return c.select("file_id", F.col("parent_id").alias("node_id"), *[F.col(x).alias(f"{prefix}_{x}") for x in ("node_id", "type", "name", "value", "operator", "attrs")])


def with_child(of: DataFrame, nodes: DataFrame, field: str, prefix: str, how: str = "inner", idx: int | None = None) -> DataFrame:
    return of.join(by_sorting(child(nodes, field, prefix, idx)), ["file_id", "node_id"], how)


def safe_literals(nodes: DataFrame) -> DataFrame:
    """Literals, templates only without expressions."""
    inside = nodes.filter("field = 'expressions'").select("file_id", F.col("parent_id").alias("node_id"))
    return nodes.filter(F.col("type").isin(*LITERALS)).unionByName(nodes.filter("type = 'TemplateLiteral'").join(by_sorting(inside), ["file_id", "node_id"], "left_anti"))


def infinite_loops(nodes: DataFrame) -> DataFrame:
    """for (;;), for (; true;) and while (true), true also as !0."""
    loops = with_child(nodes.filter("type in ('ForStatement', 'WhileStatement')"), nodes, "test", "test", "left")
    other = nodes.filter("field in ('init', 'update')").select("file_id", F.col("parent_id").alias("node_id"))
    loops = loops.join(by_sorting(other), ["file_id", "node_id"], "left_anti")
    zero = child(nodes.filter("type = 'NumericLiteral'"), "argument", "arg").select("file_id", F.col("node_id").alias("test_node_id"), F.col("arg_value"))
    loops = loops.join(by_sorting(zero), ["file_id", "test_node_id"], "left")
    truthy = (F.col("test_type") == "BooleanLiteral") & (F.col("test_value") == "true") | (F.col("test_operator") == "!") & (F.col("arg_value") == "0")
    return loops.filter((F.col("type") == "ForStatement") & F.col("test_node_id").isNull() | truthy).select(*nodes.columns)


def iifes(nodes: DataFrame) -> DataFrame:
    """Calls of anonymous functions where they stand."""
    named = nodes.filter("field = 'id'").select("file_id", F.col("parent_id").alias("callee_node_id"))
    c = with_child(nodes.filter("type = 'CallExpression'"), nodes, "callee", "callee").filter("callee_type in ('FunctionExpression', 'ArrowFunctionExpression')")
    return c.join(by_sorting(named), ["file_id", "callee_node_id"], "left_anti").select(*nodes.columns)


def constant_members(nodes: DataFrame) -> DataFrame:
    """a.b and a["b"]: file_id, node_id, property_name."""
    m = with_child(nodes.filter("type = 'MemberExpression'"), nodes, "property", "p")
    plain = (F.col("attrs")["computed"] == "false") & (F.col("p_type") == "Identifier")
    return m.filter(plain | (F.col("p_type") == "StringLiteral")).select("file_id", "node_id", F.when(plain, F.col("p_name")).otherwise(F.col("p_value")).alias("property_name"))


def calls(nodes: DataFrame) -> DataFrame:
    """file_id, node_id, callee, first argument's type and value."""
    c = with_child(nodes.filter("type = 'CallExpression'"), nodes, "callee", "callee")
    c = with_child(c, nodes, "arguments", "arg", "left", 0)
    return c.select("file_id", "node_id", F.col("callee_name").alias("callee"), F.col("arg_type").alias("arg_type"), F.col("arg_value").alias("arg"))


def read_only_objects(nodes: DataFrame, bindings: DataFrame, refs: DataFrame) -> DataFrame:
    """Constant bindings of which every read is a member's object that is not written, counted or deleted: an anti join with the bad reads."""
    at = nodes.select("file_id", "node_id", F.col("parent_id").alias("m_id"), F.col("field").alias("m_field"))
    parent = nodes.select("file_id", F.col("node_id").alias("m_id"), F.col("type").alias("m_type"), F.col("parent_id").alias("p_id"), F.col("field").alias("p_field"))
    grand = nodes.select("file_id", F.col("node_id").alias("p_id"), F.col("type").alias("p_type"), F.col("operator").alias("p_operator"))
    r = refs.filter("not is_write").join(by_sorting(at), ["file_id", "node_id"]).join(by_sorting(parent), ["file_id", "m_id"]).join(by_sorting(grand), ["file_id", "p_id"], "left")
    member = (F.col("m_type") == "MemberExpression") & (F.col("m_field") == "object")
    written = (F.col("p_type") == "AssignmentExpression") & (F.col("p_field") == "left") | (F.col("p_type") == "UpdateExpression") | (F.col("p_operator") == "delete") | F.col("p_type").isin("ArrayPattern", "RestElement")
    bad = r.filter(~member | F.coalesce(written, F.lit(False))).select("file_id", "binding_id").distinct()
    return bindings.filter("is_constant and n_refs > 0").join(by_sorting(bad), ["file_id", "binding_id"], "left_anti")


def temporaries(bindings: DataFrame, reads: int) -> DataFrame:
    """Bindings written once and read so often: variables without a value of their own, and plain parameters."""
    return bindings.filter((F.col("n_writes") == 1) & (F.col("n_refs") == reads) & F.col("bare"))


def constant_keys(nodes: DataFrame) -> DataFrame:
    """Members of objects and classes with a constant key, as a name or a text: file_id, node_id, type, key."""
    owners = nodes.filter("type in ('ObjectProperty', 'ObjectMethod', 'ClassMethod', 'ClassProperty')")
    k = with_child(owners, nodes, "key", "k")
    plain = (F.coalesce(F.col("attrs")["computed"], F.lit("false")) == "false") & (F.col("k_type") == "Identifier")
    return k.filter(plain | F.col("k_type").isin("StringLiteral", "NumericLiteral")).select("file_id", "node_id", "type", F.when(plain, F.col("k_name")).otherwise(F.col("k_value")).alias("key"))


def constant_properties(nodes: DataFrame) -> DataFrame:
    """Properties of objects with a constant key: file_id, node_id, key, value_type, value."""
    keys = constant_keys(nodes).filter("type = 'ObjectProperty'").drop("type")
    return keys.join(by_sorting(child(nodes, "value", "value").select("file_id", "node_id", "value_type", F.coalesce("value_value", "value_name").alias("value"))), ["file_id", "node_id"])


def anonymous_functions(nodes: DataFrame) -> DataFrame:
    """Arrow functions, and function expressions without a name that are no generators."""
    named = nodes.filter("field = 'id'").select("file_id", F.col("parent_id").alias("node_id"))
    plain = nodes.filter("type = 'FunctionExpression'").filter(F.coalesce(F.col("attrs")["generator"], F.lit("false")) == "false")
    return nodes.filter("type = 'ArrowFunctionExpression'").unionByName(plain.join(by_sorting(named), ["file_id", "node_id"], "left_anti"))


def constants(nodes: DataFrame) -> DataFrame:
    """Spellings of undefined, true and false: file_id, node_id, constant.

    undefined and void 0; true, !0, !!1 and !![]; false and ![].  These are at
    most three nodes deep, so a program's few nodes of these kinds are looked
    at together, and its table of nodes is made once.
    """
    kinds = ("UnaryExpression", "NumericLiteral", "ArrayExpression", "BooleanLiteral")
    some = nodes.filter(F.col("type").isin(*kinds) | (F.col("type") == "Identifier") & (F.col("name") == "undefined") | (F.col("field") == "elements"))

    def spelled(file: int, rows: list[tuple]) -> list[tuple]:
        filled = {parent for _, parent, field, *_ in rows if field == "elements"}
        of = {parent: value or "[]" for node, parent, field, kind, _, value, _ in rows if field == "argument" and (kind == "NumericLiteral" or kind == "ArrayExpression" and node not in filled)}
        denied = {parent: of[node] for node, parent, field, kind, operator, *_ in rows if kind == "UnaryExpression" and operator == "!" and field == "argument" and node in of}
        out = []
        for node, _, _, kind, operator, value, name in rows:
            if kind == "BooleanLiteral":
                out.append((file, node, value))
            elif kind == "Identifier" and name == "undefined":
                out.append((file, node, name))
            elif kind == "UnaryExpression":
                constant = {("void", "0"): "undefined", ("!", "0"): "true", ("!", "[]"): "false"}.get((operator, of.get(node)))
                if constant or operator == "!" and denied.get(node) in ("1", "[]"):
                    out.append((file, node, constant or "true"))
        return out

    facts = some.select("file_id", "node_id", "parent_id", "field", "type", "operator", "value", "name")
    return program_by_program(facts, spelled, {"file_id": "bigint", "node_id": "int", "constant": "string"})


def named_functions(nodes: DataFrame) -> DataFrame:
    """Functions by the name they are declared by, in a declaration or as a variable's value: file_id, node_id (the function), name."""
    declared = with_child(nodes.filter("type = 'FunctionDeclaration'"), nodes, "id", "id").select("file_id", "node_id", F.col("id_name").alias("name"))
    variables = with_child(with_child(nodes.filter("type = 'VariableDeclarator'"), nodes, "id", "id"), nodes, "init", "init")
    held = variables.filter("init_type = 'FunctionExpression' and id_type = 'Identifier'").select("file_id", F.col("init_node_id").alias("node_id"), F.col("id_name").alias("name"))
    return declared.unionByName(held)


def sublists(nodes: DataFrame, types: list[str]) -> DataFrame:
    """Lists (statements, arguments ...) in which nodes of these types stand in this order, others between them: file_id, parent_id, field.

    The first of each type behind the one before is as good as any other, so
    each step is one aggregation and a join on the list.
    """
    at = nodes.filter("idx is not null").select("file_id", "parent_id", "field", "idx", "type")
    found = at.filter(F.col("type") == types[0]).groupBy("file_id", "parent_id", "field").agg(F.min("idx").alias("last"))
    for t in types[1:]:
        further = at.filter(F.col("type") == t).join(by_sorting(found), ["file_id", "parent_id", "field"]).filter("idx > last")
        found = further.groupBy("file_id", "parent_id", "field").agg(F.min("idx").alias("last"))
    return found.drop("last")


def nearest_assignments(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """For each read, the last write before it in the text: an as-of join by a window over both."""
    at = nodes.select("file_id", "node_id", "start")
    both = refs.join(by_sorting(at), ["file_id", "node_id"]).withColumn("write_at", F.when(F.col("is_write"), F.col("start")))
    w = Window.partitionBy("file_id", "binding_id").orderBy("start", F.col("is_write").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("assigned_at", F.last("write_at", ignorenulls=True).over(w)).filter("not is_write").select("file_id", "binding_id", "node_id", "start", "assigned_at")


def anti_read_write(bindings: DataFrame) -> DataFrame:
    """Bindings that nothing reads."""
    return bindings.filter("n_refs = 0")


def node_counts(nodes: DataFrame) -> DataFrame:
    """How many nodes of each type a program has."""
    return nodes.filter("type is not null").groupBy("file_id", "type").agg(F.count(F.lit(1)).alias("n"))


def module_edges(modules: DataFrame) -> DataFrame:
    """file_id, module_id, target id and the name it is required by."""
    return modules.select("file_id", "module_id", F.explode("dependencies").alias("target_id", "name"))


def unresolved(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges whose target is no module of the bundle: a left anti join."""
    return edges.join(by_sorting(modules.select("file_id", F.col("module_id").alias("target_id"))), ["file_id", "target_id"], "left_anti")


def enclosing(nodes: DataFrame, inner: str, outer: str) -> DataFrame:
    """For each node of one type, the innermost node of another around it: file_id, node_id, outer_id.

    Source positions nest, so one walk over a program's nodes of both types in
    the order of the text, with a stack of the open ones, finds them all.  A
    task holds the open nodes of one program at a time.
    """
    some = nodes.filter(F.col("type").isin(inner, outer)).select("file_id", "node_id", "type", F.col("start").alias("s"), F.col("end").alias("e"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []  # (end, node) of the open ones of a program
        for b in batches:
            found = []
            for file, node, kind, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != at:
                    at, stack = file, []
                while stack and stack[-1][0] <= start:
                    stack.pop()
                if kind == inner and stack:
                    found.append((file, node, stack[-1][1]))
                if kind == outer:
                    stack.append((end, node))
            yield made(found, {"file_id": "bigint", "node_id": "int", "outer_id": "int"})

    return by_program(some, "s", F.col("e").desc(), "node_id").mapInArrow(walk, "file_id long, node_id int, outer_id int")


def by_program(facts: DataFrame, *order) -> DataFrame:
    """Each program's facts behind one another in one task, in this order; tasks are not merged by size, as it is the work on rows that takes time."""
    spark = facts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return facts.repartition(parts, "file_id").sortWithinPartitions("file_id", *order)


def program_by_program(facts: DataFrame, f: Callable[[int, list[tuple]], list[tuple]], types: dict[str, str]) -> DataFrame:
    """The rows that f gives for each program's facts; a task holds those of one program at a time."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for b in batches:
            found = []
            for file, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != at:
                    if rows:
                        found += f(at, rows)
                    at, rows = file, []
                rows.append(row)
            yield made(found, types)
        if rows:
            yield made(f(at, rows), types)

    return by_program(facts).mapInArrow(walk, ", ".join(f"{k} {t}" for k, t in types.items()))


def made(rows: list[tuple], types: dict[str, str]) -> pa.RecordBatch:
    """Rows as a batch."""
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, t in zip(columns, types.values(), strict=True)], list(types))


def alias_roots(nodes: DataFrame, bindings: DataFrame, refs: DataFrame) -> DataFrame:
    """For each constant that only names another variable, the variable at the chain's end (file_id, alias, root).

    A program's aliases are a map from variable to variable; following it to
    the end, with what is known kept on the way, is linear.  Aliases that name
    one another in a ring have no root and no row.
    """
    read = refs.filter("not is_write").select("file_id", F.col("binding_id").alias("target"), "node_id")
    init = nodes.filter("field = 'init'").select("file_id", "node_id", F.col("parent_id").alias("declarator"))
    ids = nodes.filter("field = 'id'").select("file_id", F.col("node_id").alias("decl_node_id"), F.col("parent_id").alias("declarator"))
    own = bindings.filter("is_constant").select("file_id", F.col("binding_id").alias("source"), "decl_node_id")
    step = read.join(by_sorting(init), ["file_id", "node_id"]).join(by_sorting(ids), ["file_id", "declarator"]).join(by_sorting(own), ["file_id", "decl_node_id"]).select("file_id", "source", "target")

    def follow(file: int, rows: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        onward, root = dict(rows), {}
        for source in onward:
            way, at = [], source
            while at in onward and at not in root:
                root[at] = None  # on the way; met again, it is a ring
                way.append(at)
                at = onward[at]
            end = root[at] if at in root else at
            root.update(dict.fromkeys(way, end))
        return [(file, s, r) for s, r in root.items() if r is not None]

    ends = program_by_program(step, follow, {"file_id": "bigint", "source": "int", "target": "int"})
    names = bindings.select("file_id", "binding_id", "name")
    return ends.join(by_sorting(names.select("file_id", F.col("binding_id").alias("source"), F.col("name").alias("alias"))), ["file_id", "source"]).join(by_sorting(names.select("file_id", F.col("binding_id").alias("target"), F.col("name").alias("root"))), ["file_id", "target"]).select("file_id", "alias", "root")
