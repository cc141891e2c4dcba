"""Operators on a table of programs: rewriting, and the tables of facts.

All take a DataFrame with an identifier (long) and a text column and give one
of the tables below and a last column error; none shuffles.  A program that
cannot be read, or takes too long, has one row with nulls and an error in each
table: failures() gives these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from scriptloom.functions.kernels import per_program
from scriptloom.js.pipeline import Options

RESULTS = "code string, bundle_type string, entry_id string, n_modules int"
NODES = "node_id int, parent_id int, field string, idx int, type string, name string, value string, operator string, start int, `end` int, depth int, scope_id int, attrs map<string,string>"
SCOPES = "scope_id int, parent_scope_id int, kind string, node_id int"
BINDINGS = "binding_id int, scope_id int, name string, kind string, decl_node_id int, is_constant boolean, n_refs int, n_writes int, bare boolean"
REFS = "binding_id int, node_id int, is_write boolean"
MODULES = "bundle_type string, module_id string, is_entry boolean, path string, code string, dependencies map<string,string>"
REWRITES = "transform string, changes int"


def shareable(options: Options) -> bool:
    """Whether programs may share runs: not where a caller's own code reads the tree, or parts stay as their text."""
    return not (options.plugins or options.mappings or options.sandbox or options.recover or callable(options.mangle))


def rewrite(df: DataFrame, id_column: str = "file_id", code_column: str = "code", options: Options = Options()) -> DataFrame:
    """The whole pipeline: file_id, code, bundle_type, entry_id, n_modules, error.

    With the option recover, a program of which parts cannot be read has both a code and an error.
    """

    def f(code: str) -> list[tuple]:
        from scriptloom.js.pipeline import rewrite as run

        r = run(code, options)
        b = r.bundle
        return [(r.code, b and b.type, b and b.entry_id, len(b.modules) if b else None, "; ".join(r.errors)[:500] or None)]

    return per_program(df, id_column, code_column, RESULTS, f, reuse=shareable(options))


def transform(df: DataFrame, names: list[str], id_column: str = "file_id", code_column: str = "code") -> DataFrame:
    """Only the named rules, in one pass: file_id, code, error."""

    def f(code: str) -> list[tuple]:
        from scriptloom.js.pipeline import transform as run

        return [(run(code, names),)]

    return per_program(df, id_column, code_column, "code string", f, reuse=True)


def compacted(df: DataFrame, id_column: str = "file_id", code_column: str = "code") -> DataFrame:
    """Parsed and printed without needless space."""

    def f(code: str) -> list[tuple]:
        from scriptloom.js.parser import parse
        from scriptloom.js.printer import to_code

        return [(to_code(parse(code), compact=True),)]

    return per_program(df, id_column, code_column, "code string", f)


def _analysed(code: str):
    """(program, ids of nodes, scopes, ids of scopes)."""
    from scriptloom.js.parser import parse
    from scriptloom.js.scope import Scopes

    tree = parse(code)
    ids = {id(n): i for i, n in enumerate(tree.walk())}
    scopes = Scopes(tree)
    order = sorted(scopes.of_node.values(), key=lambda s: ids[id(s.node)])
    return tree, ids, scopes, {id(s): i for i, s in enumerate(order)}


def failures(table: DataFrame) -> DataFrame:
    """Identifier and error of the programs that a table has none but an error row of."""
    return table.filter("error is not null").select(table.columns[0], "error")


def nodes(df: DataFrame, id_column: str = "file_id", code_column: str = "code") -> DataFrame:
    """A row for each syntax node, numbered in source order."""

    def f(code: str) -> list[tuple]:
        from scriptloom.js.numbers import to_text

        tree, ids, scopes, scope_ids = _analysed(code)
        depth, out = {id(tree): 0}, []
        place: dict[int, tuple] = {}
        for n in tree.walk():
            for k, v in n.__dict__.items():
                if k == "parent" or not isinstance(v, (list,)) and not hasattr(v, "walk"):
                    continue
                for i, c in enumerate(v if isinstance(v, list) else [v]):
                    if hasattr(c, "walk") and c.parent is n:
                        place[id(c)] = (k, i if isinstance(v, list) else None)
                        depth[id(c)] = depth[id(n)] + 1
            value = getattr(n, "value", None)
            value = None if hasattr(value, "walk") or value is None else ("true" if value else "false") if isinstance(value, bool) else to_text(value) if isinstance(value, (int, float)) else str(value)
            name = getattr(n, "name", None)
            attrs = {k: str(v).lower() if isinstance(v, bool) else v for k, v in n.__dict__.items() if k in ("kind", "computed", "optional", "is_async", "generator", "static", "shorthand", "prefix", "flags", "pattern") and v is not None}
            k, i = place.get(id(n), (None, None))
            out.append((ids[id(n)], ids[id(n.parent)] if n.parent is not None else None, k, i, n.type, name if isinstance(name, str) else None, value, getattr(n, "operator", None), n.start, n.end, depth[id(n)], scope_ids[id(scopes.scope_of(n))], attrs))
        return out

    return per_program(df, id_column, code_column, NODES, f, facts=True)


def scopes(df: DataFrame, id_column: str = "file_id", code_column: str = "code") -> DataFrame:
    """A row for each scope."""

    def f(code: str) -> list[tuple]:
        _, ids, found, scope_ids = _analysed(code)
        return [(scope_ids[id(s)], scope_ids[id(s.parent)] if s.parent else None, s.node.type, ids[id(s.node)]) for s in sorted(found.of_node.values(), key=lambda s: scope_ids[id(s)])]

    return per_program(df, id_column, code_column, SCOPES, f, facts=True)


def bindings(df: DataFrame, id_column: str = "file_id", code_column: str = "code") -> DataFrame:
    """A row for each declared name; bare where it is a variable without a value or a plain parameter."""

    def bare(b) -> bool:
        return b.path.type == "Identifier" if b.kind == "param" else b.path.type == "VariableDeclarator" and b.path.init is None

    def f(code: str) -> list[tuple]:
        _, ids, found, scope_ids = _analysed(code)
        return [(i, scope_ids[id(b.scope)], b.name, b.kind, ids[id(b.ident)], b.constant, len(b.refs), len(b.writes), bare(b)) for i, b in enumerate(found.all)]

    return per_program(df, id_column, code_column, BINDINGS, f, facts=True)


def references(df: DataFrame, id_column: str = "file_id", code_column: str = "code") -> DataFrame:
    """A row for each read of a name, and for each write (its node is what writes)."""

    def f(code: str) -> list[tuple]:
        _, ids, found, _ = _analysed(code)
        return [(i, ids[id(n)], w) for i, b in enumerate(found.all) for w, ns in ((False, b.refs), (True, b.writes)) for n in ns]

    return per_program(df, id_column, code_column, REFS, f, facts=True)


def modules(df: DataFrame, id_column: str = "file_id", code_column: str = "code", options: Options = Options()) -> DataFrame:
    """A row for each module of each bundle, rewritten."""

    def f(code: str) -> list[tuple]:
        from scriptloom.js.pipeline import rewrite as run

        b = run(code, options).bundle
        return [(b.type, m.id, m.is_entry, m.path, m.code, m.dependencies) for m in b.modules.values()] if b else []

    return per_program(df, id_column, code_column, MODULES, f, reuse=shareable(options))


def rewrites(df: DataFrame, id_column: str = "file_id", code_column: str = "code", options: Options = Options()) -> DataFrame:
    """How often each rule changed each program."""

    def f(code: str) -> list[tuple]:
        from scriptloom.js.pipeline import rewrite as run

        return sorted((k, v) for k, v in run(code, options).changes.items() if v)

    return per_program(df, id_column, code_column, REWRITES, f, reuse=shareable(options))


def string_arrays(df: DataFrame, id_column: str = "file_id", code_column: str = "code") -> DataFrame:
    """The string array of an obfuscated program: its name, length and elements (null where undefined)."""

    def f(code: str) -> list[tuple]:
        from scriptloom.js.deobfuscate import find_string_array
        from scriptloom.js.engine import Context
        from scriptloom.js.parser import parse

        a = find_string_array(Context(parse(code)))
        return [(a.original, len(a.elements), a.elements)] if a else []

    return per_program(df, id_column, code_column, "original_name string, length int, elements array<string>", f)
