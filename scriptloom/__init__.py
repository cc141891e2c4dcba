"""scriptloom: analysing and normalising JavaScript at corpus scale on Spark.

Source text is a column, a program is a row.  Facts about programs (nodes,
scopes, bindings, modules, rewrites) are ordinary DataFrames; rewriting runs
in Arrow-batched kernels, one program at a time, with no shuffle.
"""
