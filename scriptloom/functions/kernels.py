"""Programs as rows: Arrow-batched kernels, one program at a time.

Every kernel is a mapInArrow over the rows of a DataFrame, so there is no
shuffle, filters and projections before it reach the scan, and rows that
cannot be read, or take too long, get an error instead of failing the job.
Texts are taken from a batch one by one; Spark bounds a batch's bytes.
"""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scriptloom.session import ship

#: Seconds that one program may take.
SECONDS = 300.0


#: Bytes of a scan that one task takes, and how many tasks there are at most for them.
PART, PARTS = 1 << 18, 4096


class TimeBudgetError(RuntimeError):
    """A program takes too long."""


@contextmanager
def within(seconds: float | None) -> Iterator[None]:
    """Raises TimeBudgetError inside once so many seconds have gone by; without effect outside of a process's main thread."""
    if seconds is None or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise TimeBudgetError(f"more than {seconds:g} seconds")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def spread(df: DataFrame) -> DataFrame:
    """A scan in parts of about PART bytes and at least one for each core; where it has as many splits, it is not shuffled.

    Splits alone do not do it: a Parquet row group is never cut, and one task's programs are run one after the other.
    """
    query = df._jdf.queryExecution()
    leaves = query.optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, min(-(-size // PART), PARTS))
    return df.repartition(parts) if query.toRdd().getNumPartitions() < parts else df


def per_program(df: DataFrame, id_column: str, code_column: str, schema: str, f: Callable[[str], list[tuple]], seconds: float | None = SECONDS, reuse: bool = False, facts: bool = False) -> DataFrame:
    """Rows of (id, *row) for each row that f gives for a program, and a last column error.

    f's rows may end in an error of their own.  A null text is an empty program.  What f raises, and taking more than so
    many seconds, becomes one row with nulls and the message.  With reuse, programs that differ in numbers only share a
    run where it is known to give the same (js.reuse): f must print by to_code with marks, and give no places in the text.
    Facts are of parser and scopes alone; their columns start and end are places in the text.
    """
    schema += ", error string"
    full = StructType.fromDDL(f"{id_column} long, {schema}")
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from scriptloom.js.reuse import Reuse

        def whole(text: str) -> list[tuple]:
            return [(*row, None) if len(row) < len(full.names) - 1 else row for row in f(text)]

        places = tuple(i - 1 for i, name in enumerate(full.names) if name in ("start", "end"))
        known = Reuse(whole, places if facts else None) if reuse or facts else None
        for b in batches:
            out: list[list] = [[] for _ in full.names]
            for key, code in zip(b.column(0), b.column(1), strict=True):
                text = code.as_py() or ""
                columns, what = known.look(text) if known else (None, None)
                if columns:
                    out[0] += [key.as_py()] * len(columns[0])
                    for column, values in zip(out[1:], columns, strict=True):
                        column += values
                else:
                    try:
                        with within(seconds):
                            rows = whole(text)
                        if what:
                            with within(seconds):
                                known.learn(text, rows, what)
                    except Exception as e:  # one bad program must not fail the job
                        rows = [(*[None] * (len(full.names) - 2), f"{type(e).__name__}: {e}"[:500])]
                    number = key.as_py()
                    for row in rows:
                        for column, value in zip(out, (number, *row), strict=True):
                            column.append(value)
                if len(out[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, arrow, strict=True)], schema=arrow)
                    out = [[] for _ in full.names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, arrow, strict=True)], schema=arrow)

    ship(df.sparkSession)
    return df.select(df[id_column].cast("long").alias(id_column), df[code_column].cast("string")).mapInArrow(run, full)
