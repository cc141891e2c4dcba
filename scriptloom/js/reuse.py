"""One run for all programs that differ in numbers only.

Programs made from one template are alike but for whole numbers.  The second
one of a shape is run with its numbers unknown: a Num stands for each in the
tree.  What a rule asks of a Num (is it 1, is it more than 9) is kept as a
condition with the answer; a rule that needs the value itself gets it, and the
number counts as fixed.  The rules never see more than these answers, so they
do the same to every program of this shape whose fixed numbers are equal and
whose conditions hold, and its result is the same but for the numbers printed.
All other programs are run by themselves.
"""

from __future__ import annotations

import math
import operator
import re
from bisect import bisect_right
from collections.abc import Callable
from contextvars import ContextVar
from itertools import accumulate

#: Whole numbers that JavaScript prints as they are written, apart from names and other numbers.
HOLE = re.compile(r"([1-9](?<![\w$.\\].)[0-9]{0,14}(?![\w$.]))")
#: These, and the digits at the end of a name.
FACT_HOLE = re.compile(r"([1-9](?<![\w$.\\].)[0-9]{0,14}(?![\w$.])|[0-9](?<=[A-Za-z_$].)[0-9]*(?![\w$\\]))")
SAFE = 2**53

#: Bounds of what is kept, in characters, of which a shape takes some thousands at least.  Beyond them programs are run by themselves.
LONGEST, KEPT, SEEN, SHAPE = 100_000, 16_000_000, 20_000, 4_000

_running: ContextVar[Run | None] = ContextVar("running", default=None)


class Num:
    """A whole number that is not zero, below 2**53, of known sign; its value is unknown until a rule asks for it."""

    __slots__ = ("expr", "holes", "real", "run")

    def __init__(self, run: Run, expr: str, holes: frozenset, real: int | float):
        self.run, self.expr, self.holes, self.real = run, expr, holes, real

    @property
    def __class__(self):  # isinstance takes it for what it stands for
        return self.real.__class__

    def known(self) -> int | float:
        self.run.fixed |= self.holes
        return self.real

    def typed(self, type_: type) -> Num:
        return Num(self.run, self.expr, self.holes, type_(self.real))

    def made(self, expr: str, real, other=None):
        """A result of arithmetic: unknown if it is such a number, whatever a and b are."""
        holes = self.holes | other.holes if type(other) is Num else self.holes
        if not (0 < abs(real) < SAFE and float(real).is_integer()) or len(expr) > 400:
            self.run.fixed |= holes
            return real
        self.run.conditions[f"0 < {expr} < {SAFE}" if real > 0 else f"-{SAFE} < {expr} < 0"] = True
        return Num(self.run, expr, holes, real)

    def two(self, op: str, other, real, turned: bool = False):
        if type(other) is Num:
            a, b = self.expr, other.expr
        elif float(other).is_integer() and abs(other) < SAFE and other != 0:
            a, b = self.expr, repr(int(other))
        else:
            self.known()
            return real
        return self.made(f"({b} {op} {a})" if turned else f"({a} {op} {b})", real, other)

    def __add__(self, b):
        return self.two("+", b, self.real + plain(b)) if number(b) else NotImplemented

    def __radd__(self, b):
        return self.two("+", b, plain(b) + self.real, True) if number(b) else NotImplemented

    def __sub__(self, b):
        return self.two("-", b, self.real - plain(b)) if number(b) else NotImplemented

    def __rsub__(self, b):
        return self.two("-", b, plain(b) - self.real, True) if number(b) else NotImplemented

    def __mul__(self, b):
        return self.two("*", b, self.real * plain(b)) if number(b) else NotImplemented

    def __rmul__(self, b):
        return self.two("*", b, plain(b) * self.real, True) if number(b) else NotImplemented

    def __neg__(self):
        return self.made(f"(-{self.expr})", -self.real)

    def __abs__(self):
        return self if self.real > 0 else -self

    def asked(self, op: str, b, answer: bool) -> bool:
        """An answer to a comparison; what follows from sign and size alone needs no condition."""
        if type(b) is Num:
            if len(self.expr) + len(b.expr) > 800:
                self.known(), b.known()
                return answer
            self.run.conditions[f"({self.expr} {op} {b.expr})"] = answer
        elif b == 0 or abs(b) >= SAFE:
            pass
        elif b != b or not float(b).is_integer():
            self.known()
        else:
            self.run.conditions[f"({self.expr} {op} {int(b)})"] = answer
        return answer

    def __eq__(self, b):
        return self.asked("==", b, self.real == plain(b)) if number(b) else False

    def __ne__(self, b):
        return not self == b

    def __lt__(self, b):
        return self.asked("<", b, self.real < plain(b)) if number(b) else NotImplemented

    def __le__(self, b):
        return self.asked("<=", b, self.real <= plain(b)) if number(b) else NotImplemented

    def __gt__(self, b):
        return self.asked(">", b, self.real > plain(b)) if number(b) else NotImplemented

    def __ge__(self, b):
        return self.asked(">=", b, self.real >= plain(b)) if number(b) else NotImplemented

    def __bool__(self):
        return True

    def is_integer(self):
        return True

    def __getattr__(self, name):
        if not hasattr(self.real, name):
            raise AttributeError(name)
        return getattr(self.known(), name)

    def mark(self) -> str:
        """Digits that stand for the value in a printed program."""
        if self.real < 0:
            return str(int(self.known()))
        marks = self.run.marks
        if self.expr not in marks:
            marks[self.expr] = f"{90071992547409910000 + 7919 * len(marks)}"
        return marks[self.expr]


def known(x):
    return x.known() if type(x) is Num else x


def _asking(do: Callable) -> Callable:
    return lambda *of: do(*map(known, of))


#: All else that can be done with a number needs its value.
for _name, _do in {"hash": hash, "str": str, "repr": repr, "format": format, "int": int, "float": float, "index": operator.index, "trunc": math.trunc, "floor": math.floor, "ceil": math.ceil, "round": round, "pos": operator.pos, "invert": operator.invert, "divmod": divmod, "rdivmod": lambda a, b: divmod(b, a)}.items():
    setattr(Num, f"__{_name}__", _asking(_do))
for _name in ("truediv", "floordiv", "mod", "pow", "and", "or", "xor", "lshift", "rshift"):
    _do = getattr(operator, f"__{_name}__")
    setattr(Num, f"__{_name}__", _asking(_do))
    setattr(Num, f"__r{_name}__", _asking(lambda a, b, do=_do: do(b, a)))


def number(x) -> bool:
    return isinstance(x, (int, float))


def plain(x):
    return x.real if type(x) is Num else x


def as_float(x) -> float:
    """float(x), but an unknown number stays unknown."""
    return x.typed(float) if type(x) is Num else float(x)


def as_int(x) -> int:
    """int(x) of a whole number, but an unknown number stays unknown."""
    return x.typed(int) if type(x) is Num else int(x)


class Run:
    """A run with unknown numbers."""

    def __init__(self, code: str):
        self.code, self.planted = code, False
        self.starts = {m.start(): (i, m[0]) for i, m in enumerate(HOLE.finditer(code))}
        self.fixed: set[int] = set(range(len(self.starts)))
        self.conditions: dict[str, bool] = {}
        self.marks: dict[str, str] = {}

    def plant(self, tree) -> None:
        """Unknown numbers in the place of the literals that stand at the holes; all other holes stay fixed."""
        if self.planted:
            return
        self.planted = True
        for n in tree.walk():
            if n.type == "NumericLiteral" and n.start in self.starts:
                i, text = self.starts[n.start]
                if n.raw == text and n.value == int(text):
                    n.value, n.raw = Num(self, f"h[{i}]", frozenset((i,)), n.value), object()
                    self.fixed.discard(i)


def planted(tree, code: str):
    """The tree of a program, where a run with unknown numbers is under way with these in it."""
    run = _running.get()
    if run is not None and code is run.code:
        run.plant(tree)
    return tree


class Shape:
    """What is known about programs of one shape."""

    def __init__(self):
        #: results by fixed holes, then by these holes' texts
        self.found: dict[tuple, dict[tuple, list]] = {}
        self.tries, self.hits = 0, 0


class Reuse:
    """What f gives for a program, as columns, from an earlier run where that is known to give the same.

    f's rows are results of rules, or facts: what parser and scopes say of a program, with places in the text in these columns.
    """

    def __init__(self, f: Callable[[str], list[tuple]], places: tuple[int, ...] | None = None):
        self.f, self.places, self.kept = f, places, 0
        self.holes = HOLE if places is None else FACT_HOLE
        self.shapes: dict[str, Shape | None] = {}
        self.seen: set[int] = set()

    def look(self, code: str) -> tuple[list[tuple] | None, tuple | None]:
        """Columns that are known for a program, or None and what to call learn with (None: nothing is to be learnt)."""
        if len(code) > LONGEST or "\0" in code:
            return None, None
        parts = self.holes.split(code)
        key, texts = "\0".join(parts[::2]), parts[1::2]
        shape = self.shapes.get(key, self)
        if shape is None:
            return None, None
        if shape is self:
            return None, (key, None)
        numbers = list(map(int, texts)) if self.places is None else None
        for fixed, by_value in shape.found.items():
            for found in by_value.get(tuple([texts[i] for i in fixed]), ()):
                holds, render, checks = found
                if holds(numbers, texts):
                    columns = render(numbers, texts, list(accumulate(map(len, texts), initial=0)) if self.places else None)
                    shape.hits += 1
                    if checks:  # the first results are held against the program's own
                        found[2] -= 1
                        return None, (key, columns)
                    return columns, None
        return None, (key, None)

    def learn(self, code: str, rows: list[tuple], what: tuple) -> None:
        """Takes note of a program's own rows."""
        key, expected = what
        if expected is not None:
            if expected != columns_of(rows):
                self.shapes[key] = None
            return
        shape = self.shapes.get(key)
        if shape is None:
            h = hash(key)
            if h not in self.seen:  # a shape is worth it once it is met again
                if len(self.seen) >= SEEN:
                    self.seen.clear()
                self.seen.add(h)
                return
            if self.kept > KEPT:
                return
            shape = self.shapes[key] = Shape()
            self.kept += SHAPE // 10 + len(key)
        if shape.tries > 16 + shape.hits // 8:
            if shape.hits < shape.tries:
                self.shapes[key] = None
            return
        if self.kept > KEPT:
            return
        shape.tries += 1
        try:
            fixed, holds, render = self.rules(code) if self.places is None else self.facts(code)
            texts = self.holes.split(code)[1::2]
            numbers = list(map(int, texts)) if self.places is None else None
            good = holds(numbers, texts) and render(numbers, texts, list(accumulate(map(len, texts), initial=0))) == columns_of(rows)
        except Exception:  # the program's own run had none: what is done cannot be done with unknown numbers
            good = False
        if not good:
            self.shapes[key] = None
            return
        self.kept += SHAPE + 2 * len(code) + 8 * sum(map(len, rows))
        fixed = tuple(sorted(fixed))
        shape.found.setdefault(fixed, {}).setdefault(tuple([texts[i] for i in fixed]), []).append([holds, render, 2])

    def rules(self, code: str):
        """Fixed holes, condition and columns of a run with unknown numbers."""
        run = Run(code)
        token = _running.set(run)
        try:
            rows = self.f(code)
        finally:
            _running.reset(token)
        marks = {m: f"str({e})" for e, m in run.marks.items()}
        return run.fixed, condition([f"({c})" if yes else f"(not {c})" for c, yes in run.conditions.items()]), template(rows, marks)

    def facts(self, code: str):
        """Fixed holes, condition and columns of a run with other numbers, and other numbers at the ends of names.

        Parser and scopes ask of a number nothing, and of a name with a number at its end whether it is that of another
        identifier: what they say is the same as long as names that are equal stay so, and those that are not.
        """
        from scriptloom.js.parser import parse

        holes = list(self.holes.finditer(code))
        starts, ends = {m.start(): i for i, m in enumerate(holes)}, {m.end(): i for i, m in enumerate(holes)}
        names: dict[str, list[int]] = {}
        others: set[str] = set()
        free: dict[int, str] = {}
        marks: dict[str, str] = {}
        for n in parse(code).walk():
            if n.type == "NumericLiteral" and starts.get(n.start) == ends.get(n.end, -1):
                i = starts[n.start]
                if i not in free:
                    free[i] = self.mark(code, marks, i)
            elif n.type == "Identifier" and code[n.start : n.end] == n.name and n.end in ends and n.start < holes[ends[n.end]].start():
                i = ends[n.end]
                if i not in free:
                    same = names.setdefault(n.name, [])
                    free[i] = free[same[0]] if same else self.mark(code, marks, i)
                    same.append(i)
            elif isinstance(name := n.__dict__.get("name"), str):
                others.add(name)
        asked, heads = [], {}
        for name, at in names.items():
            heads.setdefault(name[: len(name) - len(holes[at[0]][0])], []).append(at[0])
            asked += [f"(t[{i}] == t[{at[0]}])" for i in at[1:]]
        for head, at in heads.items():
            rest = [o[len(head) :] for o in others if o.startswith(head)]
            asked += [f"(t[{i}] != '{x}')" for i in at for x in rest if re.fullmatch("[0-9]+", x)]
        asked += [f"(len({{{', '.join(f't[{i}]' for i in at)}}}) == {len(at)})" for at in heads.values() if len(at) > 1]
        parts, text, sites = self.holes.split(code), "", []
        for i, part in enumerate(parts):
            text += free.get(i // 2, part) if i % 2 else part
            if i % 2:
                sites.append(len(text))
        lengths = list(accumulate((len(free.get(i, m[0])) for i, m in enumerate(holes)), initial=0))

        def place(p: int) -> str:
            before = bisect_right(sites, p)
            return f"{p - lengths[before]} + d[{before}]" if before else str(p)

        return set(range(len(holes))) - free.keys(), condition(asked), template(self.f(text), marks, self.places, place)

    @staticmethod
    def mark(code: str, marks: dict[str, str], i: int) -> str:
        """A number that stands for a hole's text."""
        m = f"{900719925474099 - 7919 * len(marks)}"
        while m in code or m in marks:
            m = str(int(m) - 1)
        marks[m] = f"t[{i}]"
        return m


def columns_of(rows: list[tuple]) -> list[tuple]:
    return list(zip(*rows, strict=True))


def condition(asked: list[str]) -> Callable[[list[int] | None, list[str]], bool]:
    return eval("lambda h, t: " + (" and ".join(asked) or "True"))  # noqa: S307 (made of numbers only)


def template(rows: list[tuple], marks: dict[str, str], places: tuple[int, ...] = (), place: Callable[[int], str] = str) -> Callable:
    """A function from numbers, their texts and their texts' lengths up to each to columns."""
    split = re.compile("(" + "|".join(marks) + ")") if marks else None
    constants, made = [], []

    def constant(v) -> str:
        constants.append(v)
        return f"c[{len(constants) - 1}]"

    def cell(v, is_place: bool) -> str | None:
        """How a value is made; None where it is always the same."""
        if is_place and type(v) is int:
            return place(v)
        if type(v) is Num or isinstance(v, (list, dict, tuple)) and split and split.search(repr(v)):
            raise ValueError("a number in a value that is no text")
        if not split or not isinstance(v, str) or not split.search(v):
            return None
        terms = [marks[p] if i % 2 else constant(p) for i, p in enumerate(split.split(v)) if i % 2 or p]
        return f"''.join(({', '.join(terms)},))"

    for i, column in enumerate(columns_of(rows)):
        cells = [cell(v, i in places) for v in column]
        if all(x is None for x in cells):
            made.append(constant(column))
        else:
            made.append("(" + "".join((constant(v) if x is None else x) + ", " for x, v in zip(cells, column, strict=True)) + ")")
    return eval(f"lambda h, t, d, c=c: [{', '.join(made)}]", {"c": constants, "str": str})  # noqa: S307 (made of numbers only)
