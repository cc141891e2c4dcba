"""Applying rewrite rules to a tree.

Children are visited before their parents.  What a rule puts in place of a
node is visited again, so rules build on one another's results within one
pass.  First visits are not bounded.  Visits of what was put in place are, in
proportion to the tree's size and anew for each pass; where that is used up
the program gets an error, and is not left half done in silence.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable
from functools import lru_cache

from scriptloom.js.nodes import Node
from scriptloom.js.scope import Scopes

DONE = "done"  # changed in place, nothing to visit again


#: Visits of replaced nodes that a pass may make: so many, and so many for each node of the tree.
AGAIN, AGAIN_EACH = 400_000, 40


class BudgetError(ValueError):
    """A pass visits what rules put in place again and again."""


class Skip:
    """A replacement that is not visited again."""

    def __init__(self, node: Node):
        self.node = node


class Again:
    """Changed in place, and these nodes below are to be visited again; the rest has been visited."""

    def __init__(self, *nodes: Node):
        self.nodes = nodes


class Rule:
    """A named rewrite: handlers by node type, whether it keeps meaning in all cases, and whether it asks for scopes."""

    def __init__(self, name: str, handlers: dict[str, Callable], safe: bool = True, scope: bool = False, before: bool = False):
        self.name, self.handlers, self.safe, self.scope, self.before = name, handlers, safe, scope, before


class Context:
    """What rules share while they work on one program."""

    def __init__(self, program: Node, options: dict | None = None):
        self.program, self.changes, self.options = program, Counter(), options or {}
        self.version, self._scopes, self.at = 0, None, -1
        self.again, self.turn = (AGAIN, AGAIN_EACH), 0  # turn: the number of the pass

    @property
    def scopes(self) -> Scopes:
        """The scopes of the tree as it stands now."""
        if self._scopes is None or self.at != self.version:
            self._scopes, self.at = Scopes(self.program), self.version
        return self._scopes

    def changed(self, name: str, n: int = 1) -> None:
        self.changes[name] += n
        self.version += 1


def swap(parent: Node, old: Node, new: list[Node]) -> None:
    """Puts new nodes in old's place in parent, also where old has become a child of one of them."""
    notes = old.__dict__.get("notes")
    if notes and new and not any(x is old for x in new):  # comments stay with what takes the place
        new[0].notes = (notes[0], notes[1] if len(new) == 1 else [])
        if len(new) > 1 and notes[1]:
            new[-1].notes = ([], notes[1])
    inside, old.parent = old.parent, parent
    old.replace(*new)
    if inside is not parent:
        old.parent = inside
    elif not any(x is old for x in new):
        old.parent = None


def attached(n: Node, program: Node) -> bool:
    return n is program or n.parent is not None


@lru_cache(maxsize=256)
def by_type(rules: tuple[Rule, ...]) -> tuple[dict, dict]:
    """Handlers by node type: those before a node's children are visited, and those behind."""
    handlers: dict[str, list[tuple[str, Callable]]] = defaultdict(list)
    first: dict[str, list[tuple[str, Callable]]] = defaultdict(list)
    for r in rules:
        for types, f in r.handlers.items():
            for t in types.split("|"):
                (first if r.before else handlers)[t].append((r.name, f))
    return dict(first), dict(handlers)


def apply(ctx: Context, rules: list[Rule]) -> int:
    """One pass of all rules over the program; returns how many changes they made."""
    first, handlers = by_type(tuple(rules))
    start = sum(ctx.changes.values())
    ctx.turn += 1
    left = None  # visits of replaced nodes that are left, by the size of the tree as they begin
    inside = 0  # how many replaced nodes the visit is inside of

    def again(n: Node) -> None:
        nonlocal inside
        inside += 1
        visit(n)
        inside -= 1

    def run(n: Node, found) -> bool:
        """Whether n is gone or was visited anew."""
        for name, f in found:
            parent = n.parent
            if parent is None and n is not ctx.program:
                return True
            out = f(n, ctx)
            if out is None or out is False:
                continue
            ctx.changed(name)
            if out == DONE:
                continue
            if isinstance(out, Again):
                for x in out.nodes:
                    again(x)
                continue
            if out is True:
                again(n)
                return True
            new = [out] if isinstance(out, Node) else [out.node] if isinstance(out, Skip) else out
            swap(parent, n, new)
            if not isinstance(out, Skip):
                for x in new:
                    if x.parent is not None:
                        again(x)
            return True
        return False

    def visit(n: Node) -> None:
        nonlocal left
        if inside:
            if left is None:
                left = ctx.again[0] + ctx.again[1] * sum(1 for _ in ctx.program.walk())
            left -= 1
            if left < 0:
                raise BudgetError("a pass visits replaced nodes too often")
        if first and n.type in first and run(n, first[n.type]):
            return
        for c in n.kids():
            if c.parent is n:
                visit(c)
        found = handlers.get(n.type)
        if found:
            run(n, found)

    visit(ctx.program)
    return sum(ctx.changes.values()) - start
