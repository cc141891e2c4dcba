"""Paths of modules in a bundle.

A place is how many levels it lies above the folder that paths start from, and
the names from there on.  All paths are made of places, so they are normal as
soon as they exist.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

# Where packages lie, what a folder's module is called, and what stands for folders without a known name.
PACKAGES, INDEX, UNNAMED = "node_modules", "index.js", "tmp{}"


class Place(NamedTuple):
    """levels up, then names."""

    up: int = 0
    names: tuple[str, ...] = ()

    def go(self, path: str) -> Place:
        """Where a path leads from here."""
        up, names = self.up, list(self.names)
        for step in path.split("/"):
            if step == "..":
                if names:
                    names.pop()
                else:
                    up += 1
            elif step not in ("", "."):
                names.append(step)
        return Place(up, tuple(names))

    @property
    def folder(self) -> Place:
        return Place(self.up, self.names[:-1])

    @property
    def packaged(self) -> bool:
        return self.up == 0 and self.names[:1] == (PACKAGES,)

    def below(self, folders: tuple[str, ...]) -> str:
        """The path, if the folder that paths start from is the last of these, which are named from the top."""
        return "/".join(folders[: len(folders) - self.up] + self.names)


def join(*parts: str) -> str:
    """The normal form of parts joined; `.` where nothing is left."""
    place = Place().go("/".join(filter(None, parts)))
    return "/".join([".."] * place.up + list(place.names)) or "."


def relative(source: str, target: str) -> str:
    """How the module at source names the one at target: packages by their name, others by the way from its folder."""
    here, there = Place().go(source).folder, Place().go(target)
    if target.startswith(PACKAGES + "/"):
        return target[len(PACKAGES) + 1 :]
    same = 0
    while same < min(len(here.names), len(there.names)) and here.names[same] == there.names[same]:
        same += 1
    back = len(here.names) - same
    return "/".join([".."] * back + list(there.names[same:])) if back else "./" + "/".join(there.names[same:])


def default_path(module_id: str, entry: bool) -> str:
    return "./" + (INDEX if entry else module_id.removesuffix(".js") + ".js")


def key_order(keys) -> list[str]:
    """As JavaScript enumerates keys: integers first, ascending, then the others as they came."""
    whole = {k: int(k) for k in keys if k.isdecimal() and k == str(int(k)) and int(k) < 2**32 - 1}
    return sorted(whole, key=whole.get) + [k for k in keys if k not in whole]


def required(name: str, folder: Place) -> Place:
    """Where a module lies that is required by a name from a folder: relative names from there, all others among the packages."""
    if not name.startswith("."):
        return Place().go(f"{PACKAGES}/{name}/{INDEX}")
    return folder.go(name if name.endswith(".js") else name + ".js")


def reached(tree: dict[str, dict[str, str]], entry: str) -> Iterator[tuple[str, Place]]:
    """(module, place) of every module below the entry, once, in the order of a depth-first visit."""
    seen = set()
    open_: list[tuple[Place, Iterator[str], dict[str, str]]] = []

    def enter(module: str, folder: Place) -> None:
        names = tree.get(module, {})
        open_.append((folder, iter(key_order(names)), names))

    enter(entry, Place())
    while open_:
        folder, modules, names = open_[-1]
        module = next(modules, None)
        if module is None:
            open_.pop()
        elif module not in seen:
            seen.add(module)
            place = required(names[module], folder)
            yield module, place
            enter(module, place.folder)


def resolve_tree(tree: dict[str, dict[str, str]], entry: str) -> dict[str, str]:
    """Paths of all modules that are reached from the entry.

    The entry is the index of the folder that paths start from.  If some module
    lies levels above it, as many folders are made up, named from the top.
    """
    places = dict(reached(tree, entry)) | {entry: Place(names=(INDEX,))}
    lowest = max(p.up for p in places.values())
    made_up = tuple(UNNAMED.format(k) for k in range(lowest))
    return {module: p.below(() if p.packaged else made_up) for module, p in places.items()}


def escapes(path: str) -> bool:
    """Whether a path leaves the folder that it is to be written below."""
    p = path.replace("\\", "/")
    return p.startswith("/") or p[1:2] == ":" or Place().go(p).up > 0
