"""Which columns, tables and other objects a comparison leaves out. Decided while the plan is built, so ignored columns are never read."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from fnmatch import fnmatchcase

from driftloom.functions.canonical import canonical_name


def column_ignorer(patterns: Iterable[str]) -> Callable[[str, str], bool]:
    """A predicate of (table, column): some pattern equals `table.column` or `column`, or matches either as a glob, case apart."""
    own = [canonical_name(p) for p in patterns]
    exact, globs = set(own), [p for p in own if any(c in p for c in "*?[")]

    def ignored(table: str, column: str) -> bool:
        names = (f"{canonical_name(table)}.{canonical_name(column)}", canonical_name(column))
        return any(n in exact or any("/" not in n and fnmatchcase(n, g) for g in globs) for n in names)

    return ignored


def name_ignorer(names: Iterable[str]) -> Callable[[str], bool]:
    """A predicate of an object's name: it is one of names, case apart."""
    own = {canonical_name(n) for n in names}
    return lambda name: canonical_name(name) in own
