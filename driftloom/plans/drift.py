"""Schema drift between two modelled schemas, on the driver: the nested report that scripts and commits are made of."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from driftloom.plans.catalog import Column, ForeignKey, Index, Schema


def _fold(x: str) -> str:
    return x.strip().lower()


def _action(x: str) -> str:
    return x.strip().upper() or "NO ACTION"


def _text(x: str) -> str:
    return re.sub(r"\s+", " ", x).strip().lower()


def _default(x: str | None) -> str | None:
    return x if x is None else re.sub(r"^(?:'(.*)'|\"(.*)\")$", lambda m: m[1] if m[1] is not None else m[2], x.strip(), flags=re.DOTALL)


def column_form(c: Column) -> tuple:
    return _fold(c.data_type), c.is_nullable, _default(c.default)


def foreign_key_form(k: ForeignKey) -> tuple:
    return k.columns, k.ref_table, k.ref_columns, _action(k.on_delete), _action(k.on_update)


def index_form(i: Index) -> tuple:
    return i.columns, i.is_unique


@dataclass
class Change:
    """Names only in dev (added), only in prod (removed) and in both with another form (modified)."""

    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    modified: list[str] = field(default_factory=list)

    def __bool__(self) -> bool:
        return bool(self.added or self.removed or self.modified)


def changes(prod: dict, dev: dict, form) -> Change:
    return Change(sorted(dev.keys() - prod.keys()), sorted(prod.keys() - dev.keys()), sorted(n for n in prod.keys() & dev.keys() if form(prod[n]) != form(dev[n])))


@dataclass
class TableDrift:
    columns: Change
    indexes: Change
    foreign_keys: Change
    primary_key: tuple[list[str], list[str]] | None = None

    def __bool__(self) -> bool:
        return bool(self.columns or self.indexes or self.foreign_keys or self.primary_key)


@dataclass
class Drift:
    added_tables: list[str]
    removed_tables: list[str]
    tables: dict[str, TableDrift]
    views: Change
    routines: Change
    triggers: Change
    sequences: Change

    def __bool__(self) -> bool:
        return bool(self.added_tables or self.removed_tables or self.tables or self.views or self.routines or self.triggers or self.sequences)

    def to_dict(self) -> dict:
        return asdict(self)


def schema_drift(prod: Schema, dev: Schema) -> Drift:
    """Tables are matched by exact name, as their scripts need it."""
    tables = {}
    for n in sorted(prod.tables.keys() & dev.tables.keys()):
        p, d = prod.tables[n], dev.tables[n]
        own = TableDrift(changes(p.columns, d.columns, column_form), changes(p.indexes, d.indexes, index_form), changes(p.foreign_keys, d.foreign_keys, foreign_key_form), (p.primary_key, d.primary_key) if p.primary_key != d.primary_key else None)
        if own:
            tables[n] = own
    return Drift(
        sorted(dev.tables.keys() - prod.tables.keys()), sorted(prod.tables.keys() - dev.tables.keys()), tables,
        changes(prod.views, dev.views, lambda v: (_text(v.definition), v.is_materialized)),
        changes(prod.routines, dev.routines, lambda r: (_fold(r.kind), _fold(r.language), _fold(r.return_type), _text(r.definition), [tuple(map(_fold, p)) for p in r.parameters])),
        changes(prod.triggers, dev.triggers, lambda t: (t.table, _fold(t.timing), _fold(t.event), _text(t.definition))),
        changes(prod.sequences, dev.sequences, lambda s: (s.start_value, s.increment, s.min_value, s.max_value, s.cache_size, s.is_cyclic, s.owner_table)),
    )


def drift_text(drift: Drift) -> str:
    """The drift as text, one line per object."""
    if not drift:
        return "No schema drift detected.\n"
    lines = [f"+ table {t}" for t in drift.added_tables] + [f"- table {t}" for t in drift.removed_tables]
    for t, own in drift.tables.items():
        for kind in ("columns", "indexes", "foreign_keys"):
            lines += _lines(f"{t} {kind}", getattr(own, kind))
        if own.primary_key:
            lines.append(f"~ {t} primary key: {', '.join(own.primary_key[0])} -> {', '.join(own.primary_key[1])}")
    for kind in ("views", "routines", "triggers", "sequences"):
        lines += _lines(kind, getattr(drift, kind))
    return "\n".join(lines) + "\n"


def _lines(kind: str, change: Change) -> list[str]:
    return [f"{sign} {kind}: {n}" for sign, names in (("+", change.added), ("-", change.removed), ("~", change.modified)) for n in names]
