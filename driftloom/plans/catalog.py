"""The schema model on the driver: as many objects as a catalog has, never data."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from driftloom.functions.canonical import canonical_name


@dataclass
class Column:
    name: str
    data_type: str
    is_nullable: bool = True
    default: str | None = None

    @property
    def type_text(self) -> str:
        """The type and whether nulls are allowed, for reading."""
        return f"{self.data_type} {'NULL' if self.is_nullable else 'NOT NULL'}"


@dataclass
class Index:
    name: str
    columns: list[str]
    is_unique: bool = False


@dataclass
class ForeignKey:
    name: str
    columns: list[str]
    ref_table: str
    ref_columns: list[str]
    on_delete: str = ""
    on_update: str = ""


@dataclass
class Table:
    name: str
    columns: dict[str, Column] = field(default_factory=dict)
    primary_key: list[str] = field(default_factory=list)
    indexes: dict[str, Index] = field(default_factory=dict)
    foreign_keys: dict[str, ForeignKey] = field(default_factory=dict)


@dataclass
class View:
    name: str
    definition: str
    is_materialized: bool = False


@dataclass
class Routine:
    name: str
    kind: str
    definition: str
    language: str = ""
    return_type: str = ""
    parameters: list[tuple[str, str, str]] = field(default_factory=list)  # (mode, name, type)


@dataclass
class Trigger:
    name: str
    table: str
    timing: str
    event: str
    definition: str


@dataclass
class Sequence:
    name: str
    start_value: int = 1
    increment: int = 1
    min_value: int = 1
    max_value: int = (1 << 63) - 1
    cache_size: int = 1
    is_cyclic: bool = False
    owner_table: str = ""


@dataclass
class Schema:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, View] = field(default_factory=dict)
    routines: dict[str, Routine] = field(default_factory=dict)
    triggers: dict[str, Trigger] = field(default_factory=dict)
    sequences: dict[str, Sequence] = field(default_factory=dict)

    def without(self, ignored: dict[str, list[str]]) -> Schema:
        """The schema less the ignored names of each kind (tables, views, ..), case apart."""
        out = Schema()
        for kind in asdict(out):
            names = {canonical_name(n) for n in ignored.get(kind, ())}
            setattr(out, kind, {n: x for n, x in getattr(self, kind).items() if canonical_name(n) not in names})
        return out

    def find_table(self, name: str) -> Table | None:
        """A table by name, exactly or else case apart."""
        return self.tables.get(name) or next((t for n, t in sorted(self.tables.items()) if canonical_name(n) == canonical_name(name)), None)

    def missing_keys(self, ignored: list[str] = ()) -> list[str]:
        names = {canonical_name(n) for n in ignored}
        return sorted(n for n, t in self.tables.items() if not t.primary_key and canonical_name(n) not in names)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Schema:
        tables = {n: Table(t["name"], {c: Column(**x) for c, x in t["columns"].items()}, t["primary_key"], {i: Index(**x) for i, x in t["indexes"].items()}, {f: ForeignKey(**x) for f, x in t["foreign_keys"].items()}) for n, t in d["tables"].items()}
        make = lambda kind, of: {n: of(**x) for n, x in d.get(kind, {}).items()}
        return cls(tables, make("views", View), make("routines", Routine), make("triggers", Trigger), make("sequences", Sequence))

    def column_rows(self, spark: SparkSession) -> DataFrame:
        """The columns as catalog rows, for the DataFrame comparison."""
        rows = [(t.name, i, c.name, c.data_type, c.is_nullable, c.default, t.primary_key.index(c.name) if c.name in t.primary_key else None) for t in self.tables.values() for i, c in enumerate(t.columns.values())]
        return spark.createDataFrame(rows, "table string, ordinal int, column string, data_type string, is_nullable boolean, default_value string, pk_ordinal int")


def table_of(name: str, df: DataFrame, primary_key: list[str]) -> Table:
    """The model of a DataFrame's table; types are Spark's own texts."""
    by_name = {canonical_name(c): c for c in df.columns}
    return Table(name, {f.name: Column(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema}, [by_name[canonical_name(k)] for k in primary_key])


def schema_of(tables: dict[str, tuple[DataFrame, list[str]]]) -> Schema:
    return Schema({n: table_of(n, df, key) for n, (df, key) in tables.items()})
