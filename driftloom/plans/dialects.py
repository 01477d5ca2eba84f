"""What SQL dialects differ in: quoting, types, transactions and DDL forms. Driver-side text only."""

from __future__ import annotations

from dataclasses import dataclass

DRIVERS = ("mysql", "postgres", "sqlite", "mssql", "oracle")
PORTS = {"mysql": 3306, "postgres": 5432, "mssql": 1433, "oracle": 1521}


@dataclass(frozen=True)
class Dialect:
    """A SQL dialect; typed asks for bare numbers in literals."""

    name: str
    typed: bool = False

    def __post_init__(self):
        if self.name not in DRIVERS:
            raise ValueError(f"unknown driver {self.name!r}")

    @property
    def marks(self) -> str:
        """What opens and closes a quoted identifier; the latter is doubled inside."""
        return {"mysql": "``", "mssql": "[]"}.get(self.name, '""')

    def quote(self, name: str) -> str:
        """An identifier, quoted; parts of a dotted name one by one."""
        a, b = self.marks
        return ".".join(a + part.replace(b, b + b) + b for part in name.split("."))

    def begin(self) -> list[str]:
        own = {"mysql": ["SET FOREIGN_KEY_CHECKS=0;"], "mssql": ["EXEC sp_MSforeachtable 'ALTER TABLE ? NOCHECK CONSTRAINT ALL';"], "oracle": ["-- disable foreign key constraints by hand where rows refer to each other"]}
        return ["BEGIN;", *own.get(self.name, [])]

    def commit(self) -> list[str]:
        own = {"mysql": ["SET FOREIGN_KEY_CHECKS=1;"], "mssql": ["EXEC sp_MSforeachtable 'ALTER TABLE ? WITH CHECK CHECK CONSTRAINT ALL';"]}
        return [*own.get(self.name, []), "COMMIT;"]

    def page(self, n: int) -> str:
        return f"OFFSET 0 ROWS FETCH NEXT {n} ROWS ONLY" if self.name in ("mssql", "oracle") else f"LIMIT {n}"

    @property
    def add_column(self) -> str:
        return "ADD" if self.name in ("mssql", "oracle") else "ADD COLUMN"


def keyset_query(dialect: Dialect, table: str, columns: list[str], key: list[str], n: int, last: list[str] | None = None) -> str:
    """The SQL of a page after the key whose literals are last, for sources that Spark does not split itself."""
    where = ""
    if last:
        tests = ["(" + " AND ".join([f"{dialect.quote(k)} = {v}" for k, v in zip(key[:i], last[:i], strict=True)] + [f"{dialect.quote(key[i])} > {last[i]}"]) + ")" for i in range(len(key))]
        where = f" WHERE {' OR '.join(tests)}"
    return f"SELECT {', '.join(map(dialect.quote, columns))} FROM {dialect.quote(table)}{where} ORDER BY {', '.join(map(dialect.quote, key))} {dialect.page(n)}"
