"""A whole comparison, from configuration to reports: what the commands call."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.canonical import canonical_name
from driftloom.functions.ignore import column_ignorer
from driftloom.functions.retry import DriftError
from driftloom.operators import celldiff, patch, resolve, rowdiff
from driftloom.operators.rowdiff import aligned
from driftloom.plans import catalog
from driftloom.plans.dialects import Dialect
from driftloom.plans.drift import Drift, schema_drift
from driftloom.plans.migration import creation_order
from driftloom.plans.resume import Manifest, run_ranges, run_tables
from driftloom.sources import files, introspect, versions
from driftloom.sources.config import Config, Source
from driftloom.sources.tables import read_table


#: Bytes of a Parquet table's files in one step of a comparison, about.
RANGE_BYTES = 16 << 30


def _schema(spark: SparkSession, source: Source, config: Config) -> catalog.Schema:
    """A side's schema: a Parquet folder's tables with the configured keys, or a database's catalog."""
    if source.driver == "parquet":
        names = versions.table_names(source.path or source.database)
        keys = {canonical_name(t): k for t, k in config.primary_keys.items()}
        schema = catalog.schema_of({n: (read_table(spark, source, n), keys.get(canonical_name(n), [])) for n in names})
    elif source.driver == "sqlite":
        schema = introspect.sqlite_schema(source.path or source.database)
    else:
        schema = introspect.jdbc_schema(spark, source)
    ignored = {k: getattr(config, f"ignore_{k}") for k in ("tables", "views", "routines", "triggers", "sequences")}
    return schema.without(ignored)


@dataclass
class Comparison:
    """Both sides of a configuration, read lazily."""

    spark: SparkSession
    config: Config
    prod: catalog.Schema = field(init=False)
    dev: catalog.Schema = field(init=False)

    metrics: dict[str, dict] = field(init=False, default_factory=dict)
    _unique: set = field(init=False, default_factory=set, repr=False)

    def __post_init__(self):
        self.prod, self.dev = (_schema(self.spark, s, self.config) for s in (self.config.prod, self.config.dev))

    def stamps(self) -> dict[str, dict[str, str]] | None:
        """{side: {table: digest}} of the names, sizes and times of each side's files; None if a side is a network database."""
        out = {}
        for side, source, schema in (("prod", self.config.prod, self.prod), ("dev", self.config.dev, self.dev)):
            place = source.path or source.database
            if source.driver == "parquet":
                version = versions.current(place)
                out[side] = {t: versions.stamp(place, t, version) for t in sorted(schema.tables)}
            elif source.driver == "sqlite":
                out[side] = {t: hashlib.sha256(json.dumps(files.listing(place)).encode()).hexdigest() for t in sorted(schema.tables)}
            else:
                return None
        return out

    def check(self) -> list[str]:
        """Tables without a primary key, of either side."""
        return sorted({*self.prod.missing_keys(), *self.dev.missing_keys()})

    def drift(self) -> Drift:
        return schema_drift(self.prod, self.dev)

    def _read(self, source: Source, table: str, key: list[str]) -> DataFrame:
        df = read_table(self.spark, source, table, key, self.config.partitions, self.config.fetch_size)
        if source.driver == "parquet" and self.config.check_keys and (source.path, source.database, table) not in self._unique:
            rowdiff.require_unique(df, key, table)  # a database's primary key is unique by itself
            self._unique.add((source.path, source.database, table))
        return df

    def pairs(self, case_insensitive: bool = True, only: str | None = None) -> dict[str, tuple[DataFrame, DataFrame, list[str]]]:
        """The tables that both sides have, under prod's name, with their data and prod's key."""
        norm = canonical_name if case_insensitive else str
        theirs = {norm(n): n for n in sorted(self.dev.tables)}
        out = {}
        for name, table in sorted(self.prod.tables.items()):
            if norm(name) in theirs and (only is None or canonical_name(only) == canonical_name(name)):
                if not table.primary_key:
                    raise DriftError("NO_PRIMARY_KEY", f"table {name}")
                out[name] = (self._read(self.config.prod, name, table.primary_key), self._read(self.config.dev, theirs[norm(name)], table.primary_key), table.primary_key)
        return out

    def diffs(self, case_insensitive: bool = True, only: str | None = None, status: str = "all", on_drift: str = "all") -> dict[str, DataFrame]:
        """The lazy row difference of each table."""
        return self._diffs(self.pairs(case_insensitive, only), status, on_drift)

    def _diffs(self, pairs: dict, status: str, on_drift: str) -> dict[str, DataFrame]:
        return {t: rowdiff.row_diff(p, d, k, status, self.ignorer(t), on_drift) for t, (p, d, k) in pairs.items()}

    def run(self, resume: bool = False, case_insensitive: bool = True, only: str | None = None, status: str = "all", on_drift: str = "all") -> dict[str, DataFrame]:
        """The differences, computed table by table and kept in the output folder.

        With resume, what an earlier run finished is read back, if it had the same configuration and options and the same input files. Whether a
        network database has changed cannot be told, so that its tables are always compared afresh.
        """
        stamps = self.stamps()
        told = json.dumps([self.config.fingerprint, case_insensitive, only, status, on_drift, stamps], sort_keys=True)
        manifest = Manifest(f"{self.config.output_dir}/rows", hashlib.sha256(told.encode()).hexdigest())
        if not resume or stamps is None:
            manifest.clear()
        pairs = self.pairs(case_insensitive, only)
        many = {t: n for t, n in self._ranges(pairs).items() if n > 1}
        out = run_tables(self.spark, manifest, self._diffs({t: x for t, x in pairs.items() if t not in many}, status, on_drift), self.config.partitions, self.metrics)
        if many:
            sides = {t: (*rowdiff.digests(p, d, k, self.ignorer(t), on_drift), k, status) for t, (p, d, k) in pairs.items() if t in many}
            out |= run_ranges(self.spark, manifest, sides, many, self.config.partitions, self.metrics)
        return out

    def _ranges(self, pairs: dict) -> dict[str, int]:
        """How many key ranges each table's comparison is cut into, each a step that a resumed run need not repeat: as configured, or one for so many bytes of its files.

        Only keys of one type on both sides are cut, as rows are dealt by the key's text.
        """
        out = {}
        for t, (p, d, key) in pairs.items():
            d = aligned(d, p)
            alike = all(p.schema[k].dataType == d.schema[k].dataType for k in key)
            place = self.config.prod.path or self.config.prod.database
            size = sum(s for part in versions.parts(place, t) for _, s, _ in files.listing(part)) if self.config.prod.driver == "parquet" and not self.config.ranges else 0
            out[t] = max(1, self.config.ranges or min(256, size // RANGE_BYTES)) if alike else 1
        return out

    def union(self, diffs: dict[str, DataFrame]) -> DataFrame:
        """The differences of all tables in one; without any table, no rows."""
        none = self.spark.createDataFrame([], "table string, row_key string, status string, prod_hash string, dev_hash string")
        parts = [d.select(F.lit(t).alias("table"), "row_key", "status", "prod_hash", "dev_hash") for t, d in sorted(diffs.items())]
        return reduce(DataFrame.unionByName, parts) if parts else none

    def counts(self) -> DataFrame:
        """(table, side, n_rows) of the tables that both sides have."""
        own = self.pairs()
        sides = [rowdiff.row_counts({t: x[i] for t, x in own.items()}).withColumn("side", F.lit(side)) for i, side in enumerate(("prod", "dev"))] if own else []
        return reduce(DataFrame.unionByName, sides).select("table", "side", "n_rows") if sides else self.spark.createDataFrame([], "table string, side string, n_rows long")

    def resolutions(self, diff: DataFrame) -> DataFrame:
        """The configured policy applied to the conflicts of a union of differences."""
        strategies = self.spark.createDataFrame([(t, s, i) for i, (t, s) in enumerate(self.config.strategies)], "table string, strategy string, ord int")
        return resolve.apply_strategies(diff.where("status = 'updated'").select("table", "row_key", "prod_hash", "dev_hash"), strategies, self.config.default_strategy)

    def cells(self, table: str, status: str = "updated", limit: int | None = None, diff: DataFrame | None = None, pair: tuple | None = None) -> DataFrame:
        """The cells of a table's differing rows, of the first `limit` rows if it is given, without ignored columns."""
        name, (prod, dev, key) = (table, pair) if pair else self.pair(table)
        diff = self.diffs(only=table, status=status)[name] if diff is None else diff
        if limit:
            diff = celldiff.limit_per_table(diff.withColumn("table", F.lit(name)), limit).drop("table", "position")
        return celldiff.cell_diff(diff, prod, dev, key, self.ignorer(name))

    def pair(self, table: str) -> tuple[str, tuple[DataFrame, DataFrame, list[str]]]:
        found = self.pairs(only=table)
        if not found:
            raise DriftError("TABLE_UNKNOWN", f"{table} is not on both sides")
        return found.popitem()

    def ignorer(self, table: str):
        """The test of the names of a table's ignored columns."""
        ignored = column_ignorer(self.config.ignore_columns)
        return lambda column: ignored(table, column)

    def row_cells(self, status: str = "updated", limit: int | None = None, diffs: dict[str, DataFrame] | None = None) -> DataFrame:
        """(table, and the cells) of the differing rows of all tables; of diffs, if they are at hand, nothing is compared again."""
        none = self.spark.createDataFrame([], "table string, row_key string, status string, column string, prod_value string, dev_value string, differs boolean")
        return reduce(DataFrame.unionByName, [self.cells(t, status, limit, None if diffs is None else diffs[t] if status == "all" else diffs[t].where(F.col("status") == status), pair).withColumn("table", F.lit(t)) for t, pair in self.pairs().items()], none)

    def new_columns(self, table: str) -> list[catalog.Column]:
        """The columns that dev's table has and prod's has not, by name, without ignored ones."""
        ignored = column_ignorer(self.config.ignore_columns)
        here = {canonical_name(c) for c in self.prod.tables[table].columns}
        dev = self.dev.find_table(table)
        return [c for _, c in sorted(dev.columns.items()) if canonical_name(c.name) not in here and not ignored(table, c.name)]

    def decided(self, diffs: dict[str, DataFrame], resolutions: DataFrame | None) -> dict[str, DataFrame]:
        """The differences that policy lets through; those of run() are read back, so that nothing is compared again."""
        if resolutions is None:
            return diffs
        own = lambda t: resolutions.where(F.col("table") == t)
        return {t: resolve.filter_diff(d.withColumn("table", F.lit(t)), own(t)).drop("table") for t, d in diffs.items()}

    def packs(self, diffs: dict[str, DataFrame], dialect: Dialect, resolutions: DataFrame | None = None, delete_rows: bool = True) -> dict[str, DataFrame]:
        """The statements of each table's patch, after policy, of the tables in diffs, referenced tables first."""
        pairs, decided = self.pairs(case_insensitive=False), self.decided(diffs, resolutions)
        order = [t for t in creation_order(self.prod) if t in decided and t in pairs]
        return {t: patch.pack_statements(decided[t], *pairs[t][:2], t, pairs[t][2], dialect, delete_rows, [c.name for c in self.new_columns(t)], self.ignorer(t)) for t in order}
