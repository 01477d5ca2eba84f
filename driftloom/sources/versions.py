"""Versions of a folder of Parquet tables.

A manifest says for every table that was ever replaced which files and folders hold it now; a table that none names is the folder's own
`<table>.parquet`. Manifests are numbered, the last one counts, and each is made by one rename that fails if its number is taken: all
tables of a version change at once, readers see the old version or the new one, and of two writers one is refused.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from driftloom.functions.retry import DriftError
from driftloom.sources import files


@dataclass(frozen=True)
class Version:
    """What a folder holds: the parts of replaced tables, below the folder, and the packs that have been applied."""

    number: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    applied: tuple[str, ...] = ()


def _manifests(folder: str) -> str:
    return f"{folder.rstrip('/')}/_versions"


def current(folder: str) -> Version:
    """The last version; without any, the folder's own tables."""
    at = _manifests(folder)
    own = [n for n in (files.names(at) if files.exists(at) else []) if n.endswith(".json")]
    if not own:
        return Version()
    found = json.loads(files.read_text(f"{at}/{max(own)}"))
    return Version(found["number"], found["tables"], tuple(found["applied"]))


def commit(folder: str, base: Version, tables: dict[str, list[str]], pack: str) -> Version:
    """The version after base with these tables replaced; an error if another came in between."""
    new = Version(base.number + 1, base.tables | tables, (*base.applied, pack))
    text = json.dumps({"number": new.number, "tables": new.tables, "applied": new.applied}, indent=1, sort_keys=True)
    if not files.create_text(f"{_manifests(folder)}/{new.number:012d}.json", text):
        raise DriftError("BASE_CHANGED", f"version {new.number} of {folder} was made by another run")
    return new


def parts(folder: str, table: str, version: Version | None = None) -> list[str]:
    """The paths that hold a table now."""
    version = version or current(folder)
    return [f"{folder.rstrip('/')}/{p}" for p in version.tables.get(table, [f"{table}.parquet"])]


def table_names(folder: str) -> list[str]:
    """The tables of a folder, with those that only a version has."""
    own = {n.removesuffix(".parquet") for n in files.names(folder) if n.endswith(".parquet")}
    return sorted(own | set(current(folder).tables))


def read(spark: SparkSession, folder: str, table: str, version: Version | None = None) -> DataFrame:
    return spark.read.parquet(*parts(folder, table, version))


def new_part(table: str) -> str:
    """A place below the folder for a table's new files; readers never list it by themselves."""
    return f"_versions/data/{table}-{uuid.uuid4().hex}"


def stamp(folder: str, table: str, version: Version | None = None) -> str:
    """A digest of the names, sizes and times of the files that hold a table: another one means that it may have changed."""
    own = sorted((path, size, time) for part in parts(folder, table, version) for path, size, time in files.listing(part))
    return hashlib.sha256(json.dumps(own).encode()).hexdigest()
