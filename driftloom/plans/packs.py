"""Packs of changes as tables, and their application to a folder of Parquet tables as one new version."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.retry import DriftError
from driftloom.operators import patch
from driftloom.operators.rowdiff import _on, aligned
from driftloom.plans.compare import Comparison
from driftloom.plans.migration import creation_order
from driftloom.sources import files, versions, writes

PACK = "pack.json"
#: Below a pack of scripts, hidden from those who read its texts.
FOLDER = "_parquet"


def write_changes(own: Comparison, diffs: dict[str, DataFrame], resolutions: DataFrame | None, folder: str, stamps: dict) -> str:
    """Write the decided changes of each table as Parquet below the folder: keys that go, rows that come, and dev's new columns of rows that stay.

    pack.json names the pack, the tables and, by stamps taken before anything was compared, the files of both sides that it was made from.
    """
    pairs, tables = own.pairs(case_insensitive=False), {}
    for t, diff in own.decided(diffs, resolutions).items():
        if t not in pairs or diff.isEmpty():
            continue
        prod, dev, key = pairs[t]
        dev, new = aligned(dev, prod), [c.name for c in own.new_columns(t)]
        columns = [c for c in dev.columns if c in key or not own.ignorer(t)(c)]
        at = f"{folder}/changes/{t}"
        diff.where("status IN ('removed', 'updated')").select(*key, F.col("status").alias("change_")).write.parquet(f"{at}/deletes")
        patch.patch_upserts(diff, dev, key, columns).write.parquet(f"{at}/upserts")
        if new:
            put = diff.where("status IN ('added', 'updated')").select(*key).alias("k")
            dev.select(*key, *new).alias("d").join(put, _on("d", "k", key), "left_anti").write.parquet(f"{at}/fills")
        tables[t] = {"key": list(key), "new": new}
    name = uuid.uuid4().hex
    files.write_text(f"{folder}/{PACK}", json.dumps({"id": name, "stamps": stamps, "tables": tables}, indent=1, sort_keys=True))
    return name


def apply_changes(own: Comparison, folder: str, dry_run: bool = False, delete_rows: bool = True, allow_dev_changes: bool = False) -> dict[str, list[str]] | None:
    """Bring prod to what a pack says, as one new version of its folder; the new parts of each changed table. None if the pack was applied before.

    The pack is refused where prod's files, or dev's, are others than it was made from. All changed tables are written first, beside what is there; then the
    new version names them all at once. Of a table only the files that hold keys which go are written anew, unless columns come.
    """
    spark, target = own.spark, own.config.prod.path or own.config.prod.database
    if not files.exists(f"{folder}/{PACK}"):
        raise DriftError("PACK_MISSING", f"{folder} holds no pack of changes")
    pack, base = json.loads(files.read_text(f"{folder}/{PACK}")), versions.current(target)
    if pack["id"] in base.applied:
        return None
    now = own.stamps()
    for side in ("prod",) if allow_dev_changes else ("prod", "dev"):
        if now is None or pack["stamps"] is None or pack["stamps"][side] != now[side]:
            raise DriftError("BASE_CHANGED", f"{side} is not what {folder} was made from")
    if dry_run:
        return {t: [] for t in pack["tables"]}
    made = {}
    try:
        for t, what in pack["tables"].items():
            made[t] = _patched(spark, target, base, t, what["key"], what["new"], f"{folder}/changes/{t}", delete_rows)
        versions.commit(target, base, made, pack["id"])
    except Exception:
        for own_parts in made.values():
            files.remove(f"{target.rstrip('/')}/{own_parts[-1]}")
        raise
    return made


def apply_database(own: Comparison, folder: str, dry_run: bool = False, delete_rows: bool = True) -> dict[str, tuple[int, int]]:
    """Bring a network database to what a pack says, in one transaction; the rows deleted and inserted of each table."""
    if not files.exists(f"{folder}/{PACK}"):
        raise DriftError("PACK_MISSING", f"{folder} holds no pack of changes")
    pack, changes = json.loads(files.read_text(f"{folder}/{PACK}")), {}
    for t in (t for t in creation_order(own.prod) if t in pack["tables"]):
        key, new = pack["tables"][t]["key"], pack["tables"][t]["new"]
        if new:
            raise DriftError("APPLY_FAILED", f"{t} lacks {', '.join(new)}: run schema-migrate's script and make a new pack")
        deletes = own.spark.read.parquet(f"{folder}/changes/{t}/deletes")
        changes[t] = ((deletes if delete_rows else deletes.where("change_ = 'updated'")).select(*key), own.spark.read.parquet(f"{folder}/changes/{t}/upserts"), key)
    return writes.apply_to_database(own.spark, own.config.prod, changes, dry_run)


def _plain(path: str) -> str:
    """A path without scheme, as Spark's and the file systems' forms of it share it."""
    return re.sub(r"^[A-Za-z][\w+.-]*:/+", "/", path)


def _patched(spark: SparkSession, target: str, base: versions.Version, table: str, key: Sequence[str], new: Sequence[str], changes: str, delete_rows: bool) -> list[str]:
    """The parts of a table after its changes: files that none of them touches, and last the new one."""
    prod, part = versions.read(spark, target, table, base), versions.new_part(table)
    deletes, upserts = spark.read.parquet(f"{changes}/deletes"), spark.read.parquet(f"{changes}/upserts")
    deletes = (deletes if delete_rows else deletes.where("change_ = 'updated'")).select(*key)
    found = {_plain(path): path for own in versions.parts(target, table, base) for path, _, _ in files.listing(own)}
    kept: list[str] = []
    root = _plain(files.absolute(target)).rstrip("/") + "/"
    if new:  # rows that stay get dev's values of the columns that come
        fills = spark.read.parquet(f"{changes}/fills").alias("d")
        prod = prod.alias("p").join(fills, _on("p", "d", key), "left").select("p.*", *[f"d.{c}" for c in new])
    elif not any("=" in path.removeprefix(root) for path in found):  # a partition's value stands in the path alone
        named = prod.select(*key, F.col("_metadata.file_path").alias("file_")).alias("p").join(deletes.alias("x"), _on("p", "x", key), "left_semi")
        hit = {_plain(unquote(r[0])) for r in named.select("file_").distinct().collect()}  # names of files, no rows
        kept = sorted(path.removeprefix(root) for path in found if path not in hit)
        prod = spark.read.schema(prod.schema).parquet(*[found[p] for p in sorted(hit)]) if hit else prod.limit(0)
    patch.apply_patch(prod, deletes, upserts, key).write.parquet(f"{target.rstrip('/')}/{part}")
    return [*kept, part]
