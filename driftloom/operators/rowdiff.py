"""Row comparison of two versions of a table: scan, project, hash, join on the typed key, classify."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.canonical import canonical, canonical_name, ordered_columns, row_hash, row_key, row_text, shared_columns
from driftloom.functions.retry import DriftError

ADDED, REMOVED, UPDATED, UNCHANGED = "added", "removed", "updated", "unchanged"


class MissingKey(ValueError):
    """A table cannot be compared by key."""


def aligned(df: DataFrame, like: DataFrame, case_insensitive: bool = True) -> DataFrame:
    """df with columns renamed to the spelling of like where only case and blanks differ."""
    if not case_insensitive:
        return df
    spelling = {canonical_name(c): c for c in like.columns}
    return df.toDF(*[spelling.get(canonical_name(c), c) for c in df.columns])


def hashed(df: DataFrame, key: Sequence[str], ignored: Callable[[str], bool] = lambda name: False, columns: Sequence[str] | None = None, mode: str = "compat", doubles: str = "cast") -> DataFrame:
    """(key columns, row_key, row_hash) of every row. Only the hashed columns are read."""
    if not key:
        raise MissingKey("the table has no primary key; use multiset_diff")
    columns = list(columns) if columns is not None else ordered_columns(df.columns, key, ignored)
    return df.select(*key, row_key(df, key, doubles).alias("row_key"), row_hash(df, columns, mode, doubles).alias("row_hash"))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with their number of rows; keys must be unique before tables are compared."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, key: Sequence[str], table: str) -> None:
    """Raise where rows share a key: they would meet each row of the other side. One narrow aggregate, combined before its shuffle."""
    found = duplicate_keys(df, key).limit(3).collect()
    if found:
        raise DriftError("DUPLICATE_KEY", f"table {table}: {', '.join(str(tuple(r)[:-1]) for r in found)}")


def _on(left: str, right: str, key: Sequence[str]) -> Column:
    return reduce(and_, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in key])


def digests(prod: DataFrame, dev: DataFrame, key: Sequence[str], ignored: Callable[[str], bool] = lambda name: False, on_drift: str = "all", mode: str = "compat", doubles: str = "cast") -> tuple[DataFrame, DataFrame]:
    """(key columns, digest) of each side's rows, over the columns that on_drift compares."""
    dev = aligned(dev, prod)
    if on_drift == "intersect":
        own = shared_columns(prod.columns, dev.columns, key, ignored)
        return _digests(prod, key, own, mode, doubles), _digests(dev, key, own, mode, doubles)
    return tuple(_digests(x, key, ordered_columns(x.columns, key, ignored), mode, doubles) for x in (prod, dev))


def row_diff(prod: DataFrame, dev: DataFrame, key: Sequence[str], status: str = "all", ignored: Callable[[str], bool] = lambda name: False, on_drift: str = "all", mode: str = "compat", doubles: str = "cast") -> DataFrame:
    """(key columns, row_key, status, prod_hash, dev_hash) of every row that differs.

    added: only dev has the key; removed: only prod; updated: the hashes differ. The join follows the status asked for, as no
    optimizer infers it from a CASE: an inner join for updated, an anti-join for added or removed, a full one for all. Columns of one
    side alone make every common row updated (on_drift="all") or are left out (on_drift="intersect"). Column names are
    matched case apart.
    """
    p, d = digests(prod, dev, key, ignored, on_drift, mode, doubles)
    return diff_of_digests(p, d, key, status, doubles)


def diff_of_digests(p: DataFrame, d: DataFrame, key: Sequence[str], status: str = "all", doubles: str = "cast", null_keys: bool = True) -> DataFrame:
    """The row difference of two sides' (key columns, digest). Without null keys they are joined by plain equality, which suits tables stored by key."""
    p, d, on, of = _plain_keys(p, d, key) if null_keys else (p.alias("p"), d.alias("d"), reduce(and_, [F.col(f"p.{k}") == F.col(f"d.{k}") for k in key]), None)
    of = of or (lambda *sides: [F.coalesce(*[F.col(f"{side}.{k}") for side in sides]).alias(k) for k in key])
    ours, theirs, none = F.col("p.digest").alias("ours"), F.col("d.digest").alias("theirs"), F.lit(None).cast("binary")
    if status == ADDED:
        found = d.join(p, on, "left_anti").select(*of("d"), F.lit(ADDED).alias("status"), none.alias("ours"), theirs)
    elif status == REMOVED:
        found = p.join(d, on, "left_anti").select(*of("p"), F.lit(REMOVED).alias("status"), ours, none.alias("theirs"))
    elif status == UPDATED:
        found = p.join(d, on).where("p.digest <> d.digest").select(*of("p"), F.lit(UPDATED).alias("status"), ours, theirs)
    else:
        what = F.when(F.col("p.digest").isNull(), ADDED).when(F.col("d.digest").isNull(), REMOVED).otherwise(UPDATED)
        both = p.join(d, on, "full_outer").where("NOT (p.digest <=> d.digest)")
        found = both.select(*of("p", "d"), what.alias("status"), ours, theirs)
    text = lambda digest: F.lower(F.hex(digest))
    return found.select(*key, row_key(found, key, doubles).alias("row_key"), "status", text("ours").alias("prod_hash"), text("theirs").alias("dev_hash"))


def _plain_keys(p: DataFrame, d: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame, Column, Callable[..., list[Column]] | None]:
    """Both sides, as p and d, the condition under which keys are equal, nulls too, and what gives the key columns back, or None where both still have them.

    Null-safe equality would take two join keys for each column; here nulls are filled and one number says which. What is shuffled are the filled columns alone.
    """
    fills = [_FILLS.get(p.schema[k].dataType.typeName()) if p.schema[k].dataType == d.schema[k].dataType else None for k in key]
    if len(key) < 2 or None in fills:
        return p.alias("p"), d.alias("d"), _on("p", "d", key), None
    nulls = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(f"`{k}`").isNull(), 1 << i).otherwise(0) for i, k in enumerate(key)])
    filled = [F.coalesce(F.col(f"`{k}`"), F.lit(x).cast(p.schema[k].dataType)).alias(f"_key{i}") for i, (k, x) in enumerate(zip(key, fills, strict=True))]
    p, d = (x.select(*filled, nulls.alias("_nulls"), "digest").alias(side) for x, side in ((p, "p"), (d, "d")))

    def of(*sides: str) -> list[Column]:
        own = lambda c: F.coalesce(*[F.col(f"{side}.{c}") for side in sides])
        return [F.when(own("_nulls").bitwiseAND(F.lit(1 << i)) == 0, own(f"_key{i}")).alias(k) for i, k in enumerate(key)]

    return p, d, reduce(and_, [F.col(f"p.{c}") == F.col(f"d.{c}") for c in [*[f"_key{i}" for i in range(len(key))], "_nulls"]]), of


#: By type, what stands for a null among the join keys.
_FILLS = {"byte": 0, "short": 0, "integer": 0, "long": 0, "decimal": 0, "float": 0, "double": 0, "string": "", "date": "1970-01-01", "timestamp": "1970-01-01"}


def _digests(df: DataFrame, key: Sequence[str], columns: Sequence[str], mode: str, doubles: str) -> DataFrame:
    """(key columns, digest): what is shuffled of each row is its typed key and 32 bytes; texts of keys and hashes are made of rows that differ."""
    if not key:
        raise MissingKey("the table has no primary key; use multiset_diff")
    return df.select(*key, F.unhex(row_hash(df, columns, mode, doubles)).alias("digest"))


def conflicts(prod: DataFrame, dev: DataFrame, key: Sequence[str], table: str, **options) -> DataFrame:
    """(table, row_key, prod_hash, dev_hash) of the rows that both sides have and differ in."""
    return row_diff(prod, dev, key, UPDATED, **options).select(F.lit(table).alias("table"), "row_key", "prod_hash", "dev_hash")


def diff_tables(pairs: dict[str, tuple[DataFrame, DataFrame, Sequence[str]]], **options) -> DataFrame:
    """The row differences of many tables as (table, row_key, status, prod_hash, dev_hash): one lazy plan, one branch per table."""
    parts = [row_diff(p, d, k, **options).select(F.lit(t).alias("table"), "row_key", "status", "prod_hash", "dev_hash") for t, (p, d, k) in sorted(pairs.items())]
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows) of many tables in one plan; no column is read."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table"), "n_rows") for t, df in sorted(tables.items())])


def diff_counts(diff: DataFrame) -> DataFrame:
    """Added, removed and updated rows of each table."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return diff.groupBy("table").agg(count(ADDED), count(REMOVED), count(UPDATED))


def status_counts(pairs: dict[str, tuple[DataFrame, DataFrame, Sequence[str]]], ignored: Callable[[str], bool] = lambda name: False, mode: str = "compat", doubles: str = "cast") -> DataFrame:
    """diff_counts of many tables where no hash is asked for: rows meet by grouping on the key with 128 bits of their texts, without sorting, and each table is counted by itself."""
    parts = []
    for table, (prod, dev, key) in sorted(pairs.items()):
        sides = []
        for side, df in enumerate((prod, aligned(dev, prod))):
            text = row_text(df, ordered_columns(df.columns, key, ignored), mode, doubles)
            own = df.select(*key, text.alias("text_")).select(*key, F.xxhash64("text_").alias("h1_"), F.xxhash64(F.lit(1), "text_").alias("h2_"))
            sides.append(own.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)], *[(F.col(h) if s == side else F.lit(None).cast("long")).alias(f"{s}{h}") for s in (0, 1) for h in ("h1_", "h2_")]))
        met = sides[0].unionByName(sides[1]).groupBy(*[f"k{i}" for i in range(len(key))]).agg(*[F.max(f"{s}{h}").alias(f"{s}{h}") for s in (0, 1) for h in ("h1_", "h2_")])
        ours, theirs = F.col("0h1_").isNull(), F.col("1h1_").isNull()
        differ = (F.col("0h1_") != F.col("1h1_")) | (F.col("0h2_") != F.col("1h2_"))
        counts = met.agg(F.count_if(ours).alias(ADDED), F.count_if(theirs).alias(REMOVED), F.count_if(~ours & ~theirs & differ).alias(UPDATED))
        parts.append(counts.select(F.lit(table).alias("table"), ADDED, REMOVED, UPDATED))
    return reduce(DataFrame.unionByName, parts).where(F.col(ADDED) + F.col(REMOVED) + F.col(UPDATED) > 0)


def diff_totals(diff: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return diff.agg(F.count_distinct("table").alias("tables"), count(ADDED), count(REMOVED), count(UPDATED), F.count("*").alias("total"))


def has_changes(diff: DataFrame) -> bool:
    return not diff.isEmpty()


def multiset_diff(prod: DataFrame, dev: DataFrame) -> DataFrame:
    """Rows without a key, compared as multisets: each row with the number of copies that prod or dev has too many."""
    dev = aligned(dev, prod).select(prod.columns)
    signed = prod.withColumn("_n", F.lit(1)).unionByName(dev.withColumn("_n", F.lit(-1)))
    found = signed.groupBy(prod.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return found.select(*prod.columns, F.when(F.col("_n") > 0, REMOVED).otherwise(ADDED).alias("status"), F.abs("_n").alias("copies"))


def pair_tables(prod: DataFrame, dev: DataFrame, name: str = "table", case_insensitive: bool = True) -> DataFrame:
    """(prod_table, dev_table) of the tables that both sides have, matched by canonical or by exact name; prod's name is the one reported."""
    norm = canonical if case_insensitive else (lambda c: c)
    p = prod.groupBy(norm(F.col(name)).alias("k")).agg(F.max(name).alias("prod_table"))
    d = dev.groupBy(norm(F.col(name)).alias("k")).agg(F.max(name).alias("dev_table"))
    return p.join(d, "k").select("prod_table", "dev_table")


def missing_keys(tables: DataFrame, keys: DataFrame, ignored: Sequence[str] = ()) -> DataFrame:
    """The tables without a primary key, but for ignored ones."""
    names = [canonical_name(x) for x in ignored]
    found = tables.join(keys.select("table").distinct(), "table", "left_anti")
    return found.where(~canonical(F.col("table")).isin(names)) if names else found


# --- reading by key


def after_key(key: Sequence[str], last: Sequence) -> Column:
    """Rows whose key comes after last, compared column by column; pushed down to the scan as plain comparisons."""
    tests = [reduce(and_, [F.col(k) == v for k, v in zip(key[:i], last[:i], strict=True)] + [F.col(key[i]) > last[i]]) for i in range(len(key))]
    return reduce(or_, tests)


def keyset_page(df: DataFrame, key: Sequence[str], n: int, last: Sequence | None = None) -> DataFrame:
    """The next n rows in key order after the key last, or the first n."""
    page = df if last is None else df.where(after_key(key, last))
    return page.orderBy(*key).limit(n)


def row_lookup(df: DataFrame, key: dict[str, object]) -> DataFrame:
    """The row with that key: equality tests that the scan can use."""
    return df.where(reduce(and_, [F.col(k) == v for k, v in key.items()]))


def rows_for_keys(df: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows whose keys are in keys: one semi-join instead of a lookup per key."""
    k = keys.select(*key).distinct().alias("k")
    return df.alias("t").join(k, _on("t", "k", key), "left_semi")
