"""Versioned history: comparisons as content-addressed commits with branches. Metadata are small files; row differences are chunks of Parquet that commits share."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.plans.catalog import Schema
from driftloom.plans.dialects import Dialect
from driftloom.plans.drift import Drift, schema_drift
from driftloom.plans.migration import Gates, migration_script
from driftloom.sources import files
from driftloom.sources.staging import scratch, stage


#: What a commit keeps of each row that differs, and how many rows a chunk of them holds, about.
ROW = ("table", "row_key", "status", "prod_hash", "dev_hash")
CHUNK_ROWS = 1 << 18
#: How many folders a commit's new chunks of a table may take while a folder holds fewer rows than CHUNK_ROWS.
FOLDERS = 256


@dataclass
class Commit:
    message: str
    author: str
    timestamp: str
    parent: str = ""
    prod_schema: dict = field(default_factory=dict)
    dev_schema: dict = field(default_factory=dict)
    counts: dict = field(default_factory=dict)
    data: dict = field(default_factory=dict)
    hash: str = ""

    def compute_hash(self) -> str:
        """SHA-256 of the commit's sorted JSON without the hash, so equal content has equal names."""
        body = json.dumps(asdict(self) | {"hash": ""}, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(f"commit {len(body)}\0{body}".encode()).hexdigest()


class Store:
    """A folder of compressed commits, branch files and HEAD, wherever Spark's file systems reach, and of the chunks that hold commits' row differences."""

    def __init__(self, root: str):
        self.root = f"{root.rstrip('/')}/.driftloom"

    def init(self) -> None:
        if not files.exists(f"{self.root}/HEAD"):
            files.write_text(f"{self.root}/HEAD", "ref: main")

    def _branch_file(self, name: str) -> str:
        return f"{self.root}/refs/{name}"

    def _object(self, h: str) -> str:
        return f"{self.root}/objects/{h[:2]}/{h[2:]}"

    def save(self, commit: Commit) -> str:
        """Store a commit on top of HEAD and move the current branch, or the detached HEAD, to it."""
        commit.parent = self.head() or ""
        commit.hash = commit.compute_hash()
        files.write_text(self._object(commit.hash), base64.b64encode(zlib.compress(json.dumps(asdict(commit), sort_keys=True).encode())).decode())
        branch = self.branch()
        files.write_text(self._branch_file(branch) if branch else f"{self.root}/HEAD", commit.hash)
        return commit.hash

    def resolve(self, name: str) -> str:
        """The full hash of a branch, HEAD or a unique prefix of a hash."""
        if name == "HEAD":
            return self.head() or ""
        if self._is_branch(name) and files.exists(self._branch_file(name)):
            return files.read_text(self._branch_file(name))
        at = f"{self.root}/objects/{name[:2]}"
        found = [name[:2] + x for x in (files.names(at) if files.exists(at) else []) if (name[:2] + x).startswith(name)] if re.fullmatch(r"[0-9a-f]{4,64}", name) else []
        if len(found) != 1:
            raise KeyError(f"{'ambiguous' if found else 'unknown'} version {name!r}")
        return found[0]

    def load(self, name: str) -> Commit:
        h = self.resolve(name)
        commit = Commit(**json.loads(zlib.decompress(base64.b64decode(files.read_text(self._object(h))))))
        if commit.compute_hash() != h:
            raise ValueError(f"commit {h} is damaged")
        return commit

    def branch(self) -> str | None:
        head = files.read_text(f"{self.root}/HEAD")
        return head[5:] if head.startswith("ref: ") else None

    def head(self) -> str | None:
        branch = self.branch()
        if branch is None:
            return files.read_text(f"{self.root}/HEAD")
        return files.read_text(self._branch_file(branch)) if files.exists(self._branch_file(branch)) else None

    @staticmethod
    def _is_branch(name: str) -> bool:
        return bool(re.fullmatch(r"[^\s/\\]+", name)) and name not in (".", "..", "HEAD")

    def branches(self) -> list[str]:
        """All branches, the current one even before its first commit."""
        refs = f"{self.root}/refs"
        return sorted({n for n in (files.names(refs) if files.exists(refs) else []) if not n.startswith(".")} | ({self.branch()} - {None}))

    def create_branch(self, name: str, at: str = "HEAD") -> None:
        if not self._is_branch(name):
            raise ValueError(f"{name!r} is no branch name")
        if files.exists(self._branch_file(name)):
            raise ValueError(f"branch {name} exists")
        if not (h := self.resolve(at)):
            raise ValueError("there is no commit yet")
        files.write_text(self._branch_file(name), h)

    def checkout(self, name: str) -> None:
        """To a branch, or detached to a commit."""
        files.write_text(f"{self.root}/HEAD", f"ref: {name}" if name in self.branches() else self.resolve(name))

    def log(self, limit: int = 20, start: str = "HEAD") -> list[Commit]:
        out, at = [], self.resolve(start)
        while at and len(out) < limit:
            out.append(self.load(at))
            at = out[-1].parent
        return out

    def reachable(self, start: str) -> set[str]:
        return {c.hash for c in self.log(1 << 30, start)}

    def tree(self) -> str:
        """All commits, newest first, with a lane per branch."""
        own = {b: self.reachable(b) for b in self.branches() if files.exists(self._branch_file(b))}
        tips = {b: self.resolve(b) for b in own}
        commits = sorted((self.load(h) for h in set().union(*own.values())), key=lambda c: (c.timestamp, c.hash), reverse=True) if own else []
        head = self.head()
        lines = []
        for c in commits:
            lanes = " ".join("*" if c.hash in seen else " " for seen in own.values())
            names = [b for b, h in tips.items() if h == c.hash] + (["HEAD"] if c.hash == head else [])
            lines.append(f"{lanes}  {c.hash[:8]} {c.message}" + (f" ({', '.join(names)})" if names else ""))
        return "\n".join(lines) + "\n" if lines else "no commits\n"

    def diff(self, old: str, new: str) -> Drift:
        """How the dev schema changed between two versions."""
        return schema_drift(Schema.from_dict(self.load(old).dev_schema), Schema.from_dict(self.load(new).dev_schema))

    def save_rows(self, diff: DataFrame, chunk_rows: int = CHUNK_ROWS) -> dict[str, list[str]]:
        """Store the row differences (table, row_key, status, prod_hash, dev_hash) of a comparison for a commit; the names of each table's chunks.

        A table is cut by a hash of the key into about chunk_rows rows each, their number a power of two, and a chunk is named by a digest of
        its rows. So a chunk whose rows did not change has its old name and is not written again, whichever commit it comes from. A chunk has
        its own folder; where chunks are small and many, new ones share folders, so that the number of files does not grow with them.
        """
        spark = diff.sparkSession
        with scratch(spark):
            rows = stage(diff.select(*ROW), "version-rows")
            sizes = rows.groupBy("table").agg(F.count("*").alias("rows"))
            parts = lambda n: F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("rows") / n, F.lit(1.0))))).cast("long")
            cuts = sizes.select("table", parts(chunk_rows).alias("cuts"), F.least(parts(chunk_rows), F.greatest(F.lit(FOLDERS), parts(CHUNK_ROWS))).alias("folders"))
            dealt = rows.join(F.broadcast(cuts), "table").withColumn("at", F.pmod(F.xxhash64("row_key"), F.col("cuts")))
            text = F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in ROW])
            marks = [F.bit_xor(F.xxhash64(F.lit(i), F.sha2(text, 256))).alias(f"m{i}") for i in range(4)]
            named = dealt.groupBy("table", "cuts", "folders", "at").agg(F.count("*").alias("n"), *marks)
            named = stage(named.select("table", "at", (F.col("at") % F.col("folders")).alias("slot"), F.sha2(F.concat_ws(",", "table", "cuts", "at", "n", *[f"m{i}" for i in range(4)]), 256).alias("chunk")), "version-chunks")
            chunks = f"{self.root}/chunks"
            known = {n.removeprefix("chunk=") for n in files.names(chunks)} | self._shared().keys() if files.exists(chunks) else set()
            names, slots = {}, {}
            for r in named.orderBy("table", "at").collect():  # a row per chunk
                names.setdefault(r["table"], []).append(r["chunk"])
                if r["chunk"] not in known:
                    slots.setdefault((r["table"], r["slot"]), []).append(r["chunk"])
            fresh = {own[0] if len(own) == 1 else hashlib.sha256(",".join(own).encode()).hexdigest(): own for own in slots.values()}
            if fresh:
                wanted = spark.createDataFrame([(c, folder) for folder, own in fresh.items() for c in own], "chunk string, folder string")
                new = dealt.join(named.join(wanted, "chunk"), ["table", "at"])
                part = f"{self.root}/new-{uuid.uuid4().hex}"
                new.select(*ROW, "chunk", "folder").repartition("folder").write.partitionBy("folder").parquet(part)
                for folder in fresh:
                    if not files.exists(f"{chunks}/chunk={folder}"):  # another commit may have come first with the same rows
                        files.move(f"{part}/folder={folder}", f"{chunks}/chunk={folder}")
                files.remove(part)
                if shared := {folder: own for folder, own in fresh.items() if len(own) > 1}:
                    files.write_text(f"{self.root}/shared/{uuid.uuid4().hex}", json.dumps(shared))
        return names

    def _shared(self) -> dict[str, str]:
        """The folder of each chunk that lies in one with others."""
        at = f"{self.root}/shared"
        lists = [json.loads(files.read_text(f"{at}/{n}")) for n in files.names(at) if not n.endswith(".new")] if files.exists(at) else []
        return {c: folder for own in lists for folder, chunks in own.items() for c in chunks}

    def _rows_of(self, spark: SparkSession, chunks: Iterable[str]) -> DataFrame:
        schema, shared = ", ".join(f"`{c}` string" for c in ROW), self._shared()
        load = lambda folders, schema: spark.read.schema(schema).parquet(*[f"{self.root}/chunks/chunk={x}" for x in sorted(folders)])
        alone, beside = ([c for c in sorted(chunks) if (c in shared) == with_others] for with_others in (False, True))
        found = [load(alone, schema)] if alone else []
        if beside:
            wanted = spark.createDataFrame([(c,) for c in beside], "chunk string")
            found.append(load({shared[c] for c in beside}, f"{schema}, chunk string").join(wanted, "chunk", "left_semi").select(*ROW))
        return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)

    def rows(self, spark: SparkSession, name: str) -> DataFrame:
        """The row differences that a version holds."""
        return self._rows_of(spark, {c for own in self.load(name).data.values() for c in own})

    def data_diff(self, spark: SparkSession, old: str, new: str) -> DataFrame:
        """(table, row_key, change, old_status, new_status, and both versions' hashes) of the rows whose difference changed between two versions.

        Chunks that both versions name hold the same rows and are not read.
        """
        a, b = ({c for own in self.load(x).data.values() for c in own} for x in (old, new))
        left, right = self._rows_of(spark, a - b).alias("o"), self._rows_of(spark, b - a).alias("n")
        both = left.join(right, (F.col("o.table") == F.col("n.table")) & (F.col("o.row_key") == F.col("n.row_key")), "full_outer")
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ROW[2:]]
        change = F.when(F.col("o.table").isNull(), "appeared").when(F.col("n.table").isNull(), "resolved").otherwise("changed")
        found = both.where(~reduce(and_, same) | F.col("o.table").isNull() | F.col("n.table").isNull())
        return found.select(F.coalesce("o.table", "n.table").alias("table"), F.coalesce("o.row_key", "n.row_key").alias("row_key"), change.alias("change"), *[F.col(f"{x}.{c}").alias(f"{side}_{c}") for c in ROW[2:] for x, side in (("o", "old"), ("n", "new"))])

    def rollback_script(self, name: str, dialect: Dialect, gates: Gates = Gates()) -> str:
        """The script that undoes a version's schema drift: from its dev schema back to its prod schema."""
        c = self.load(name)
        return migration_script(Schema.from_dict(c.dev_schema), Schema.from_dict(c.prod_schema), dialect, gates)


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def commit_depths(commits: DataFrame) -> DataFrame:
    """(hash, root, depth) of every commit of a table (hash, parent), by pointer doubling: for histories too long to walk on the driver.

    Only ways that do not end at a root yet are joined, with the pointers of commits that have children; the others are taken over. Both
    sides grow with the history, so they are shuffled at every size, however small their files are.
    """
    root = F.col("parent").isNull()
    jump = commits.select("hash", F.coalesce("parent", "hash").alias("to"), F.when(root, 0).otherwise(1).cast("long").alias("depth"), (~root).alias("open"))
    inner = commits.select(F.col("parent").alias("hash")).where("hash IS NOT NULL").distinct()
    leaves = stage(jump.join(inner.hint("merge"), "hash", "left_anti"), "depths-leaves")
    jump = stage(jump.join(inner.hint("merge"), "hash", "left_semi"), "depths")

    def moved(rows: DataFrame) -> DataFrame:
        ahead = jump.select(F.col("hash").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"), F.col("open").alias("further"))
        ways = rows.where("open").join(ahead.hint("merge"), "to").select("hash", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), F.col("further").alias("open"))
        return ways.unionByName(rows.where("NOT open"))

    while not jump.where("open").isEmpty():
        jump = stage(moved(jump), "depths")
    return stage(jump.unionByName(moved(leaves)).select("hash", F.col("to").alias("root"), "depth"), "depths")


def log_of(commits: DataFrame, head) -> DataFrame:
    """(hash, back) of the commits that a head of a table (hash, parent) reaches, itself first: how many steps each lies back.

    Round k joins what is reached with the pointers of 2**k steps, so rounds grow with the logarithm of the longest way.
    Commits without children point from nowhere and are left out, but for the head. Joins shuffle both sides, as above.
    """
    seen = stage(commits.where(F.col("hash") == head).select("hash", F.lit(0).cast("long").alias("back")), "log")
    jump, step = commits.where("parent IS NOT NULL").select("hash", F.col("parent").alias("to")), 1
    inner = jump.select(F.col("to").alias("hash")).unionByName(seen.select("hash")).distinct()
    jump = stage(jump.join(inner.hint("merge"), "hash", "left_semi"), "log-jumps")
    while True:
        further = stage(seen.join(jump.hint("merge"), "hash").select(F.col("to").alias("hash"), (F.col("back") + step).alias("back")), "log")
        if further.isEmpty():
            return seen
        seen = seen.unionByName(further)
        jump = stage(jump.join(jump.toDF("to", "next").hint("merge"), "to").select("hash", F.col("next").alias("to")), "log-jumps")
        step *= 2
