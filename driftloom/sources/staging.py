"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from driftloom.sources import files


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode without one a new temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage is cut and a lost executor costs nothing.

    The table stays until the scratch() around it ends, or for good outside of one; a lasting one stays until the next scratch() further out ends.
    """
    path = staged_path(df.sparkSession, name, lasting)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A new place in the shared folder, for one's own writing; it goes when a staged table of that kind would."""
    path = f"{shared_folder(spark)}/driftloom-{name}-{uuid.uuid4().hex}"
    scopes = _own.__dict__.setdefault("scopes", [])
    if len(scopes) > lasting:
        scopes[-1 - lasting].append(path)
    return path


#: The scopes of each thread: what one stages is never another's to delete.
_own = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was staged inside. Results must have been written, or staged as lasting, by then."""
    scopes = _own.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            files.remove(path)
