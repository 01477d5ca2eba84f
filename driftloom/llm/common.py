"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.sources.staging import scratch, stage

__all__ = ["BROADCAST_BYTES", "SPACE", "WORD", "free_name", "let", "maybe_broadcast", "scratch", "small", "stage", "text_of", "words_of"]

#: ASCII white space as the operators' contracts define it; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A side is broadcast only when its measured rows times their width stay under this.
BROADCAST_BYTES = 16 << 20


def text_of(column: str = "text") -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The array of words of a text."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once per row, however often use names it."""
    return F.transform(F.array(value), use)[0]


def free_name(name: str, df: DataFrame) -> str:
    """name, or name with _ added until no column of df is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a staged table's rows, counted, are few enough to broadcast: row_bytes each and what their texts and binaries measure besides."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    total = F.count("*") * row_bytes + (F.coalesce(F.sum(reduce(add, texts)), F.lit(0)) if texts else F.lit(0))
    return df.agg(total).first()[0] <= limit


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A staged table, marked for broadcast if its counted size allows it; else Spark shuffles."""
    return F.broadcast(df) if small(df, row_bytes, limit) else df
