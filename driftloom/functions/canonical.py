"""Canonical texts of identifiers, values, keys and rows: what two sides must agree on to count as equal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How a null reads in keys and hashes of the compatible mode.
NULL_TEXT = "<nil>"


def canonical_name(name: str) -> str:
    """The form in which names are matched; the name itself stays for output."""
    return name.strip().lower()


def canonical(name: Column) -> Column:
    return F.lower(F.trim(name))


def value_text(value: Column, kind: T.DataType, doubles: str = "cast") -> Column:
    """A value as text, null staying null.

    Decimals, integers, dates, times without zone and booleans are cast. Binary that is valid UTF-8 is that text; other bytes, and text that
    begins with the mark itself, are \\x and hexadecimal digits, so that no two values read alike. doubles="cast" keeps Spark's text of
    floating-point numbers, "decimal" rounds them to six places first, so that other engines agree at every magnitude.
    """
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) and doubles == "decimal":
        return value.cast("decimal(38,6)").cast("string")
    if isinstance(kind, T.BinaryType):
        text = value.cast("string")
        return F.when(F.is_valid_utf8(text) & ~F.startswith(text, F.lit("\\x")), text).otherwise(F.concat(F.lit("\\x"), F.lower(F.hex(value))))
    return value.cast("string")


def column_text(df: DataFrame, name: str, doubles: str = "cast") -> Column:
    return value_text(F.col(f"`{name}`"), df.schema[name].dataType, doubles)


def ordered_columns(columns: Sequence[str], key: Sequence[str], ignored=lambda name: False) -> list[str]:
    """The columns that make a row's hash: the key in its order, then the others by canonical name, without ignored ones. Key columns are never ignored."""
    by_name = {canonical_name(c): c for c in columns}
    own = [by_name[canonical_name(k)] for k in key]
    rest = sorted((c for c in columns if c not in own and not ignored(c)), key=canonical_name)
    return own + rest


def display_columns(columns: Sequence[str], key: Sequence[str]) -> list[str]:
    """The key, then the others by name; nothing is ignored."""
    return ordered_columns(columns, key)


def shared_columns(ours: Sequence[str], theirs: Sequence[str], key: Sequence[str], ignored=lambda name: False) -> list[str]:
    """The key, then the sorted other columns that both sides have."""
    names = {canonical_name(c) for c in theirs}
    return [c for c in ordered_columns(ours, key, ignored) if canonical_name(c) in names or canonical_name(c) in map(canonical_name, key)]


def row_key(df: DataFrame, key: Sequence[str], doubles: str = "cast") -> Column:
    """The key's values joined with |. For display and files; joins use the typed key columns."""
    return F.concat_ws("|", *[F.coalesce(column_text(df, k, doubles), F.lit(NULL_TEXT)) for k in key])


def row_hash(df: DataFrame, columns: Sequence[str], mode: str = "compat", doubles: str = "cast") -> Column:
    """SHA-256 of a row's text."""
    return F.sha2(row_text(df, columns, mode, doubles), 256)


def row_text(df: DataFrame, columns: Sequence[str], mode: str = "compat", doubles: str = "cast") -> Column:
    """A row as `name=value` lines in the given order.

    mode="compat" writes nulls as <nil>; "safe" prefixes every value with its length and nulls with -1, so that no value
    can be read as another.
    """
    parts: list[Column] = []
    end = ""
    for c in columns:
        text = column_text(df, c, doubles)
        parts.append(F.lit(f"{end}{canonical_name(c)}="))
        if mode == "safe":
            parts.append(F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-1:")))
        else:
            parts.append(F.coalesce(text, F.lit(NULL_TEXT)))
        end = "\n"
    return F.concat(*parts, F.lit(end))


def split_key(key: Column, parts: int) -> Column:
    """The parts of a row key's text; null unless there are just as many."""
    found = F.split(key, r"\|", -1)
    return F.when(F.size(found) == parts, found)


# --- texts of schema objects


def normal_type(x: Column) -> Column:
    return F.lower(F.trim(x))


def normal_default(x: Column) -> Column:
    """Trimmed, without one pair of matching quotes; null, no default, stays null."""
    return F.regexp_replace(F.trim(x), r"^(?:'(.*)'|\"(.*)\")$", "$1$2")


def normal_action(x: Column) -> Column:
    """A foreign key's action; none is NO ACTION."""
    own = F.upper(F.trim(F.coalesce(x, F.lit(""))))
    return F.when(own == "", "NO ACTION").otherwise(own)


def normal_definition(x: Column) -> Column:
    """A definition's text, white space as single blanks, in lower case."""
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


# --- texts of values in SQL


#: How an engine writes bytes, around their hexadecimal digits.
_BYTES = {"mysql": ("X'", "'"), "sqlite": ("X'", "'"), "postgres": ("'\\x", "'::bytea"), "mssql": ("0x", ""), "oracle": ("HEXTORAW('", "')")}


def sql_literal(value: Column, kind: T.DataType, typed: bool = False, driver: str = "postgres") -> Column:
    """A value as SQL of an engine. Numbers are quoted unless typed asks for bare ones; times keep their fraction, as their type tells.

    Bytes are hexadecimal in the engine's form; backslashes are doubled for MySQL alone, where they escape.
    """
    text = value_text(value, kind)
    inside = F.replace(text, F.lit("\\"), F.lit("\\\\")) if driver == "mysql" else text
    quoted = F.concat(F.lit("'"), F.replace(inside, F.lit("'"), F.lit("''")), F.lit("'"))
    if isinstance(kind, T.BooleanType):
        quoted = F.upper(text)
    elif isinstance(kind, T.BinaryType):
        head, tail = _BYTES[driver]
        quoted = F.concat(F.lit(head), F.lower(F.hex(value)), F.lit(tail))
    elif typed and isinstance(kind, T.NumericType):
        quoted = text
    return F.when(value.isNull(), "NULL").otherwise(quoted)


def display_value(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("NULL"))


def truncated(value: Column, length: int) -> Column:
    return F.when(F.char_length(value) > length, F.concat(F.substring(value, 1, length - 3), F.lit("..."))).otherwise(value)


def decision_label(decision: Column) -> Column:
    return F.when(decision == "keep_prod", "Keep Production").when(decision == "use_dev", "Use Development").when(decision == "pending", "Pending").otherwise(decision)
