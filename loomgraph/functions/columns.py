"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(key: Column, *tables: dict, default: Column | None = None) -> Column:
    """Small fixed tables (``value: [keys]``) as one CASE, inside code generation; of several tables the last that has a key counts. Without a default, null where none has it."""
    out = F
    for table in reversed(tables):
        for value, keys in table.items():
            out = out.when(key.isin(keys), F.lit(value))
    return out if default is None else out.otherwise(default)


def mapped(key: Column, table: dict) -> Column:
    """A caller's table (``key: value``) as a map; null where the key is not in it."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair]).cast("map<string,string>")[key]


def utf16_order(text: Column) -> Column:
    """A key that orders strings by their UTF-16 code units."""
    return F.encode(text, "UTF-16BE")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def number_prefix(text: Column) -> Column:
    """The number a string begins with, null if there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
