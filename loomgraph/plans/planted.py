"""Operators on trees and graphs that are planted once a document: names follow its id, so the results are known in full.

A query builds its input for every row of ``documents``; its SQL states the rows that must come out, written by hand from the formats' rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import projection as p

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Places of a document's planted rows in the order of all.
STEP = 1000


def planted(spark: SparkSession, d: str, schema: str, rows: list[tuple]) -> DataFrame:
    """The rows once a document: ``{id}`` in strings is its id, numbers in ``ord`` count from its own place."""
    table = spark.createDataFrame(rows, schema)
    ids = p.table(spark, d, "documents").where("doc_id is not null").select("doc_id")
    spread = ids.crossJoin(F.broadcast(table))  # a fixed table of a few rows
    key = F.col("doc_id").cast("string")

    def filled(name: str, kind: str):
        if name == "ord":
            return (F.col("doc_id") * STEP + F.col(name)).alias(name)
        if kind == "string":
            return F.replace(F.col(name), F.lit("{id}"), key).alias(name)
        if kind == "array<string>":
            return F.transform(name, lambda x: F.replace(x, F.lit("{id}"), key)).alias(name)
        return F.col(name)

    return spread.select(*[filled(n, k) for n, k in table.dtypes])


def tree(spark: SparkSession, d: str, files: dict[str, str]) -> DataFrame:
    """``path, content`` of the files, once a document."""
    return planted(spark, d, "path string, content string", list(files.items()))


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, int):
        return f"CAST({x} AS BIGINT)"
    if isinstance(x, float):
        return f"CAST({x} AS DOUBLE)"
    if isinstance(x, list):
        return "CAST([" + ", ".join(map(_literal, x)) + "] AS VARCHAR[])"
    return "'" + x.replace("'", "''") + "'"


def expected(columns: list[str], rows: list[tuple]) -> str:
    """SQL for the rows once a document."""
    cols = []
    for k, c in enumerate(columns):
        sample = next((r[k] for r in rows if r[k] is not None), "")
        if c == "ord":
            cols.append(f"doc_id * {STEP} + v.ord AS ord")
        elif isinstance(sample, str):
            cols.append(f"replace(v.\"{c}\", '{{id}}', CAST(doc_id AS VARCHAR)) AS \"{c}\"")
        elif isinstance(sample, list):
            cols.append(f"list_transform(v.\"{c}\", lambda x: replace(x, '{{id}}', CAST(doc_id AS VARCHAR))) AS \"{c}\"")
        else:
            cols.append(f'v."{c}"')
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    names = ", ".join(f'"{c}"' for c in columns)
    return f"SELECT {', '.join(cols)} FROM (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL) d, (VALUES {values}) v({names})"


def example(columns: str, rows: list[tuple]) -> Callable:
    """Registers a query under its function's name with the rows that it must give."""
    names = columns.split()

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, d: str) -> DataFrame:
            df = f(spark, d)
            return df.select(*[F.col(n).cast("long").alias(n) if k in ("int", "smallint", "tinyint") else F.col(n) for n, k in df.select(*names).dtypes])

        QUERIES[f.__name__] = run
        SQL[f.__name__] = expected(names, rows)
        return f

    return put
