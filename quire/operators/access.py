"""The generic access layer: parameterised selection, point reads, writes of whole versions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def select(
    table: DataFrame, columns: Sequence[str | Column] = (), where: Column | None = None, distinct: bool = False, group_by: Sequence[str] = (), aggregates: Sequence[Column] = (),
    having: Column | None = None, order_by: Sequence[str | Column] = (), limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """One SELECT over one table. An order with ties is an order without promise: name a unique key last."""
    out = table if where is None else table.where(where)
    if group_by or aggregates:
        out = out.groupBy(*group_by).agg(*(aggregates or [F.count("*").alias("count")]))
        out = out if having is None else out.where(having)
    out = out.select(*columns) if columns else out
    out = out.distinct() if distinct else out
    out = out.orderBy(*order_by) if order_by else out
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def single(table: DataFrame, **args) -> DataFrame:  # noqa: ANN003
    """The first row of `select`, or none."""
    return select(table, **args | {"limit": 1})


def statement(spark: SparkSession, sql: str, args: dict | list | None = None, **tables: DataFrame) -> DataFrame:
    """A SQL statement with parameters bound by the engine, over tables named in braces. It is not limited to one row."""
    return spark.sql(sql, args, **tables) if args is not None else spark.sql(sql, **tables)


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table's next version: rows of changes in place of those with their key, and the new ones."""
    return table.join(changes, key, "left_anti").unionByName(changes, allowMissingColumns=True)


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys, key, "left_anti")


def numbered(rows: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """rows with new keys above the table's largest, which is looked up at once."""
    top = table.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    return rows.withColumn(key, F.monotonically_increasing_id() + F.lit(top + 1))


def replace_atomically(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Writes a version beside the old one and renames it into place when whole: no reader sees half of one.

    There are two renames, as a folder can't be renamed onto another: a reader who comes between them finds no table and has to try again, and
    on stores without renames they are copies.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    new, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old.{uuid.uuid4().hex}"
    df.write.parquet(new)
    here = hadoop.Path(path)
    files = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    moved = files.exists(here) and files.rename(here, hadoop.Path(old))
    if not files.rename(hadoop.Path(new), here):
        if moved:
            files.rename(hadoop.Path(old), here)
        raise OSError(f"cannot replace {path}")
    if moved:
        files.delete(hadoop.Path(old), True)
