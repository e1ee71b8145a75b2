"""What the operators share: reading tables, the shared folder, small slices of Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.sources.files import dealt

#: Rows of an Arrow batch that become Python objects at a time; Spark itself bounds a batch's bytes.
SLICE_ROWS = 128
#: Bytes of texts that are worked on together where Arrow does it.
SLICE_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder."""
    return dealt(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some rows, none of them empty; nothing is copied."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def weighed(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some bytes of a column, a row of more by itself, none of them empty; nothing is copied."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
            yield b.slice(at, upto - at)
            at = upto


class Table(dict):
    """What a worker remembers of texts: as many entries as fit some bytes; beyond, it starts anew. Longer entries than that aren't kept."""

    def __init__(self, most: int = 48 << 20) -> None:
        self.most = self.room = most

    def weight(self, key: str | bytes, value: object) -> int:
        return 150 + 2 * len(key) + (len(value) if isinstance(value, bytes) else 8 * len(value) if isinstance(value, list) else 0)

    def take(self, found: dict[str, bytes]) -> bool:
        """Takes many entries, if they fit without starting anew."""
        need = 150 * len(found) + 2 * sum(map(len, found)) + sum(map(len, found.values()))
        if need > self.room:
            return False
        self.update(found)
        self.room -= need
        return True

    def restart(self) -> None:
        self.clear()
        self.room = self.most

    def put(self, key: str | bytes, value: object) -> None:
        need = self.weight(key, value)
        if need > self.room:
            self.restart()
        if need <= self.room:
            self[key] = value
            self.room -= need


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder that the cluster names in spark.checkpoint.dir. Where that is unset, a local session (tests) gets one of its own, and any other is refused."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quire-")
        sc.setCheckpointDir(where)
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    whole = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/(?!/)", "file:///", whole).rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quire-{tag}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Removes a folder of fresh_dir that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def forget(spark: SparkSession, kept: DataFrame) -> None:
    """Removes a table of `keep` that nothing will read again."""
    for path in {f.rpartition("/")[0] for f in kept.inputFiles()}:
        if "/quire-" in path:
            drop_dir(spark, path)


def but(spark: SparkSession, rows: DataFrame, column: str, barred: DataFrame) -> DataFrame:
    """rows whose column is not among barred's single one; null is a value like others.

    barred is written first: without any, rows aren't touched, and else Spark knows its bytes and broadcasts it only below its threshold.
    """
    barred = keep(spark, barred.toDF("_barred"), "barred")
    return rows if barred.isEmpty() else rows.join(barred, rows[column].eqNullSafe(F.col("_barred")), "left_anti")


def integral(docs: DataFrame, key: str) -> None:
    """Refuses a key that isn't an integer: cast to one, text keys would get lost."""
    kind = docs.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} must be an integer, not {kind}")


def boxed(docs: DataFrame, **named: Column) -> DataFrame:
    """The named columns, and `row`: a struct of all of docs, which no other column's name can clash with."""
    return docs.select(*(c.alias(n) for n, c in named.items()), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def keep(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there and a lost executor loses nothing."""
    path = fresh_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
