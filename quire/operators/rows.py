"""From texts to rows: a Python function that scans a text, applied Arrow batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema


def scan(df: DataFrame, keep: list[str], given: list[str], scan_one: Callable[..., Iterable[tuple]], fields: str, at_once: int = 20_000) -> DataFrame:
    """For each row, the columns of keep beside each tuple that scan_one makes of the columns given. Rows go out in batches of bounded size."""
    schema = StructType([df.schema[c] for c in keep] + list(StructType.fromDDL(fields).fields))
    arrow = to_arrow_schema(schema)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in arrow]

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(held, arrow, strict=True)], schema=arrow)

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for row in zip(*columns, strict=True):
                for found in scan_one(*row[n:]):
                    for c, v in zip(held, (*row[:n], *found), strict=True):
                        c.append(v)
                if len(held[-1]) >= at_once:
                    yield out()
                    for c in held:
                        c.clear()
        if held[-1]:
            yield out()

    return df.select(*keep, *(df[c].alias(f"_g{i}") for i, c in enumerate(given))).mapInArrow(run, schema)
