"""Python on rows, in Arrow batches: for rules that read a text from left to right, which column functions can't say."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def with_columns(rows: DataFrame, inputs: list[str], made: str, f: Callable[..., tuple]) -> DataFrame:
    """rows with the columns of the DDL `made`, which f(*inputs) gives for each row; columns of these names are replaced."""
    schema = StructType.fromDDL(made)
    kinds = to_arrow_schema(schema)
    rest = [x for x in rows.schema if x.name not in schema.names]
    out = StructType([*rest, *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            got = [f(*x) for x in zip(*(part[c].to_pylist() for c in inputs), strict=True)]
            columns = zip(*got, strict=True) if got else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([*(part[x.name] for x in rest), *(pa.array(list(c), k.type) for c, k in zip(columns, kinds, strict=True))], out.names)

    return rows.mapInArrow(run, out)


def exploded(rows: DataFrame, key: str, inputs: list[str], made: str, f: Callable[..., Iterable[tuple]]) -> DataFrame:
    """(key, columns of the DDL `made`): a row for each tuple of f(*inputs)."""
    schema = StructType.fromDDL(made)
    kinds = to_arrow_schema(schema)
    out = StructType([rows.schema[key], *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            at, got = [], []
            for i, x in enumerate(zip(*(part[c].to_pylist() for c in inputs), strict=True)):
                own = list(f(*x))
                at += [i] * len(own)
                got += own
            columns = zip(*got, strict=True) if got else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([part[key].take(pa.array(at, pa.int64())), *(pa.array(list(c), k.type) for c, k in zip(columns, kinds, strict=True))], out.names)

    return rows.select(*dict.fromkeys([key, *inputs])).mapInArrow(run, out)
