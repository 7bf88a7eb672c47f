"""Passing columns of a DataFrame through Python in Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows, and bytes of them, that are worked on together inside a task; a larger row is alone.
ROWS, BYTES = 512, 1 << 25


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        open_ = [batch.slice(at, ROWS)]
        while open_:
            part = open_.pop()
            if part.num_rows > 1 and part.nbytes > BYTES:
                half = part.num_rows // 2
                open_ += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def whole_texts(docs: DataFrame) -> DataFrame:
    """The two columns that the text operators read; any others, of whatever name, stay behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def map_batches(df: DataFrame, function: Callable[..., list], schema: str | StructType) -> DataFrame:
    """Apply function to lists of the columns' values, a few hundred rows at a time; it gives one list
    (or Arrow array) for each column of schema. Parts are bounded by rows and bytes. Rows stay in their
    partition; nothing is shuffled."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # lists of tokens hold no cycles, and are many
        try:
            for batch in batches:
                for part in _parts(batch):
                    columns = function(*(c.to_pylist() for c in part.columns))
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
        finally:
            gc.enable()

    return df.mapInArrow(run, kind)
