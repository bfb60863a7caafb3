"""Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def arrow_schema(ddl: str) -> pa.Schema:
    """Of a schema as Spark writes it; for the driver, which can parse it."""
    return to_arrow_schema(StructType.fromDDL(ddl))


class Batches:
    """Rows gathered into batches by number and characters."""

    def __init__(self, schema: pa.Schema, rows: int = 4096, chars: int = 4 * 2**20):
        self.schema, self.most_rows, self.most_chars = schema, rows, chars
        self.rows: list[tuple] = []
        self.chars = 0

    def add(self, row: tuple, chars: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.chars += chars
        if len(self.rows) >= self.most_rows or self.chars >= self.most_chars:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            arrays = [pa.array(v, f.type) for v, f in zip(zip(*self.rows), self.schema)]
            self.rows, self.chars = [], 0
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)
