"""Python inside tasks: bounded slices of Arrow batches in, Arrow batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# A slice holds at most so many rows, and ends after the row that takes it over so many bytes.
SLICE_ROWS = 1024
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, text: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded rows, and of bounded bytes of one text or binary column."""
    if text is None:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
        return
    sizes = pc.binary_length(batch.column(text)).to_pylist()
    first, held = 0, 0
    for at, size in enumerate(sizes):
        held += size or 0
        if held >= SLICE_BYTES or at + 1 - first >= SLICE_ROWS:
            yield batch.slice(first, at + 1 - first)
            first, held = at + 1, 0
    if first < len(sizes):
        yield batch.slice(first)


def map_slices(
    df: DataFrame,
    schema: str | StructType,
    start: Callable[[], Callable[[pa.RecordBatch], dict[str, object] | pa.RecordBatch]],
    text: str | None = None,
) -> DataFrame:
    """``mapInArrow`` with one ``start()`` per task; what it returns turns a slice into columns or a batch."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, target = start(), to_arrow_schema(kind)
        for batch in batches:
            for part in slices(batch, text):
                out = work(part)
                if isinstance(out, dict):
                    out = pa.RecordBatch.from_arrays(
                        [
                            out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type)
                            for f in target
                        ],
                        schema=target,
                    )
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, kind)
