"""Run a function over texts inside Spark tasks, a bounded number of characters at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

SLICE_BYTES = 4_000_000


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose `column` holds about `limit` bytes; one longer value stays whole."""
    start = size = 0
    lengths = pc.binary_length(batch.column(column)).to_pylist()
    for i, length in enumerate(lengths):
        if size and size + (length or 0) > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += length or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    keep: list[str],
    text: str,
    function: Callable[[list], dict[str, object]],
    schema: str,
    raw: bool = False,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """`keep` columns beside what `function` returns for a list of texts.

    `function` takes texts (None for null; UTF-8 bytes with `raw`) and returns one value list or
    Arrow array per field of `schema`, in the order of the texts. Only the columns needed are read.
    """
    extra: StructType = _parse_datatype_string(schema)
    out = StructType([df.schema[c] for c in keep] + extra.fields)
    arrow = to_arrow_schema(out)
    names = extra.fieldNames()
    hidden = "_text_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, hidden, limit):
                values = part.column(hidden)
                found = function((values.cast(pa.binary()) if raw else values).to_pylist())
                columns = [part.column(c) for c in keep]
                for name in names:
                    value, kind = found[name], arrow.field(name).type
                    columns.append(
                        value.cast(kind)
                        if isinstance(value, (pa.Array, pa.ChunkedArray))
                        else pa.array(value, kind)
                    )
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow
                )

    return df.select(*keep, F.col(text).alias(hidden)).mapInArrow(run, out)
