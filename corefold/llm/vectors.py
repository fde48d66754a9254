"""Columns of vectors as numpy arrays, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for a generator over batches that gives columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f in arrow for c in (columns[f.name],)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    return df.mapInArrow(run, kind)


def finite_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: the rows without null or non-finite entries that are not null
    themselves, their lengths, and their entries as doubles, a row each, filled up
    with zeros to the longest."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1), np.int64)
    ends = np.cumsum(np.maximum(lengths, 0))
    values = np.asarray(pc.fill_null(column.flatten().cast(pa.float64()), np.nan), np.float64)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    starts = ends - np.maximum(lengths, 0)
    rows = np.flatnonzero((lengths >= 0) & (odd[ends] == odd[starts]))
    size = lengths[rows]
    place = np.arange(size.max(initial=0))
    inside = place < size[:, None]
    out = np.zeros(inside.shape)
    out[inside] = values[(starts[rows][:, None] + place)[inside]]
    return rows, size, out


def floored(values: np.ndarray, scale: int, bits: int) -> np.ndarray:
    """floor(scale * value) as integers; what needs more than ``bits`` bits is an error."""
    whole = np.floor(values * scale)
    if whole.size and np.abs(whole).max() >= 2.0**bits:
        raise ValueError(f"a vector's component times {scale} needs more than {bits} bits")
    return whole.astype(np.int64)
