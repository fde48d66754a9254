"""What the operators share: batches, row keys, written tables, hashed filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corefold.session import fresh_path

BATCH_ROWS = 1024
BATCH_CHARS = 4_000_000
#: For steps whose arrays are many times the size of the text.
FEW_CHARS = 1 << 19


def scan(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list] | pa.RecordBatch | None], schema: str, chars: int = BATCH_CHARS) -> DataFrame:
    """``mapInArrow`` in steps of at most BATCH_ROWS rows, or about ``chars``
    characters of text. ``fn`` gets and gives columns as lists."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, chars):
                out = fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def steps(batch: pa.RecordBatch, chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch by rows and by bytes of its widest columns."""
    start, used = 0, 0
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
            sizes += np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    for i, size in enumerate(sizes.tolist()):
        if i > start and (i - start >= BATCH_ROWS or used + size > chars):
            yield batch.slice(start, i - start)
            start, used = i, 0
        used += size
    if batch.num_rows > start:
        yield batch.slice(start)


def row_key(*columns: str) -> list:
    """128 bits that tell rows apart by the given columns; equal rows share them."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(17), *columns).alias("k2")]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in the shared folder, read back: lineage ends here and
    a lost executor costs no earlier work."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Written rows of a long or two are sent to all executors up to this number, joined beyond.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class HashFilter:
    """A set of 32-bit hashes folded to FILTER_BITS bits: 2 MB whatever the data
    hold. It lets some strangers pass, never drops a member; an exact join follows."""

    BITS = 24

    def __init__(self, hashes: DataFrame):
        """``hashes``: one column ``h`` of non-negative longs."""
        low = self.BITS - 9
        slot = F.col("h") % (1 << self.BITS)
        rows = (
            hashes.select(F.shiftright(slot, low).alias("part"), (slot % (1 << low)).alias("at"))
            .groupBy("part").agg(F.bitmap_construct_agg(F.col("at").cast("long")).alias("bits")).collect()
        )
        bits = np.zeros((1 << 9, (1 << low) // 8), np.uint8)
        for part, data in rows:
            bits[part] = np.frombuffer(bytes(data)[: bits.shape[1]], np.uint8)
        self.shared = hashes.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    @staticmethod
    def test(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & ((1 << HashFilter.BITS) - 1)
        return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
