"""What several operators share: session settings for Arrow batches, stored steps, bounded slices of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesmith.session import materialize

SPACES = " \t\n\x0b\x0c\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Whole documents travel in these batches: few rows each, so that long texts stay within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps survive lost executors."""
    return materialize(df, f"llm-{label}")


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text; a longer text is a run of its own."""
    offset, size = 0, 0
    lengths = [0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()]
    for row, length in enumerate(lengths):
        if size and size + length > limit:
            yield batch.slice(offset, row - offset)
            offset, size = row, 0
        size += length
    if offset < batch.num_rows:
        yield batch.slice(offset)


def texts(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    """The texts of a batch, one after the other; null is the empty text."""
    for value in batch.column(column):
        yield value.as_py() or ""


def with_size_bound(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def plain(name: str) -> str:
    """A column name quoted for use in expressions."""
    return "`" + name.replace("`", "``") + "`"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table holds."""
    return df.select(*[F.col(plain(n)) for n in names])


def pack_columns(rows: pa.Table) -> bytes:
    """A table as one compressed value, for shuffles that move many rows of a key together."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack_columns(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()
