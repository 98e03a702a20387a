"""Reading tables and Arrow batches of texts, and writing tables between steps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import work_folder

# Text bytes that a task handles at once; one longer text is handled by itself.
BATCH_BYTES = 2 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps don't repeat its work.

    A lost executor costs nothing, as the files are shared by all of them.
    """
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ways(spark: SparkSession) -> int:
    """Into how many parts a busy key is cut; follows the size of the cluster."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def slim(docs: DataFrame, id_col: str, text_col: str, **more: Column) -> DataFrame:
    """Only the id, the text and ``more``, by fixed names, whatever other columns there are."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"),
        *[column.alias(name) for name, column in more.items()],
    )


def part_of(id_col: str, parts: int) -> Column:
    """The CRC-32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


class Texts:
    """Ids and texts of a few rows: UTF-8 bytes in one array, row i at starts[i]:starts[i+1]."""

    def __init__(self, ids: pa.Array, data: np.ndarray, starts: np.ndarray, rows: pa.RecordBatch):
        self.ids, self.data, self.starts, self.rows = ids, data, starts, rows

    def __len__(self) -> int:
        return len(self.ids)

    def each(self) -> Iterator[bytes]:
        raw, at = self.data.tobytes(), self.starts.tolist()
        for i in range(len(at) - 1):
            yield raw[at[i] : at[i + 1]]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and its starts; a null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def small_batches(
    batches: Iterable[pa.RecordBatch], limit: int = BATCH_BYTES, id_col: str = "id", text_col: str = "text"
) -> Iterator[Texts]:
    """Batches cut so that each has about ``limit`` bytes of text."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        _, starts = _bytes_of(batch.column(text_col))
        while at < n:
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + limit, "right")) - 1)
            end = min(end, n)
            part = batch.slice(at, end - at)
            data, own = _bytes_of(part.column(text_col))
            yield Texts(part.column(id_col), data, own, part)
            at = end


def blank_slices(data: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[bytes]:
    """A text in parts that end with a blank; where there is none for long, a part is longer."""
    at = 0
    while at < len(data):
        end = min(len(data), at + limit)
        while end < len(data):
            part = data[at:end]
            blanks = np.flatnonzero((part == 0x20) | ((part >= 0x09) & (part <= 0x0D)))
            if len(blanks):
                end = at + int(blanks[-1]) + 1
                break
            end = min(len(data), end + limit)
        yield data[at:end].tobytes()
        at = end


def map_texts(
    frame: DataFrame, schema: str, work: Callable[[Texts], pa.RecordBatch], limit: int = BATCH_BYTES
) -> DataFrame:
    """``work`` on small batches of ``frame`` (with columns ``id`` and ``text``) in tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in small_batches(batches, limit):
            yield work(texts)

    return frame.mapInArrow(run, schema)


def record(**columns: object) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))
