"""Pieces that several operators share: files in the shared folder, Arrow slices, names."""

from __future__ import annotations

import ctypes
import io
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop_written, new_uri, path_of, shared_dir, written

__all__ = ["arrow_map", "drop_written", "fresh_names", "give_back", "new_uri", "only", "put_bytes", "ragged", "shared_dir", "ship", "slices", "text_bytes", "type_of", "written"]

SLICE_BYTES = 2 << 20  # larger ones cost memory in every worker and save little time


def put_bytes(spark: SparkSession, uri: str, data: bytes) -> None:
    """Write one small file (the caller has bounded it) through the cluster's file system."""
    path, fs = path_of(spark, uri)
    out = fs.create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def type_of(df: DataFrame, column: str) -> str:
    """The SQL type of a column, for the schema strings of Arrow functions."""
    return df.schema[column].dataType.simpleString()


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just the columns an operator reads; others, whatever their names, do not reach it."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def text_bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The column's UTF-8 and its row offsets (n + 1, from 0); nulls are empty.

    Bytes that are not UTF-8 are replaced by U+FFFD, so later steps may decode strictly.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string(), safe=False) if column.type != pa.large_string() else column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = b"" if data is None else bytes(memoryview(data)[int(offsets[0]) : int(offsets[-1])])
    offsets = offsets - offsets[0]
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        rows = [data[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        data, offsets = b"".join(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int64)
    return data, offsets


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` has about ``most`` bytes in each, one row at least and ``rows`` at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        if values.nbytes <= most and (rows is None or batch.num_rows <= rows):
            yield batch
            continue
        lengths = pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            to = to if rows is None else min(to, at + rows)
            yield batch.slice(at, to - at)
            at = to


def fresh_names(taken: list[str], wanted: list[str]) -> list[str]:
    """Names for new columns that no column of the table has (names differ beyond their case)."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        made, number = name, 2
        while made.lower() in used:
            made, number = f"{name}_{number}", number + 1
        used.add(made.lower())
        out.append(made)
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... (lengths[i] of them) for each i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once in a session: a zip in the shared folder, which Spark
    fetches to each executor, so no search path has to be set there."""
    context = spark.sparkContext
    if getattr(context, "_tallymark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    uri = new_uri(spark, "package", ".zip")
    put_bytes(spark, uri, out.getvalue())
    context.addPyFile(uri)
    context._tallymark_shipped = True


def give_back() -> None:
    """Return freed memory to the system: a worker lives on for other tasks, beside other workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, schema: str, function: Callable) -> DataFrame:
    """``mapInArrow`` with a DDL schema; a task gives its memory back when it ends."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)
