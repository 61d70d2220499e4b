"""Shared pieces of the training-data operators: table access, row keys, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words and shingles use ASCII white space: tab, line feed, vertical tab, form feed, return, space.
WORD = r"[^\x20\x09-\x0D]+"
STEP = 1_000  # rows of an Arrow batch whose texts are Python strings at one time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str) -> Column:
    """A never-null key; rows equal in all ``columns`` share it, and null differs from every value."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.md5(F.concat_ws("\x00", *parts))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front as long as the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def refuse_taken(columns: list[str], into: tuple[str, ...], dropped: str | None = None) -> None:
    """New columns must not have the name of one that is passed through, in any case of letters."""
    taken = {c.lower() for c in columns if c != dropped}
    if clash := [name for name in into if name.lower() in taken]:
        raise ValueError(f"the table has columns {clash}; name the new ones with into=")


def held_out(key: Column) -> Column:
    """The rows no model learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _give_back() -> None:
    """Return freed memory to the system, so that an idle worker does not keep what its last task took."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow whose tasks can import this package, wherever the driver found it."""
    context = df.sparkSession.sparkContext
    if not hasattr(context, "_tessella_zip"):
        package = Path(__file__).resolve().parents[1]
        # The driver serves this file to the executors; it lives as long as the context.
        context._tessella_zip = tempfile.TemporaryDirectory(prefix="tessella-", ignore_cleanup_errors=True)
        target = Path(context._tessella_zip.name) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        context.addPyFile(str(target))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return df.mapInArrow(task, schema)


def map_texts(df: DataFrame, text: str, make: Callable[[], Callable], fields: str, keep: list[str] | None = None) -> DataFrame:
    """Append the columns ``fields`` that a function of a list of texts returns, batch by batch.

    ``make`` runs once per task and returns that function, so models are loaded where they are
    used. Texts arrive as they are, None included. Only ``keep`` (default: all but the text) and
    the new columns come back; a text that is kept is sent to the worker once. A batch holds at most
    spark.sql.execution.arrow.maxRecordsPerBatch rows; the function gets ``STEP`` of them at a time.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), fields])
    kept = text in keep
    at = keep.index(text) if kept else len(keep)
    narrow = df.select(*[F.col(f"`{c}`") for c in keep], *([] if kept else [F.col(f"`{text}`").alias("\x01text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for first in range(0, batch.num_rows, STEP):
                part = batch.slice(first, STEP)
                new = compute(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *new.values()], [*keep, *new])

    return arrow_map(narrow, run, schema)
