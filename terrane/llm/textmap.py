"""Arrow-batched passes over whole texts: one row in, one row out, nothing shuffled."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def give_back() -> None:
    """Return freed memory to the system at a task's end: workers are kept for later stages and would hold on to it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    make: Callable[[], Callable[[bytes | None], tuple]],
    schema: str,
    types: list[pa.DataType],
    keep: list[str] | None = None,
) -> DataFrame:
    """Apply a function of one text to every row; ``make`` runs once in each task and may build what the function needs.

    The text reaches Python as UTF-8 bytes, None if null. ``keep`` names further columns to carry through, after the id.
    ``schema`` and ``types`` describe what the function returns; names of other columns of ``df`` play no part.
    """
    keep = keep or []
    names = [f.split()[0] for f in schema.split(", ")]
    source = df.select(
        F.col(id_col).cast("long").alias("doc_id"), *[F.col(k) for k in keep], F.col(text_col).cast("string").cast("binary").alias("__raw")
    )
    kept = source.schema[: 1 + len(keep)] if keep else source.schema[:1]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            found: list[tuple[Any, ...]] = [one(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            for k, kind in enumerate(types):
                columns.append(pa.array([x[k] for x in found], kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), *names])
            del batch, columns, found
        give_back()

    return source.mapInArrow(run, out)
