"""Shared parts of the text operators: one pass over whole texts, words, small helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Bytes of text handed to one call of a block worker: bounds a task's memory whatever a batch holds.
BLOCK_BYTES = 4_000_000

Work = Callable[[list[str]], Iterable[list]]


def words(text: str) -> list[bytes]:
    """The runs of ``[^\\x20\\x09-\\x0D]``, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def free(df: DataFrame, *stems: str) -> list[str]:
    """Names for passing columns that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def give_back() -> None:
    """Return freed memory to the system: Spark keeps a task's Python process for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have no such call
    if trim:
        trim(0)


def blocks(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and texts of runs of rows with about ``BLOCK_BYTES`` (one long text may be more)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        passed = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, passed + BLOCK_BYTES, side="right")))
        yield start, end, [t or "" for t in column.slice(start, end - start).to_pylist()]
        start = end


def annotate(df: DataFrame, text_col: str, fields: str, setup: Callable[[], Work], keep_text: bool = True) -> DataFrame:
    """Add columns worked out from each row's whole text, without a shuffle.

    ``setup`` runs once in a task and returns a function from a block of texts to one list
    per new column. A null text counts as empty. A column of ``df`` that has the name of a
    new one is replaced; all others are handed on as they are (the text itself only with
    ``keep_text``). Names are compared without regard to case, as Spark does.
    """
    added = StructType.fromDDL(fields)
    names = {f.name.lower() for f in added}
    kept = [f for f in df.schema if f.name.lower() not in names]
    if text_col.lower() in names:
        raise ValueError(f"{text_col} is the text and can't be a new column")
    source = df.select(*[f"`{f.name}`" for f in kept])
    handed = [f.name for f in kept if keep_text or f.name != text_col]
    types = [to_arrow_type(f.dataType) for f in added]
    new = [f.name for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            others = [batch.column(n) for n in handed]
            for start, end, texts in blocks(batch.column(text_col)):
                columns = work(texts)
                yield pa.RecordBatch.from_arrays(
                    [o.slice(start, end - start) for o in others]
                    + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], handed + new)
        work = others = texts = columns = batch = None
        give_back()

    schema = StructType([f for f in kept if f.name in handed] + list(added))
    return source.mapInArrow(run, schema)
