"""What the operators share: texts a portion at a time, skew-safe group figures."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut, drop, new_path, shared_dir

__all__ = ["batches_of", "cut", "drop", "group_figures", "need", "new_path", "portions", "release", "shared_dir"]

#: Parts that a group is split into before its figures are gathered: a group
#: with a third of all rows is then no more than 1/768 of them in one task.
SALTS = 256
#: Characters of text handled at once.
CHARS = 3_000_000


def batches_of(texts: list[str | None], chars: int = CHARS) -> Iterator[slice]:
    """Runs of texts of about so many characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def portions(batch: pa.RecordBatch, column: int | str, size: int = CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Runs of rows with about ``size`` bytes of text, and these texts: few of them are Python strings at once."""
    at = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        held += n
        if held >= size:
            part = batch.slice(at, i + 1 - at)
            yield part, part.column(column).to_pylist()
            at, held = i + 1, 0
    if at < batch.num_rows:
        part = batch.slice(at)
        yield part, part.column(column).to_pylist()


def need(df: DataFrame, *columns: str) -> None:
    """Fails early, naming what is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def group_figures(df: DataFrame, keys: Sequence[str], first: Sequence[Column], second: Sequence[Column], salt_by: Column) -> tuple[DataFrame, str]:
    """For each (keys, salt) of ``df`` the figures of the whole group.

    ``first`` aggregates the rows of one salt, ``second`` the rows of ``first``.  Rows
    meet their group's figures by joining on ``keys`` and the salt column (named
    by the second value), so no task holds all rows of a hot group.
    """
    salt = "_salt"
    parts = df.withColumn(salt, F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")).groupBy(*keys, salt).agg(*first)
    whole = parts.groupBy(*keys).agg(*second)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}"))
    names = [c for c in whole.columns if c not in keys]
    return parts.alias("p").join(whole.alias("w"), on).select(*[f"p.{k}" for k in [*keys, salt]], *[f"w.{n}" for n in names]), salt


def release() -> None:
    """For the start of a task without tokens: frees what a reused Python worker keeps of an earlier one."""
    if tokens := sys.modules.get(f"{__package__}.tokens"):
        tokens._ENCODERS.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
