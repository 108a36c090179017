"""What the operators of this subpackage share: folders, tables, batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinfold.operators.cut import cut, shared_dir

__all__ = ["WORD", "Remembered", "for_task", "hand_back", "parcels", "ragged", "runs", "settle", "shared_dir", "small_batches", "table"]

#: Where lineage ends: a table written and read again.
settle = cut

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that Spark hands to a worker at once: with long texts, its own 64 MB a batch
#: stand several times in an executor's memory.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> None:
    """Keep Arrow batches of ``df``'s session at ``BATCH_BYTES`` or what it has set below."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key, None)
    if not now or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))


#: Bytes that a worker's memory of words may come to, by a rough count: an entry's share of
#: the table and of its objects, and the letters themselves.
REMEMBERED_BYTES, ENTRY_BYTES = 24 << 20, 160


class Remembered(dict):
    """Values by key, as a dictionary that ``trim`` empties beyond ``limit`` bytes.

    ``grew`` is told what is entered. Tasks take a memory by ``for_task``, so that those of
    operators that a worker runs by turns don't add up.
    """

    limit = REMEMBERED_BYTES

    def __init__(self):
        super().__init__()
        self.size = 0

    def grew(self, letters: int, entries: int = 1) -> None:
        self.size += letters + ENTRY_BYTES * entries

    def trim(self) -> None:
        if self.size > self.limit:
            self.clear()

    def clear(self) -> None:
        super().clear()
        self.size = 0


def hand_back() -> None:
    """Give memory that is free back to the machine, as far as the allocators can."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_KEPT: list[Remembered] = []


@contextmanager
def for_task(memory: Remembered, keep: bool = False) -> Iterator[Remembered]:
    """``memory`` for one task, empty afterwards, as workers live on from stage to stage.

    With ``keep`` it stays, within its limit, until a task of another operator begins in the
    worker: for memories that cost much to fill.
    """
    for other in _KEPT:
        if other is not memory:
            other.clear()
    try:
        yield memory
    finally:
        if not keep:
            memory.clear()
        elif not any(m is memory for m in _KEPT):
            _KEPT.append(memory)
        hand_back()


def parcels(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """Row number of the first text, and texts of about ``limit`` bytes together.

    Nulls come as empty texts. This keeps a worker's memory near the size of a parcel
    or of one document, whichever is larger, however many rows an Arrow batch has.
    """
    got: list[bytes] = []
    size, first = 0, 0
    for i, text in enumerate(texts.cast(pa.large_binary())):
        raw = text.as_py() or b""
        got.append(raw)
        size += len(raw)
        if size >= limit:
            yield first, got
            got, size, first = [], 0, i + 1
    if got:
        yield first, got


def ragged(values: pa.Array, sizes) -> pa.LargeListArray:
    """An Arrow list array of ``values`` cut into lists of ``sizes``."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``keys`` in a partition that is sorted by them."""
    rest = None
    for batch in batches:
        got = pa.Table.from_batches([batch])
        got = got if rest is None else pa.concat_tables([rest, got])
        changed = np.zeros(got.num_rows - 1, bool) if got.num_rows else np.zeros(0, bool)
        for k in keys:
            v = got[k].to_numpy()
            changed |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield got.slice(a, b - a)
        rest = got.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest
