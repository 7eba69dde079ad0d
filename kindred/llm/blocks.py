"""Texts packed into blocks: rows of some megabytes with a key that never changes again.

Operators that look at every text more than once, with values that come back from the whole corpus, send those values
to the block that asked for them; the block is also the unit in which text travels, compressed.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.session import settle

BLOCK = 16 << 20


def pack(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``block`` (key) and ``data`` (Arrow batches, compressed) with all columns of ``docs``; about ``block`` bytes of
    its column ``text`` to a row, a longer text alone in one."""
    at = docs.columns.index("text")

    def run(batches):
        from pyspark import TaskContext
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def row():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for piece in held:
                    out.write_batch(piece)
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                names=["block", "data"])

        for b in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False)
            start = 0
            while start < b.num_rows:
                room = int(np.searchsorted(np.cumsum(sizes[start:], dtype=np.int64), block - size, "right"))
                take = min(b.num_rows - start, room if held else max(room, 1))
                if take:
                    held.append(b.slice(start, take))
                    size += int(sizes[start:start + take].sum())
                    start += take
                if start < b.num_rows or size >= block:
                    yield row()
                    number += 1
                    held, size = [], 0
        if held:
            yield row()

    # Settled: a lost task that ran again could cut other blocks.
    return settle(docs.mapInArrow(run, "block long, data binary"), "blocks")


def unpack(data: bytes) -> Iterator[tuple]:
    """The packed rows in order, a few texts at a time as Python objects.

    A worker opens block after block: what earlier ones left in reference cycles or in Arrow's pool goes first.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    for b in pa.ipc.open_stream(data):
        for at in range(0, b.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True)
