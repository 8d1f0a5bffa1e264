"""Running sums over rows in a global order.

Rows are range partitioned, sorted and checkpointed, so that partition numbers and the order within
them are settled. A key that fills many partitions is carried on from one to the next: the driver
sees one row per partition, never more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from modspark.durable import cut
from modspark.llm.base import width


def ordered(df: DataFrame, *by: str) -> DataFrame:
    """``df`` sorted over the whole cluster (nulls first), with settled partitions."""
    return cut(df.repartitionByRange(width(df.sparkSession), *by).sortWithinPartitions(*by))


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


class _Sums:
    """Running sums of one partition, batch after batch."""

    def __init__(self, names: list[str], key: str | None, mask: int | None):
        self.names, self.key, self.mask = names, key, mask
        self.now: int | None = None  # the key whose sums go on
        self.first: int | None = None
        self.sums = [0] * len(names)

    def add(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        keys = numbers(batch.column(self.key)) if self.key else np.zeros(batch.num_rows, np.int64)
        if self.first is None:
            self.first = int(keys[0])
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        lengths, goes_on, out = np.diff(np.r_[starts, len(keys)]), self.now == keys[0], []
        for i, name in enumerate(self.names):
            values = numbers(batch.column(name))
            run = np.cumsum(values)
            before = run[starts] - values[starts]
            if goes_on:
                before[0] -= self.sums[i]
            run -= np.repeat(before, lengths)
            if self.mask is not None:
                run &= self.mask
            self.sums[i] = int(run[-1])
            out.append(run)
        self.now = int(keys[-1])
        return out


def running(rows: DataFrame, adds: dict[str, str], key: str | None = None, bits: int | None = None) -> DataFrame:
    """``rows`` of ``ordered`` with, for each name in ``adds``, the inclusive running sum of its column (bigint).

    Sums begin anew with each value of ``key`` (bigint, the first column of the order); with
    ``bits`` they are kept modulo 2**bits, for columns that are below that themselves.
    """
    names, columns = list(adds), list(adds.values())
    mask = None if bits is None else (1 << bits) - 1

    def summary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(columns, key, mask)
        for batch in batches:
            if batch.num_rows:
                sums.add(batch)
        if sums.first is not None:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "first": pa.array([sums.first], pa.int64()),
                "last": pa.array([sums.now], pa.int64()), "sums": pa.array([sums.sums], pa.list_(pa.int64()))})

    needed = rows.select(*dict.fromkeys([*([key] if key else []), *columns]))
    found = sorted(needed.mapInArrow(summary, "part bigint, first bigint, last bigint, sums array<bigint>").collect())
    carried: dict[int, tuple[int, list[int]]] = {}
    now, held = None, [0] * len(columns)
    for part, first, last, sums in found:
        if now is not None:
            carried[part] = (now, held)
        # A partition of one key that goes on adds to what came before it.
        held = [a + b if mask is None else (a + b) & mask for a, b in zip(held, sums, strict=True)] if now == first == last else list(sums)
        now = last

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(columns, key, mask)
        if (before := carried.get(TaskContext.get().partitionId())) is not None:
            sums.now, sums.sums = before[0], list(before[1])
        for batch in batches:
            if batch.num_rows:
                made = [pa.array(x.astype(np.int64)) for x in sums.add(batch)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])
    return rows.mapInArrow(step, schema)
