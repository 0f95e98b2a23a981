"""Per-key totals when a few keys hold most rows: dense accumulator arrays.

Every input split is cut into runs of an equal number of rows. A run's keys are dictionary-encoded
and its rows and values scattered into arrays with ``numpy.bincount``, so a hot key costs one array
slot per run however many rows it has. The arrays travel by block (a hash range of keys) and are
summed slot by slot; a block's size depends on its distinct keys and never on the rows of a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import ship, shuffle_width

#: Rows of one accumulator run.
RUN_ROWS = 262_144
_LOW = 26
_PARTIAL = "block int, keys array<string>, rows array<bigint>, sums array<bigint>"


def scatter_sum(codes: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact int64 sums per code by two ``bincount`` passes, over the low and the high bits.

    Float weights are exact below 2**53, which holds for runs of up to 2**27 rows.
    """
    low = np.bincount(codes, weights=values & ((1 << _LOW) - 1), minlength=size)
    high = np.bincount(codes, weights=values >> _LOW, minlength=size)
    with np.errstate(over="ignore"):
        return (high.astype(np.int64) << _LOW) + low.astype(np.int64)


def _accumulate(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.Table.from_batches(batches).combine_chunks()
    encoded = run.column("key").combine_chunks().dictionary_encode(null_encoding="encode")
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = len(encoded.dictionary)
    values = run.column("value").to_numpy()
    rows = np.bincount(codes, minlength=size).astype(np.int64)
    sums = scatter_sum(codes, values, size)
    block = np.zeros(size, np.int32)
    block[codes] = run.column("block").to_numpy()
    order = np.argsort(block, kind="stable")
    numbers, starts = np.unique(block[order], return_index=True)
    offsets = pa.array(np.append(starts, size).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (encoded.dictionary.take(pa.array(order)), pa.array(rows[order]), pa.array(sums[order]))]
    yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), *lists], ["block", "keys", "rows", "sums"])


def _split_arrays(run_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= run_rows:
                yield from _accumulate(held)
                held, n = [], 0
        if n:
            yield from _accumulate(held)

    return run


def _merge(keys: list[pa.Array], rows: list[np.ndarray], sums: list[np.ndarray]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    encoded = pa.chunked_array(keys, type=keys[0].type).combine_chunks()
    encoded = encoded.dictionary_encode(null_encoding="encode")
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = len(encoded.dictionary)
    return encoded.dictionary, scatter_sum(codes, np.concatenate(rows), size), scatter_sum(codes, np.concatenate(sums), size)


def _sum_arrays(pending_slots: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, sums, pending = [], [], [], 0
        for batch in batches:
            part = batch.column("keys").flatten()
            keys.append(part)
            rows.append(batch.column("rows").flatten().to_numpy())
            sums.append(batch.column("sums").flatten().to_numpy())
            pending += len(part)
            if pending >= pending_slots:
                k, r, s = _merge(keys, rows, sums)
                keys, rows, sums, pending = [k], [r], [s], 0
        if keys:
            k, r, s = _merge(keys, rows, sums)
            for at in range(0, len(k), 65_536):
                yield pa.RecordBatch.from_arrays([k[at : at + 65_536], pa.array(r[at : at + 65_536]), pa.array(s[at : at + 65_536])], ["key", "rows", "total"])

    return run


def dense_key_totals(df: DataFrame, key: str, value: str, blocks: int | None = None, run_rows: int = RUN_ROWS) -> DataFrame:
    """``key, rows, total`` for every key, spelled exactly; the null key is one group.

    ``rows`` counts all rows of the key, repeated rows included; null values add 0 to ``total``.
    An empty input gives no rows. Other columns are never read. ``blocks`` is the number of
    key ranges, by default one per 64 MB of input and no fewer than the shuffle partitions.
    """
    ship(df.sparkSession)
    n = blocks or shuffle_width(df.select(key, value))
    rows = df.select(
        F.col(key).alias("key"),
        F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int").alias("block"),
        F.coalesce(F.col(value).cast("bigint"), F.lit(0).cast("bigint")).alias("value"),
    )
    partial = rows.mapInArrow(_split_arrays(run_rows), _PARTIAL)
    return partial.repartitionById(n, F.col("block")).mapInArrow(_sum_arrays(), "key string, rows bigint, total bigint")


def heavy_keys(totals: DataFrame, all_rows: Column, share: str = "0.02") -> DataFrame:
    """Keys of ``dense_key_totals`` that hold more than ``share`` of all rows; the null key is none.

    The share is a decimal or a fraction as text and is compared in whole numbers.
    """
    exact = Fraction(share)
    return totals.where(F.col("key").isNotNull() & (F.col("rows") * F.lit(exact.denominator) > all_rows * F.lit(exact.numerator)))
