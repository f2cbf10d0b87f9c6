"""Small helpers that several operators share."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def once(key: tuple, make: Callable[[], Any]) -> Any:
    """A value that a Python worker makes once and keeps for its later tasks.

    Task functions travel by value, so their own globals do not outlast a task; an imported module does.
    """
    import numpy

    kept = numpy.__dict__.setdefault("_tapeloom_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def held_out(key: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text falls in the fold; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


#: Bytes of text that a task takes apart at a time; the arrays made of them are up to a hundred times as large.
PIECE = 1 << 17


def slices(batches: Iterator, rows: int = 1000) -> Iterator:
    """The batches in pieces of so many rows, so that a task holds few texts outside Arrow at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Bits of a broadcast bitmap, as a power of 2, at most: 32 MB.
MOST_BITS = 28


def bitmap_of(hashes: DataFrame, column: str):
    """Bits of the prefixes of a column: their number as a power of 2, and words of 64 of them."""
    import numpy as np

    bits = min(MOST_BITS, max(16, (32 * hashes.count()).bit_length()))
    slot = F.shiftrightunsigned(column, 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    got = hashes.select(F.shiftrightunsigned(slot, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << bits - 6, np.int64)
    words[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return bits, words.view(np.uint64)


def within(known, hashes):
    """Whether a broadcast bitmap has the prefixes of these hashes."""
    import numpy as np

    bits, words = known.value
    slot = hashes.view(np.uint64) >> np.uint64(64 - bits)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def chosen(batch, known, column: str, there: bool = True):
    """The rows of a batch whose hash the bitmap has, or those whose hash it hasn't."""
    return batch.filter(pa.array(within(known, batch.column(column).to_numpy()) == there))


def thinned(rows: DataFrame, known, column: str, there: bool = True) -> DataFrame:
    """The rows whose hash the bitmap has, so that a join shuffles few others; or those whose hash it certainly hasn't.

    Only the hashes go to the Python workers, not the rows.
    """
    def stands(hashes: pa.Array) -> pa.Array:
        return pa.array(within(known, hashes.to_numpy()) == there)

    return rows.where(F.arrow_udf(stands, "boolean")(column))
