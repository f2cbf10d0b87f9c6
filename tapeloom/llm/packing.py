"""Best-fit packing of documents into training sequences by rounds over a tree of partitions.

Each partition packs its pieces by best fit, longest first. Bins that are full but for a small rest are final; the others
go up the tree as items, several partitions to a group, and are packed again. The rest that counts as full grows from round
to round, so what reaches the top stays small: after the last round but one a group hands up at most one bin, as two bins of
at most half the size would have shared one.

Nulls: a null text is an empty one (its only id is the end id); a null doc_id packs like any other. Repeated rows are
documents of their own. An empty table gives no pieces. Other columns are not read.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from tapeloom.llm.common import slices
from tapeloom.llm.words import encoder, in_parts
from tapeloom.session import cut_lineage

FAN_IN = 8
#: Share of a sequence that may stay empty in a bin that is final, by round; the last holds for all later rounds.
RESTS = (1 / 128, 1 / 32, 1 / 8, 1 / 2)
#: Pieces that one task packs at a time.
AT_ONCE = 1 << 18


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and the fill of each bin: longest first, into the fullest bin with room."""
    bins, offsets, fills = [0] * len(lengths), [0] * len(lengths), []
    free: list[list[int]] = [[] for _ in range(size + 1)]  # bins by the room they have
    some = 0  # bit r is set if a bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fitting = some >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            room, b = size, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if room > n:
            free[room - n].append(b)
            some |= 1 << (room - n)
    return bins, offsets, fills


def pack(docs: DataFrame, vocabulary: str, kind: str = "byte_words", end_id: int = 0, size: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if wanted."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(vocabulary)  # a vocabulary file of a few MB
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        ids_of = encoder(kind, shipped.value)
        part, made = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []

        def packed() -> pd.DataFrame:
            nonlocal made, rows
            bins, offsets, fills = best_fit([r[3] for r in rows], size)
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            out["doc_id"] = out["doc_id"].astype("Int64")
            bins = np.asarray(bins, np.int64)
            fills = np.asarray(fills, np.int64)
            out["part"], out["bin"], out["offset"] = part, (part << 32) + made + bins, np.asarray(offsets, np.int64)
            out["fill"] = fills[bins] if len(fills) else 0
            made += len(fills)
            rows = []
            return out

        for batch in slices(batches):
            encoded = (x for part in in_parts(batch.column("text").to_pylist()) for x in ids_of(part))
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), encoded):
                ids = memoryview(raw + end)
                n = len(ids) // 4
                first = (n - 1) % size + 1
                for piece, stop in enumerate(range(first, n + 1, size)):
                    start = max(0, stop - size) if piece else 0
                    part_ids = ids[4 * start:4 * stop]
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(part_ids)) + ((bytes(part_ids),) if with_ids else ()))
            if len(rows) >= AT_ONCE >> 4 * with_ids:  # ids weigh up to 8 KB a piece
                yield from to_arrow(packed())
        if rows:
            yield from to_arrow(packed())

    def to_arrow(frame) -> Iterator:
        import pyarrow as pa

        for at in range(0, len(frame), 10_000):
            yield pa.RecordBatch.from_pandas(frame.iloc[at:at + 10_000], preserve_index=False)

    schema = "doc_id long, piece long, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids + "part long, bin long, offset long, fill long"
    placed = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(pieces, schema))

    # where each bin ends up: itself at offset 0, or inside a bin of a later round
    open_bins = placed.where(F.col("fill") < size * (1 - RESTS[0])).groupBy("bin").agg(F.max("part").alias("part"), F.max("fill").alias("fill"))
    moves: DataFrame | None = None
    parts = placed.agg(F.max("part")).first()[0] or 0
    level = 0
    while parts > 0:
        level += 1
        parts //= FAN_IN
        mark = level << 56

        def again(frame):
            import numpy as np

            frame = frame.sort_values(["fill", "bin"], ascending=[False, True])
            bins, offsets, fills = best_fit(frame["fill"].tolist(), size)
            bins = np.asarray(bins, np.int64)
            return frame.assign(to=mark + frame["part"].astype("int64") * (1 << 32) + bins, shift=offsets, filled=np.asarray(fills, np.int64)[bins])[["bin", "to", "part", "shift", "filled"]]

        merged = cut_lineage(
            open_bins.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")).select("bin", "part", "fill")
            .groupBy("part").applyInPandas(again, "bin long, to long, part long, shift long, filled long")
        )
        step = merged.select("bin", "to", "shift")
        if moves is None:
            moves = step
        else:  # moves so far lead into this round's items
            later = step.select(F.col("bin").alias("to"), F.col("to").alias("_to"), F.col("shift").alias("_shift"))
            moves = moves.join(later, "to", "left").select("bin", F.coalesce("_to", "to").alias("to"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift"))
        rest = RESTS[min(level, len(RESTS) - 1)]
        open_bins = merged.where(F.col("filled") < size * (1 - rest)).groupBy(F.col("to").alias("bin")).agg(F.max("part").alias("part"), F.max("filled").alias("fill"))

    out = [F.col(c).cast("int") if c == "piece" else F.col(c) for c in placed.columns if c not in ("part", "bin", "offset", "fill")]
    if moves is None:
        return placed.select(*out, F.col("bin").alias("sequence_id"), "offset")
    return placed.join(moves, "bin", "left").select(*out, F.coalesce("to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, from pieces packed with their ids; a sequence has at most ``size`` pieces."""
    return (
        packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("p"))
        .select("sequence_id", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("p", lambda x: x["offset"]).alias("offsets"), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    )
