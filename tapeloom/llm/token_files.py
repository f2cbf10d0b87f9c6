"""Token ids in Parquet files that can be read in part.

A document is one row: id, number of ids, ids before it in its file, and the list of its ids. Files follow each other in
ascending document order. Ids are dictionary-encoded (a vocabulary is small), counts and offsets delta-encoded; row groups
and pages have set sizes and the files carry page indexes, so a reader fetches counts without ids, or the ids of a range of
documents, from few pages.

Nulls: a null text is an empty one; a null doc_id comes first. Repeated rows stay, ordered by text. An empty table gives files
without rows. Other columns are not read.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tapeloom.llm.common import slices
from tapeloom.llm.words import encoder, in_parts

SCHEMA = "doc_id long, n_tokens int, local_start long, tokens array<int>"

#: Row groups of 32 MB, pages of 64 KB, dictionary for ids, delta encoding (format version 2) for the rest.
LAYOUT = {
    "parquet.block.size": str(32 << 20), "parquet.page.size": str(64 << 10), "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false", "parquet.enable.dictionary#tokens.list.element": "true", "compression": "snappy",  # ids packed by a dictionary hardly shrink further
}


def write_tokens(docs: DataFrame, path: str, vocabulary: str, kind: str, end_id: int) -> None:
    """Encode whole texts and write them in ascending doc_id order. ``vocabulary`` is the tokenizer's JSON text."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(vocabulary)  # a vocabulary file of a few MB
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ids_of = encoder(kind, shipped.value)
        before = 0
        for batch in slices(batches):
            ids = [x + end for part in in_parts(batch.column("text").to_pylist()) for x in ids_of(part)]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(n)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int32)), pa.array(before + ends - n), tokens], ["doc_id", "n_tokens", "local_start", "tokens"])
            before += int(ends[-1]) if len(ends) else 0

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id", F.xxhash64("text"))  # equal ids may still be dealt apart
        .sortWithinPartitions("doc_id", "text")
    ).withColumn("text", F.col("text").cast("binary"))
    ordered.mapInArrow(encode, SCHEMA).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files with the file's name, to select from: unselected columns are not read."""
    return spark.read.schema(SCHEMA).parquet(path).select("*", F.col("_metadata.file_name").alias("file"))


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids in all files before each file, from the counts alone. One row per file, so small enough for the driver."""
    sums = read_tokens(spark, path).groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()
    rows, before = [], 0
    for r in sorted(sums, key=lambda r: [int(x) for x in re.findall(r"^part-(\d+).*?c(\d+)", r.file)[0]]):
        rows.append((r.file, before))
        before += r.n
    return spark.createDataFrame(rows, T._parse_datatype_string("file string, before long"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: its place among all ids, its length and the crc32 of its ids."""
    def crc(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches):
            lists = batch.column("tokens")
            at = np.asarray(lists.offsets)
            ids = memoryview(np.asarray(lists.values).view("<u4")).cast("B")
            sums = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), batch.column("local_start"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "file", "local_start", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("doc_id", "file", "local_start", "tokens").mapInArrow(crc, "doc_id long, file string, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(file_starts(spark, path)), "file").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
