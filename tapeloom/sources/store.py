"""Derived tables that are kept between runs.

A table is bucketed by symbol and partitioned by year. Windows and grouped maps per symbol then start from the files without an
exchange, a range of days reads the years that it touches, and a refresh writes those years only.
"""
from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.session import cut_lineage, discard

OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 8) -> None:
        """``buckets`` is the number of tasks that later work per symbol is spread over; all tables of a store share it."""
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def name(self, table: str) -> str:
        return f"tapeloom_{zlib.crc32(self.folder.encode()):08x}_{table}"

    def create(self, table: str, rows: DataFrame, day: str = "trade_date") -> None:
        """One file a bucket and year, sorted by symbol and day."""
        spread = rows.withColumn("year", F.year(day)).repartition(self.buckets, "symbol")
        spread.write.partitionBy("year").bucketBy(self.buckets, "symbol").sortBy("symbol", day).option("path", f"{self.folder}/{table}").saveAsTable(self.name(table))

    def read(self, table: str, start: str | None = None, end: str | None = None, day: str = "trade_date") -> DataFrame:
        """Rows from ``start`` to ``end``, both included; other years are not read."""
        rows = self.spark.table(self.name(table))
        if start is not None:
            rows = rows.where((F.col("year") >= int(start[:4])) & (F.col(day) >= F.lit(start).cast("date")))
        if end is not None:
            rows = rows.where((F.col("year") <= int(end[:4])) & (F.col(day) <= F.lit(end).cast("date")))
        return rows.drop("year")

    def refresh(self, table: str, rows: DataFrame, day: str = "trade_date") -> None:
        """``rows`` take the place of those of the same symbol and day, or are added; years without any are left alone."""
        old = self.spark.table(self.name(table))
        new = cut_lineage(rows.withColumn("year", F.year(day)))
        kept = old.join(new.select("year").distinct(), "year", "left_semi").join(new.select("symbol", day), ["symbol", day], "left_anti")
        whole = cut_lineage(kept.select(*old.columns).unionByName(new.select(*old.columns)))
        before = self.spark.conf.get(OVERWRITE)
        self.spark.conf.set(OVERWRITE, "dynamic")
        try:
            whole.repartition(self.buckets, "symbol").write.insertInto(self.name(table), overwrite=True)
        finally:
            self.spark.conf.set(OVERWRITE, before)
        discard(new, whole)
        self.spark.catalog.refreshTable(self.name(table))

    def drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")
