"""Calendar ordinals, as-of joins, runs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.functions.columns import c


def trading_ordinals(days: DataFrame, keys=("market",)) -> DataFrame:
    """Number open days. The calendar has one row per market and day, so a partition is tiny."""
    w = Window.partitionBy(*keys).orderBy("trade_date")
    return days.withColumn("td_ord", F.row_number().over(w))


def day_spine(cal: DataFrame, pad: int = 60, keys=("market",)) -> DataFrame:
    """One row per natural day: open days before it, next open day after it, open flag.

    Turns "last open day before", "k-th open day after" into equi-joins on the date.
    """
    ks = list(keys)
    span = cal.groupBy(*ks).agg(F.min("trade_date").alias("_lo"), F.max("trade_date").alias("_hi"))
    days = span.select(*ks, F.explode(F.sequence(F.date_sub("_lo", pad), F.date_add("_hi", pad))).alias("day"))
    flags = cal.where("is_open").select(*ks, F.col("trade_date").alias("day"), F.lit(1).alias("_open"))
    w = Window.partitionBy(*ks).orderBy("day")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    opened = F.when(F.col("_open") == 1, F.col("day"))
    return days.join(flags, [*ks, "day"], "left").select(
        *ks, "day", (F.col("_open") == 1).alias("_is_open"),
        F.coalesce(F.sum("_open").over(before), F.lit(0)).cast("int").alias("open_before"),
        F.max(opened).over(before).alias("prev_open"),
        F.min(opened).over(after).alias("next_open"),
    ).withColumn("is_open", F.coalesce("_is_open", F.lit(False))).drop("_is_open")


def asof(left: DataFrame, right: DataFrame, keys, ltime: str, rtime: str, cols, *,
         strict: bool = False, unique: bool = False, backward: bool = True) -> DataFrame:
    """Latest right row at or before (``strict``: before) the left time, per key.

    ``right`` must be unique on (keys, rtime). One sort of the union instead of a range join. Unless
    ``left`` is declared unique on (keys, ltime), only its distinct points go through the window, so a
    window holds at most the distinct times of a key however many left rows share them.
    ``backward=False`` looks forward instead.
    """
    keys = list(keys)
    probe = left if unique else left.select(*keys, ltime).distinct()
    value = F.struct(*[c(x) for x in cols])
    rows = right.select(*keys, F.col(rtime).alias("_t"), F.lit(1 if strict else 0).alias("_side"), value.alias("_v"),
                        F.lit(None).cast(_struct_type(probe)).alias("_l"))
    probes = probe.select(*keys, F.col(ltime).alias("_t"), F.lit(0 if strict else 1).alias("_side"),
                          F.lit(None).cast(rows.schema["_v"].dataType).alias("_v"),
                          F.struct(*[F.col(x) for x in probe.columns]).alias("_l"))
    t = F.col("_t") if backward else F.col("_t").desc()
    w = Window.partitionBy(*keys).orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    hit = (rows.unionByName(probes).withColumn("_v", F.last("_v", True).over(w))
           .where(F.col("_l").isNotNull()).select("_l.*", "_v.*"))
    return hit if unique else left.join(hit, [*keys, ltime], "left")


def _struct_type(df: DataFrame):
    return df.schema


def run_ids(changed: Column, w) -> Column:
    """Running number of the island a row belongs to; ``changed`` marks the first row of one."""
    return F.sum(F.when(changed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
