"""Completed-week bars."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeloom.functions.columns import nonzero, week_of


def calendar_weeks(cal: DataFrame) -> DataFrame:
    return cal.where("is_open").groupBy(week_of("trade_date").alias("wk")).agg(
        F.min("trade_date").alias("week_start_date"), F.max("trade_date").alias("week_end_date"))


def weekly_bars(bars: DataFrame, cal: DataFrame) -> DataFrame:
    """ISO-week bars from daily-adjusted prices.

    A week counts only when the symbol traded on its last open day; weeks in progress and weeks
    outside the calendar drop out with the same condition.
    """
    f = nonzero("price_adj_factor")
    g = bars.groupBy("symbol", week_of("trade_date").alias("wk")).agg(
        F.min_by(F.col("open_raw") * f, "trade_date").alias("open"),
        F.max(F.col("high_raw") * f).alias("high"), F.min(F.col("low_raw") * f).alias("low"),
        F.max_by(F.col("close_raw") * f, "trade_date").alias("close"),
        F.max_by("close_raw", "trade_date").alias("close_raw"),
        F.sum(F.coalesce("volume_raw", F.lit(0.0)) / nonzero("share_factor")).alias("volume"),
        F.sum("amount_raw").alias("amount"), F.count("*").alias("trading_days"), F.max("trade_date").alias("_last"))
    return g.join(calendar_weeks(cal), "wk").where("_last = week_end_date").drop("_last")


def weekly_raw(bars: DataFrame, weeks: DataFrame) -> DataFrame:
    """Unadjusted OHLCV within the bounds of each completed week."""
    bounds = weeks.select("symbol", "wk", "week_start_date", "week_end_date")
    x = bars.withColumn("wk", week_of("trade_date")).join(bounds, ["symbol", "wk"]).where(
        "trade_date between week_start_date and week_end_date")
    return x.groupBy("symbol", "week_end_date").agg(
        F.min_by("open_raw", "trade_date").alias("open"), F.max("high_raw").alias("high"), F.min("low_raw").alias("low"),
        F.max_by("close_raw", "trade_date").alias("close"), F.sum("volume_raw").alias("volume"),
        F.sum("amount_raw").alias("amount"))
