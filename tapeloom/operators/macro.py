"""Macro factor readings aligned to a day."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tapeloom.operators.timeops import asof

STALE_DAYS = 5
CHANGE_READINGS = (20, 60)


def factor_changes(macro: DataFrame, windows=CHANGE_READINGS) -> DataFrame:
    """Change over the last n readings of a factor (readings, not days), six places."""
    w = Window.partitionBy("code").orderBy("trade_date")
    return macro.withColumns({f"change_{n}": F.round(
        F.col("close").cast("double") / F.nullif(F.lag("close", n).over(w).cast("double"), F.lit(0.0)) - 1, 6) for n in windows})


def factor_asof(days: DataFrame, macro: DataFrame, spine: DataFrame, windows=CHANGE_READINGS) -> DataFrame:
    """Latest reading per (code, day): global factors strictly before the day, domestic ones up to it.

    Stale when more than five open days lie between reading and day.
    """
    changes = [f"change_{n}" for n in windows]
    market = macro.groupBy("code").agg(F.max("market").alias("market"))
    rows = factor_changes(macro, windows).select("code", F.col("trade_date").alias("_rd"), "close", *changes)
    x = days.join(market, "code", "left").withColumn("_cut", F.when(F.col("market") == "GLOBAL", F.date_sub("as_of", 1)).otherwise(F.col("as_of")))
    x = asof(x, rows, ["code"], "_cut", "_rd", [F.col("_rd").alias("reading_date"), "close", *changes])
    open_upto = spine.select("day", (F.col("open_before") + F.col("is_open").cast("int")).alias("_n"))
    x = x.join(open_upto.select(F.col("day").alias("as_of"), F.col("_n").alias("_a")), "as_of", "left").join(
        open_upto.select(F.col("day").alias("reading_date"), F.col("_n").alias("_r")), "reading_date", "left")
    lag = F.col("_a") - F.col("_r")
    status = F.when(F.col("reading_date").isNull(), "missing").when(lag > STALE_DAYS, "stale").otherwise("ok")
    return x.withColumns({"status": status, "market": F.coalesce("market", F.lit("CN"))}).drop("_cut", "_a", "_r")


def exposures(watch: DataFrame, by_symbol: DataFrame, by_industry: DataFrame) -> DataFrame:
    """Factors of a symbol: its own list replaces that of its industry."""
    own = watch.select("symbol").join(by_symbol, "symbol")
    rest = watch.join(by_symbol.select("symbol").distinct(), "symbol", "left_anti")
    via = rest.select("symbol", "industry_code").join(by_industry, "industry_code").drop("industry_code")
    return own.unionByName(via)


def factor_snapshot(pool: DataFrame, exposure: DataFrame, macro: DataFrame, spine: DataFrame) -> DataFrame:
    """Readings of every factor a symbol is exposed to on its day; factors without a reading stay as missing."""
    x = pool.select("symbol", "as_of").join(exposure, "symbol")
    read = factor_asof(x.select("code", "as_of").distinct(), macro, spine)
    return x.join(read, ["code", "as_of"], "left")
