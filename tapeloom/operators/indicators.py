"""Technical indicators. Daily and weekly frames share one implementation.

A series has one row per symbol and open day (or week), so its length is bounded by the calendar:
decades of days are some ten thousand rows, whatever the number of ticks behind them.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tapeloom.functions.columns import previous, series, trailing
from tapeloom.params import (BOLL_STD, BOLL_WINDOW, KDJ_D, KDJ_K, KDJ_WINDOW, MA_WINDOWS, MACD_FAST, MACD_SIGNAL,
                             MACD_SLOW, RSI_WINDOWS, STATS_WINDOWS, VOL_MA_WINDOWS)


def sma(df: DataFrame, col: str = "close", windows=MA_WINDOWS, order: str = "trade_date", prefix: str = "ma") -> DataFrame:
    w = series("symbol", order=order)
    return df.withColumns({f"{prefix}{n}": trailing(F.avg, col, w, n) for n in windows})


def rolling_std(df: DataFrame, col: str = "close", windows=STATS_WINDOWS, order: str = "trade_date", prefix: str = "std") -> DataFrame:
    w = series("symbol", order=order)
    return df.withColumns({f"{prefix}{n}": trailing(F.stddev_pop, col, w, n) for n in windows})


def hist_mean(df: DataFrame, col: str, n: int, order: str = "trade_date", name: str = "hist_mean") -> DataFrame:
    """Mean of the n rows before the current one."""
    return df.withColumn(name, previous(F.avg, col, series("symbol", order=order), n))


def boll(df: DataFrame, order: str = "trade_date") -> DataFrame:
    w = series("symbol", order=order)
    x = df.withColumns({"boll_mid": trailing(F.avg, "close", w, BOLL_WINDOW),
                        "_sd": trailing(F.stddev_pop, "close", w, BOLL_WINDOW)})
    x = x.withColumns({"boll_upper": F.col("boll_mid") + BOLL_STD * F.col("_sd"),
                       "boll_lower": F.col("boll_mid") - BOLL_STD * F.col("_sd")})
    return x.withColumn("boll_bandwidth", (F.col("boll_upper") - F.col("boll_lower")) / F.col("boll_mid")).drop("_sd")


def volume_stats(df: DataFrame, order: str = "trade_date") -> DataFrame:
    w = series("symbol", order=order)
    cols = {f"vol_ma{n}": trailing(F.avg, "volume", w, n) for n in VOL_MA_WINDOWS}
    for n in STATS_WINDOWS:
        cols[f"vol_mean{n}"] = trailing(F.avg, "volume", w, n)
        cols[f"vol_std{n}"] = trailing(F.stddev_pop, "volume", w, n)
        cols[f"amt_mean{n}"] = trailing(F.avg, "amount", w, n)
        cols[f"amt_std{n}"] = trailing(F.stddev_pop, "amount", w, n)
    return df.withColumns(cols)


def change_amp(df: DataFrame, order: str = "trade_date") -> DataFrame:
    prev = F.lag("close").over(series("symbol", order=order))
    return df.withColumns({"pct_chg": (F.col("close") / prev - 1) * 100.0,
                           "amplitude": (F.col("high") - F.col("low")) / prev * 100.0})


# ------------------------------------------------------------- recursive part, one pass per series

def ema_of(s: pd.Series, span: int) -> pd.Series:
    return s.ewm(span=span, adjust=False).mean()


def macd_of(close: pd.Series) -> dict[str, pd.Series]:
    dif = ema_of(close, MACD_FAST) - ema_of(close, MACD_SLOW)
    dea = ema_of(dif, MACD_SIGNAL)
    return {"dif": dif, "dea": dea, "macd_hist": 2 * (dif - dea)}


def rma_of(s: pd.Series, n: int) -> pd.Series:
    """Wilder mean: seeded by the mean of the first gap-free window; a gap gives NaN and keeps the state."""
    seed = s.rolling(n, min_periods=n).mean()
    at = seed.first_valid_index()
    if at is None:
        return seed
    tail = s.loc[at:].copy()
    tail.iloc[0] = seed.loc[at]
    return tail.dropna().ewm(alpha=1.0 / n, adjust=False).mean().reindex(s.index)


def rsi_of(close: pd.Series, n: int) -> pd.Series:
    step = close.diff()
    up, down = rma_of(step.clip(lower=0), n), rma_of((-step).clip(lower=0), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        v = 100.0 - 100.0 / (1.0 + up / down)
    v = v.mask(up == 0, 0.0).mask((down == 0) & (up > 0), 100.0).mask((down == 0) & (up == 0), 50.0)
    return v.mask(up.isna() | down.isna())


def _smooth(x: pd.Series, n: int) -> pd.Series:
    """Recursive mean that starts from 50."""
    seeded = pd.concat([pd.Series([50.0]), x], ignore_index=True).ewm(alpha=1.0 / n, adjust=False).mean()
    return pd.Series(seeded.to_numpy()[1:], index=x.index)


def kdj_of(high: pd.Series, low: pd.Series, close: pd.Series) -> dict[str, pd.Series]:
    """A window without range repeats the values before it."""
    hh = high.rolling(KDJ_WINDOW, min_periods=KDJ_WINDOW).max()
    ll = low.rolling(KDJ_WINDOW, min_periods=KDJ_WINDOW).min()
    seen = hh.notna() & ll.notna()
    moved = seen & (hh != ll)
    rsv = ((close - ll) / (hh - ll) * 100.0)[moved]
    k = _smooth(rsv, KDJ_K)
    d = _smooth(k, KDJ_D)
    k, d = (x.reindex(close.index).ffill().fillna(50.0).where(seen) for x in (k, d))
    return {"kdj_k": k, "kdj_d": d, "kdj_j": 3 * k - 2 * d}


def recursive_columns(pdf: pd.DataFrame) -> dict[str, pd.Series]:
    out = macd_of(pdf["close"])
    for n in RSI_WINDOWS:
        out[f"rsi{n}"] = rsi_of(pdf["close"], n)
    out.update(kdj_of(pdf["high"], pdf["low"], pdf["close"]))
    return out


RECURSIVE = ("dif", "dea", "macd_hist", *[f"rsi{n}" for n in RSI_WINDOWS], "kdj_k", "kdj_d", "kdj_j")


def recursive_indicators(df: DataFrame, order: str = "trade_date", extra_ema: tuple[int, ...] = ()) -> DataFrame:
    """MACD, RSI and KDJ of every series in one grouped pass."""
    names = [*RECURSIVE, *[f"ema{n}" for n in extra_ema]]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        cols = recursive_columns(pdf)
        for n in extra_ema:
            cols[f"ema{n}"] = ema_of(pdf["close"], n)
        return pd.DataFrame({"symbol": pdf["symbol"], order: pdf[order], **{k: cols[k] for k in names}})

    schema = f"symbol string, {order} date, " + ", ".join(f"{k} double" for k in names)
    return df.select("symbol", order, "high", "low", "close").groupBy("symbol").applyInPandas(one, schema)


def compute_indicators(df: DataFrame, order: str = "trade_date", ma_windows=MA_WINDOWS) -> DataFrame:
    """The full table: window columns in the JVM, recursive columns from the grouped pass."""
    win = change_amp(volume_stats(boll(sma(df, windows=ma_windows, order=order), order), order), order)
    return win.join(recursive_indicators(df, order), ["symbol", order])


def indicators_in_place(df: DataFrame, order: str = "trade_date", ma_windows=MA_WINDOWS) -> DataFrame:
    """The same table without a join: rows go through the grouped pass with their window columns. Series that are stored
    bucketed by symbol need no exchange at all."""
    win = change_amp(volume_stats(boll(sma(df, windows=ma_windows, order=order), order), order), order)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        return pdf.assign(**recursive_columns(pdf))

    schema = StructType([*win.schema.fields, *(StructField(k, DoubleType()) for k in RECURSIVE)])
    return win.groupBy("symbol").applyInPandas(one, schema)


def wilder_rma(df: DataFrame, n: int, order: str = "trade_date") -> DataFrame:
    """Wilder means of the gains and losses of close."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        step = pdf["close"].diff()
        return pd.DataFrame({"symbol": pdf["symbol"], order: pdf[order], "rma_gain": rma_of(step.clip(lower=0), n),
                             "rma_loss": rma_of((-step).clip(lower=0), n)})
    return df.select("symbol", order, "close").groupBy("symbol").applyInPandas(
        one, f"symbol string, {order} date, rma_gain double, rma_loss double")
