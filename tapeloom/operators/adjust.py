"""Price-adjustment factors: source factor, plateaus, share factor, change checks, adjusted bars."""
from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tapeloom.functions.columns import nonzero, series
from tapeloom.operators.timeops import asof
from tapeloom.params import MAX_ACTION_LAG, PLATEAU_TOL


def source_factor(raw: DataFrame, fwd: DataFrame) -> DataFrame:
    """Forward close over raw close on the days both have."""
    return raw.where("close_raw <> 0").join(fwd, ["symbol", "trade_date"]).select(
        "symbol", "trade_date", (F.col("close_fwd") / F.col("close_raw")).alias("f"))


def _plateaus_of(tol: float):
    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trade_date")
        rows, ordered, start, last = [], [], None, None

        def mid():
            n = len(ordered)
            return ordered[n // 2] if n % 2 else (ordered[n // 2 - 1] + ordered[n // 2]) / 2

        for day, v in zip(pdf["trade_date"], pdf["f"]):
            if ordered:
                m = mid()
                if m and abs(v - m) / abs(m) > tol:
                    rows.append((start, last, m, len(ordered)))
                    ordered, start = [], day
            else:
                start = day
            bisect.insort(ordered, v)
            last = day
        if ordered:
            rows.append((start, last, mid(), len(ordered)))
        out = pd.DataFrame(rows, columns=["start_date", "end_date", "factor", "days"])
        out.insert(0, "symbol", pdf["symbol"].iloc[0])
        out["seq"] = range(1, len(out) + 1)
        return out
    return scan


def detect_plateaus(f: DataFrame, tol: float = PLATEAU_TOL) -> DataFrame:
    """Segments whose days stay within ``tol`` of the running median of the segment."""
    schema = "symbol string, start_date date, end_date date, factor double, days long, seq long"
    return f.groupBy("symbol").applyInPandas(_plateaus_of(tol), schema)


def normalise_factor(f: DataFrame, plateaus: DataFrame, origin: DataFrame) -> DataFrame:
    """Plateau value of each day over the plateau value of the symbol's first bar.

    A symbol whose first bar has no forward price gets no rows, as the base is unknown.
    """
    flat = asof(f, plateaus, ["symbol"], "trade_date", "start_date", ["factor"], unique=True)
    first = origin.groupBy("symbol").agg(F.min("trade_date").alias("trade_date"))
    base = flat.join(first, ["symbol", "trade_date"]).select("symbol", F.col("factor").alias("base"))
    return flat.join(base, "symbol").select(
        "symbol", "trade_date", (F.col("factor") / F.col("base")).alias("price_adj_factor"))


def share_factor(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Product of 1/ratio over the splits after the day, as one reverse running product."""
    splits = actions.where(F.col("split_ratio").isNotNull() & F.col("action_type").isin("split", "bonus_share")).groupBy(
        "symbol", F.col("ex_date").alias("trade_date")).agg(F.product(1 / F.col("split_ratio").cast("double")).alias("_m"))
    rows = bars.select("symbol", "trade_date", F.lit(None).cast("double").alias("_m"), F.lit(0).alias("_k")).unionByName(
        splits.withColumn("_k", F.lit(1)))
    w = Window.partitionBy("symbol").orderBy(F.col("trade_date").desc(), "_k").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("share_factor", F.coalesce(F.product("_m").over(w), F.lit(1.0))).where("_k = 0").select(
        "symbol", "trade_date", "share_factor")


def factor_change(internal: DataFrame, new: DataFrame, ref: DataFrame, tol: float = PLATEAU_TOL) -> DataFrame:
    """Has the source's factor moved against the stored one? One row per symbol with the reason."""
    both = internal.join(new, ["symbol", "trade_date"])
    overlap = both.groupBy("symbol").agg(F.count("*").alias("n_common"))
    ratios = both.where("price_adj_factor <> 0").select("symbol", (F.col("f") / F.col("price_adj_factor")).alias("ratio"))
    med = ratios.groupBy("symbol").agg(F.median("ratio").alias("median_ratio"), F.count("*").alias("n_overlap"))
    spread = ratios.join(med, "symbol").groupBy("symbol").agg(
        F.max(F.abs(F.col("ratio") - F.col("median_ratio")) / F.abs("median_ratio")).alias("max_dev"))
    x = (internal.select("symbol").distinct().join(overlap, "symbol", "left").join(med, "symbol", "left")
         .join(spread, "symbol", "left").join(ref, "symbol", "left"))
    shift = F.abs(F.col("median_ratio") - F.col("f_origin")) / F.abs("f_origin")
    reason = (F.when(F.col("n_common").isNull(), "empty_overlap").when(F.col("n_overlap").isNull(), "zero_factor")
              .when(F.col("max_dev") > tol, "plateau_in_window").when(F.col("f_origin").isNull(), "no_reference")
              .when(shift > tol, "level_shift").otherwise("consistent"))
    return x.select("symbol", F.coalesce("n_overlap", F.lit(0)).alias("n_overlap"), "median_ratio", "max_dev", "f_origin",
                    reason.alias("reason"), (reason != "consistent").alias("changed"))


def cross_check_actions(plateaus: DataFrame, actions: DataFrame, spine: DataFrame | None) -> DataFrame:
    """Distance of each plateau switch to the nearest ex-date, in open days (natural days without a calendar).

    The nearest ex-date is the last one at or before the switch or the first one after it.
    """
    sw = plateaus.where("seq > 1").select("symbol", F.col("start_date").alias("switch_date"))
    ex = actions.select("symbol", "ex_date").distinct()
    if spine is None:
        pos = lambda df, d: df.withColumn("_o", F.datediff(F.col(d), F.lit("1970-01-01")))
    else:
        ords = spine.select(F.col("day"), F.col("open_before").alias("_o"))
        pos = lambda df, d: df.join(ords.withColumnRenamed("day", d), d)
    sw = pos(sw, "switch_date")
    ex = pos(ex, "ex_date").groupBy("symbol", F.col("_o").alias("_e")).agg(F.min("ex_date").alias("ex_date"))
    back = asof(sw, ex, ["symbol"], "_o", "_e", [F.col("_e").alias("e0"), F.col("ex_date").alias("x0")])
    both = asof(back, ex, ["symbol"], "_o", "_e", [F.col("_e").alias("e1"), F.col("ex_date").alias("x1")], backward=False)
    d0, d1 = F.abs(F.col("_o") - F.col("e0")), F.abs(F.col("_o") - F.col("e1"))
    use0 = d1.isNull() | (d0 <= d1)
    return both.select(
        "symbol", "switch_date", F.when(use0, F.col("x0")).otherwise(F.col("x1")).alias("nearest_ex_date"),
        F.when(use0, d0).otherwise(d1).alias("distance")).withColumn(
        "status", F.when(F.col("distance").isNull(), "unchecked").when(F.col("distance") > MAX_ACTION_LAG, "warn").otherwise("ok"))


def apply_adjustment(bars: DataFrame, price: DataFrame, share: DataFrame) -> DataFrame:
    """Write factors rounded to six places onto the bars; days without a new price factor keep both old ones."""
    p = price.select("symbol", "trade_date", F.round("price_adj_factor", 6).alias("_p"))
    s = share.select("symbol", "trade_date", F.round("share_factor", 6).alias("_s"))
    x = bars.join(p, ["symbol", "trade_date"], "left").join(s, ["symbol", "trade_date"], "left")
    return x.select(
        *[col for col in bars.columns if col not in ("price_adj_factor", "share_factor")],
        F.coalesce("_p", "price_adj_factor").alias("price_adj_factor"),
        F.when(F.col("_p").isNotNull(), F.col("_s")).otherwise(F.col("share_factor")).alias("share_factor"),
        F.col("_p").isNotNull().alias("updated"))


def adjusted_bars(bars: DataFrame) -> DataFrame:
    """OHLC times the price factor, volume over the share factor, amount as it is."""
    f = F.coalesce("price_adj_factor", F.lit(1.0))
    return bars.select(
        "symbol", "trade_date", *[(F.col(f"{k}_raw") * f).alias(k) for k in ("open", "high", "low", "close")],
        (F.col("volume_raw") / nonzero("share_factor")).alias("volume"), F.col("amount_raw").alias("amount"))


def inherit_factor(bars: DataFrame) -> DataFrame:
    """A bar without factors takes those of the bar before it, 1.0 if there is none."""
    w = series("symbol").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumns({k: F.coalesce(F.last(k, True).over(w), F.lit(1.0))
                             for k in ("price_adj_factor", "share_factor")})
