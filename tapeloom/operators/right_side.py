"""Right-side confirmation: breakout, retest, confirmation, holding, stop."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tapeloom.functions.columns import nonzero, previous, series
from tapeloom.operators.daily_watch import CLOSE, pct
from tapeloom.params import (BREAKOUT_PCT, INVALIDATE_PCT, RETEST_BAND, RETEST_DAYS, RETEST_HOLD, RIGHT_VOLUME, RIGHT_VOLUME_DAYS)


def right_side_inputs(bars: DataFrame) -> DataFrame:
    """Adjusted volume and the mean of the 20 traded days before; incomplete rows leave first."""
    x = bars.where("close_raw is not null and low_raw is not null and volume_raw is not null").withColumn(
        "volume_adj", F.col("volume_raw") / nonzero("share_factor"))
    return x.withColumn("vol_base", previous(F.avg, "volume_adj", series("symbol"), RIGHT_VOLUME_DAYS))


def right_side_flags(x: DataFrame) -> DataFrame:
    """All price and volume tests of a day, in decimals, before the ordered pass."""
    close, low, level = F.col("close_raw").cast(CLOSE), F.col("low_raw").cast(CLOSE), F.col("trigger_level")
    one = F.lit(1).cast("decimal(6,4)")
    yes = lambda col: F.coalesce(col, F.lit(False))
    return x.withColumns({
        "f_break": yes((close >= level * (one + pct(BREAKOUT_PCT))) & (F.col("volume_adj") >= RIGHT_VOLUME * F.col("vol_base"))),
        "f_fail": yes(close <= level * (one - pct(INVALIDATE_PCT))),
        "f_retest": yes((low <= level * (one + pct(RETEST_BAND))) & (close >= level * (one - pct(RETEST_HOLD)))),
        "f_stop": yes(close <= F.col("stop_level")), "has_stop": F.col("stop_level").isNotNull()})


def step(state: str, waited: int, f_break, f_fail, f_retest, f_stop, has_stop):
    """One day: (next state, days waited, emitted state or None, reason)."""
    if state == "idle":
        return ("waiting_retest", 0, "waiting_retest", "breakout_with_volume") if f_break else ("idle", 0, None, None)
    if state == "waiting_retest":
        waited += 1
        if f_fail:
            return "idle", 0, "invalidated", "close_below_invalidate_line"
        if f_retest:
            return ("holding" if has_stop else "idle"), 0, "confirmed", "retest_within_band_and_held"
        if waited >= RETEST_DAYS:
            return "idle", 0, "expired", "no_qualified_retest_within_window"
        return state, waited, None, None
    if f_stop:
        return "idle", 0, "stopped_out", "close_below_stop_level"
    return "holding", 0, "holding", "tracking"


def _scan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("trade_date")
    state, waited, out = "idle", 0, []
    flags = pdf[["f_break", "f_fail", "f_retest", "f_stop", "has_stop"]].itertuples(index=False)
    for day, f in zip(pdf["trade_date"], flags):
        state, waited, emitted, reason = step(state, waited, *f)
        if emitted:
            out.append((day, emitted, emitted != "holding", reason))
    res = pd.DataFrame(out, columns=["observed_on", "state", "triggered", "reason"])
    res.insert(0, "symbol", pdf["symbol"].iloc[0])
    res.insert(1, "card_version_id", pdf["card_version_id"].iloc[0])
    return res


RIGHT_SCHEMA = "symbol string, card_version_id string, observed_on date, state string, triggered boolean, reason string"


def right_side(bar_cards: DataFrame, freezes: DataFrame | None = None) -> DataFrame:
    """State changes and holding days per card version. Days from the earliest open freeze on are left out."""
    x = bar_cards.where("trigger_level is not null")
    if freezes is not None:
        frozen = freezes.groupBy("symbol").agg(F.min("ex_date").alias("frozen_from"))
        x = x.join(frozen, "symbol", "left").where("frozen_from is null or trade_date < frozen_from")
    flags = right_side_flags(x).select("symbol", "card_version_id", "trade_date", "f_break", "f_fail", "f_retest", "f_stop", "has_stop")
    return flags.groupBy("symbol", "card_version_id").applyInPandas(_scan, RIGHT_SCHEMA)
