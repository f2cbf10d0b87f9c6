"""Point-in-time reports, TTM profit, share counts, PE and fundamentals.

What a day can see changes only when a report or share event becomes available. TTM and shares are therefore
computed once per visibility point (some tens per symbol) and days pick their point with one as-of join.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.operators.timeops import asof

AMOUNT = "decimal(38,4)"
PREFERRED_GROUP = "常用指标"  # fixed value: indicator group whose values win
UNBOUNDED = Window.unboundedPreceding


def mmdd(d="period_end") -> Column:
    return F.date_format(d, "MM-dd")


def latest_revisions(reports: DataFrame) -> DataFrame:
    """Newest revision of every period."""
    keys = ["symbol", "period_end", "period_type", "is_cumulative"]
    rest = [c for c in reports.columns if c not in keys]
    return reports.groupBy(*keys).agg(F.max_by(F.struct(*rest), "revision").alias("_r")).select(*keys, "_r.*")


def visible_latest(reports: DataFrame) -> DataFrame:
    """Per visibility point: the latest report then visible, in its newest visible revision."""
    row = F.struct("period_end", "fiscal_year", "revision", "period_type", "is_cumulative", "net_profit_attr")
    pts = reports.groupBy("symbol", F.col("available_date").alias("visible_from")).agg(F.max(row).alias("_r"), F.count("*").alias("_n"))
    w = Window.partitionBy("symbol").orderBy("visible_from").rowsBetween(UNBOUNDED, 0)
    return pts.select("symbol", "visible_from", F.max("_r").over(w).alias("_r"), F.sum("_n").over(w).alias("visible_rows")).select(
        "symbol", "visible_from", "visible_rows", "_r.*")


def _newest(reports: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per key and availability: profit of the newest revision visible by then."""
    w = Window.partitionBy(*keys).orderBy("available_date").rowsBetween(UNBOUNDED, 0)
    g = reports.groupBy(*keys, "available_date").agg(F.max(F.struct("revision", "net_profit_attr")).alias("_r"))
    return g.select(*keys, "available_date", F.max("_r").over(w).alias("_r")).select(
        *keys, "available_date", F.lit(True).alias(f"has_{name}"), F.col("_r.net_profit_attr").alias(f"np_{name}"))


def ttm(reports: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """TTM profit and reason per visibility point: an annual report as it is, else last year's annual plus this
    year's cumulative less last year's cumulative of the same date."""
    pts = (visible_latest(reports) if points is None else points).withColumns({
        "prev_fy": F.col("fiscal_year") - 1, "md": mmdd()})
    x = reports.withColumns({"prev_fy": F.col("fiscal_year"), "md": mmdd()})
    annual = _newest(x.where("period_type = 'annual'"), ["symbol", "prev_fy"], "annual")
    same = _newest(x.where("is_cumulative"), ["symbol", "prev_fy", "period_type", "md"], "same")
    pts = asof(pts, annual, ["symbol", "prev_fy"], "visible_from", "available_date", ["has_annual", "np_annual"], unique=True)
    pts = asof(pts, same, ["symbol", "prev_fy", "period_type", "md"], "visible_from", "available_date", ["has_same", "np_same"], unique=True)
    return pts.drop("prev_fy", "md").withColumns(_ttm_columns())


def _ttm_columns() -> dict[str, Column]:
    cur = F.col("net_profit_attr")
    year = F.col("period_type") == "annual"
    any_null = cur.isNull() | F.col("np_annual").isNull() | F.col("np_same").isNull()
    reason = (F.when(year, F.when(cur.isNull(), "ttm_missing_net_profit").otherwise("ok"))
              .when(F.col("has_annual").isNull(), "ttm_missing_prev_annual").when(F.col("has_same").isNull(), "ttm_missing_prev_same_period")
              .when(any_null, "ttm_missing_net_profit").otherwise("ok"))
    return {"ttm": F.when(year, cur).otherwise(F.col("np_annual") + cur - F.col("np_same")).cast(AMOUNT), "ttm_reason": reason}


def ttm_assuming_visible(reports: DataFrame) -> DataFrame:
    """TTM from the newest revisions whatever their availability, one row per symbol."""
    x = latest_revisions(reports).withColumn("available_date", F.lit("1900-01-01").cast("date"))
    return ttm(x)


def share_timeline(events: DataFrame) -> DataFrame:
    """Share count in force from each day it became usable: the latest effective event, group totals first on ties.

    Snapshot events count from their effective day, others once also available.
    """
    snap = F.col("event_type").startswith("snapshot_")
    usable = F.when(snap, F.col("effective_at")).otherwise(F.greatest("effective_at", "available_at"))
    prio = F.when(F.col("share_count_type") == "group_total", 1).otherwise(0)
    g = events.where("shares is not null").groupBy("symbol", usable.alias("usable_from")).agg(
        F.max(F.struct("effective_at", prio.alias("prio"), "shares", snap.alias("snapshot"))).alias("_s"))
    w = Window.partitionBy("symbol").orderBy("usable_from").rowsBetween(UNBOUNDED, 0)
    return g.select("symbol", "usable_from", F.max("_s").over(w).alias("_s")).select("symbol", "usable_from", "_s.*")


def shares_asof(days: DataFrame, events: DataFrame) -> DataFrame:
    return asof(days, share_timeline(events), ["symbol"], "trade_date", "usable_from", ["shares", "snapshot", "effective_at"], unique=True)


def pe_ttm(x: DataFrame, trade_currency: str = "CNY") -> DataFrame:
    """close x shares / TTM with its status; a report currency other than the traded one gives no PE."""
    fx = F.col("currency").isNotNull() & (F.col("currency") != trade_currency)
    status = (F.when(F.col("shares").isNull() | (F.col("shares") <= 0), "no_share_capital")
              .when(F.col("ttm").isNull(), F.coalesce("ttm_reason", F.lit("no_visible_report")))
              .when(F.col("ttm") <= 0, "ttm_non_positive").when(fx, "fx_missing").otherwise("ok"))
    pe = F.col("close_raw") * F.col("shares").cast("double") / F.col("ttm").cast("double")
    return x.withColumn("pe_status", status).withColumn("pe_ttm", F.when(F.col("pe_status") == "ok", pe))


def pe_series(bars: DataFrame, reports: DataFrame, events: DataFrame, trade_currency: str = "CNY") -> DataFrame:
    """Daily PE. A symbol with a newest revision that lacks its publication date uses all reports at all times and
    says so; a count taken from a share snapshot says so too."""
    flags = latest_revisions(reports).groupBy("symbol").agg(
        F.max(F.col("published_at").isNull()).alias("degraded"), F.max("currency").alias("currency"))
    days = bars.select("symbol", "trade_date", "close_raw").join(flags, "symbol", "left")
    x = asof(days, ttm(reports), ["symbol"], "trade_date", "visible_from", ["ttm", "ttm_reason"], unique=True)
    whole = ttm_assuming_visible(reports).select("symbol", F.col("ttm").alias("_t"), F.col("ttm_reason").alias("_r"))
    x = x.join(whole, "symbol", "left")
    deg = F.coalesce("degraded", F.lit(False))
    x = x.withColumns({"ttm": F.when(deg, F.col("_t")).otherwise(F.col("ttm")),
                       "ttm_reason": F.when(deg, F.col("_r")).otherwise(F.col("ttm_reason"))}).drop("_t", "_r")
    # a day that sees no report knows no currency either; PE is empty then anyway
    y = pe_ttm(shares_asof(x, events), trade_currency)
    full = F.concat("pe_status", F.when(F.col("snapshot"), ";snapshot_share_basis").otherwise(""),
                    F.when(deg, ";degraded_available_at").otherwise(""))
    return y.withColumn("pe_status_full", full)


def pe_quantiles(pe: DataFrame) -> DataFrame:
    """Linear-interpolated quantiles with the sample window."""
    ps = (5, 25, 50, 75, 95)
    q = F.percentile("pe_ttm", F.array(*[F.lit(p / 100) for p in ps]))
    g = pe.where("pe_ttm is not null").groupBy("symbol").agg(
        q.alias("_q"), F.count("*").alias("n_days"), F.min("trade_date").alias("start"), F.max("trade_date").alias("end"),
        F.max_by("pe_ttm", "trade_date").alias("current_pe"))
    return g.select("symbol", "n_days", "start", "end", "current_pe", *[F.col("_q")[i].alias(f"p{p}") for i, p in enumerate(ps)])


def ratio(a, b) -> Column:
    return F.col(a).cast("double") / F.nullif(F.col(b).cast("double"), F.lit(0.0))


def yoy(reports: DataFrame, cols=("revenue", "net_profit_attr")) -> DataFrame:
    """Change against the same type, basis and month-day a fiscal year before, over the signed old value."""
    keys = ["symbol", "period_type", "is_cumulative", "md", "fiscal_year"]
    x = reports.withColumn("md", mmdd())
    old = x.select(*keys[:-1], (F.col("fiscal_year") + 1).alias("fiscal_year"), *[F.col(c).alias(f"_{c}") for c in cols])
    y = x.join(old, keys, "left")
    return y.select(*reports.columns, *[(ratio(c, f"_{c}") - 1).alias(f"{c}_yoy") for c in cols])


FORECAST_ROW = "struct<ths_fore_np_fy1_stock:string,ths_fore_np_fy2_stock:string,ths_fore_np_fy3_stock:string,ths_fore_np_yoy_stock:string,ths_pb_mrq_stock:string,ths_ps_lyr_stock:string>"


def forecast_extract(forecasts: DataFrame) -> DataFrame:
    """First row with an FY1 profit of each symbol's latest snapshot."""
    last = forecasts.groupBy("symbol").agg(F.max_by(F.struct("snapshot_at", "payload_json"), "snapshot_at").alias("f"))
    rows = F.from_json("f.payload_json", f"struct<rows:array<{FORECAST_ROW}>>")["rows"]
    x = last.select("symbol", F.col("f.snapshot_at").alias("snapshot_at"), rows.alias("rows"))
    rec = F.filter("rows", lambda r: F.trim(F.coalesce(r["ths_fore_np_fy1_stock"], F.lit(""))) != "")
    num = lambda k: F.nullif(F.trim(F.col(f"_r.ths_fore_np_{k}_stock")), F.lit("")).try_cast(AMOUNT)
    first = lambda k: F.element_at(F.concat(F.filter(F.transform("rows", lambda r: r[k]), lambda v: F.coalesce(v, F.lit("")) != ""),
                                            F.array(F.lit(None).cast("string"))), 1).try_cast("double")
    return x.withColumn("_r", F.when(F.size(rec) > 0, rec[0])).select(
        "symbol", "snapshot_at", num("fy1").alias("fy1"), num("fy2").alias("fy2"), num("fy3").alias("fy3"),
        (num("yoy").cast("double") / 100).alias("fy1_yoy"), first("ths_pb_mrq_stock").alias("pb_mrq"), first("ths_ps_lyr_stock").alias("ps_lyr"))


def forecast_gap(forecasts: DataFrame, reports: DataFrame) -> DataFrame:
    """FY growth path and the gap, in points, between the forecast and the latest actual growth."""
    last = yoy(latest_revisions(reports)).groupBy("symbol").agg(
        F.max_by(F.struct("period_end", "net_profit_attr_yoy"), "period_end").alias("a"))
    x = forecast_extract(forecasts).join(last, "symbol", "left")
    return x.select("symbol", "snapshot_at", F.year("snapshot_at").alias("fy1_year"), "fy1", "fy2", "fy3", "fy1_yoy",
                    (ratio("fy2", "fy1") - 1).alias("fy2_yoy"), (ratio("fy3", "fy2") - 1).alias("fy3_yoy"),
                    F.col("a.period_end").alias("actual_period"), F.col("a.net_profit_attr_yoy").alias("actual_yoy"),
                    ((F.col("fy1_yoy") - F.col("a.net_profit_attr_yoy")) * 100).alias("gap_pp"))


def flatten_snapshot(snap: DataFrame) -> DataFrame:
    """Nested indicator snapshot to rows; the preferred group wins, else the first group that has the name."""
    x = snap.select("symbol", "period_end", F.posexplode(F.map_entries("payload")).alias("pos", "g"))
    x = x.select("symbol", "period_end", "pos", F.col("g.key").alias("grp"), F.explode("g.value").alias("indicator", "value"))
    order = F.struct(F.when(F.col("grp") == PREFERRED_GROUP, 0).otherwise(1), "pos")
    return x.groupBy("symbol", "period_end", "indicator").agg(F.min_by("value", order).alias("value"))


def fundamentals(reports: DataFrame, balance: DataFrame, cash: DataFrame, snap: DataFrame) -> DataFrame:
    """Cumulative statements of the newest revisions with derived ratios and what is missing."""
    keys = ["symbol", "period_end", "period_type"]
    x = yoy(latest_revisions(reports.where("is_cumulative"))).join(balance, keys, "left").join(cash, keys, "left")
    flat = flatten_snapshot(snap).where(F.col("indicator").isin("毛利率", "净资产收益率(ROE)")).groupBy("symbol", "period_end").agg(
        F.max(F.when(F.col("indicator") == "毛利率", F.col("value"))).alias("gross_margin_src"),
        F.max(F.when(F.col("indicator") != "毛利率", F.col("value"))).alias("roe_src"))
    x = x.join(flat, ["symbol", "period_end"], "left")
    parts = [F.col(c) for c in ("short_term_borrowing", "long_term_borrowing", "bonds_payable", "noncurrent_liab_1y")]
    debt = sum((F.coalesce(p, F.lit(0).cast(AMOUNT)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0).cast(AMOUNT)))
    known = F.coalesce(*parts).isNotNull()
    return x.withColumns({
        "net_margin": ratio("net_profit_attr", "revenue"), "roe": ratio("net_profit_attr", "total_equity_attr"),
        "liability_ratio": ratio("total_liabilities", "total_assets"), "interest_debt": F.when(known, debt),
        "fcf": F.col("ocf") - F.col("capex"), "ocf_to_np": ratio("ocf", "net_profit_attr"),
        "incomplete": F.array_join(F.array_compact(F.array(
            F.when(F.col("total_assets").isNull(), "balance_sheet"), F.when(F.col("ocf").isNull(), "cash_flow"),
            F.when(F.col("gross_margin_src").isNull(), "gross_margin"))), ",")})


def implied_returns(forecast: DataFrame, quantiles: DataFrame, shares: DataFrame, close: DataFrame) -> DataFrame:
    """Forecast EPS times the quartiles of PE: implied price and upside, one row per year and quartile."""
    x = close.join(shares, "symbol", "left").join(forecast, "symbol", "left").join(quantiles, "symbol", "left")
    cells = F.explode(F.array(*[
        F.struct(F.lit(fy).alias("fy"), F.lit(p).alias("quantile"), F.col(fy).alias("np"), F.col(p).alias("pe"))
        for fy in ("fy1", "fy2") for p in ("p25", "p50", "p75")]))
    y = x.select("symbol", "close_raw", "shares", cells.alias("c")).select("symbol", "close_raw", "shares", "c.*")
    eps = F.col("np").cast("double") / F.col("shares").cast("double")
    status = F.when(F.col("shares").isNull() | F.col("close_raw").isNull(), "no_share_or_price").when(F.col("np").isNull(), "no_forecast").otherwise("ok")
    return y.withColumns({"eps": eps, "implied_price": eps * F.col("pe"), "upside": eps * F.col("pe") / F.col("close_raw") - 1, "status": status})


def pool_comps(pe: DataFrame, reports: DataFrame, balance: DataFrame) -> DataFrame:
    """Per symbol: latest PE, latest profit growth, return on equity and leverage of the last balance sheet."""
    keys = ["symbol", "period_end", "period_type"]
    p = pe.where("pe_ttm is not null").groupBy("symbol").agg(F.max_by(F.struct("trade_date", "pe_ttm"), "trade_date").alias("p"))
    rep = yoy(latest_revisions(reports.where("is_cumulative"))).join(balance, keys, "left")
    pick = F.struct("period_end", "net_profit_attr_yoy", ratio("net_profit_attr", "total_equity_attr").alias("roe"),
                    ratio("total_liabilities", "total_assets").alias("lev"))
    g = rep.groupBy("symbol").agg(F.max_by(pick, "period_end").alias("r"),
                                  F.max_by(F.when(F.col("total_assets").isNotNull(), pick), F.when(F.col("total_assets").isNotNull(), F.col("period_end"))).alias("b"))
    return g.join(p, "symbol", "left").select(
        "symbol", F.col("p.pe_ttm").alias("pe_ttm"), F.col("p.trade_date").alias("pe_date"), F.col("r.period_end").alias("latest_period"),
        F.col("r.net_profit_attr_yoy").alias("net_profit_yoy"), F.col("b.roe").alias("roe"), F.col("b.lev").alias("liability_ratio"))


def fundamental_panel(reports: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Latest annual and latest other report with growth, in 1e8 units, and PB/PS of the forecast snapshot."""
    rep = yoy(latest_revisions(reports))
    yi = lambda c: F.round(F.col(c).cast("double") / 1e8, 2)
    row = F.struct("period_end", yi("revenue").alias("rev"), yi("net_profit_attr").alias("np"),
                   F.round("revenue_yoy", 4).alias("rev_yoy"), F.round("net_profit_attr_yoy", 4).alias("np_yoy"))
    ann = F.col("period_type") == "annual"
    pick = lambda cond: F.max_by(F.when(cond, row), F.when(cond, F.col("period_end")))
    g = rep.groupBy("symbol").agg(pick(ann).alias("a"), pick(~ann).alias("i")).join(forecast_extract(forecasts), "symbol", "left")
    return g.select("symbol", *[F.col(f"{s}.{f}").alias(f"{n}_{f}") for s, n in (("a", "annual"), ("i", "interim"))
                                for f in ("period_end", "rev", "np", "rev_yoy", "np_yoy")],
                    F.round("pb_mrq", 2).alias("pb_mrq"), F.round("ps_lyr", 2).alias("ps_lyr"),
                    *[F.round(F.col(k).cast("double") / 1e8, 2).alias(f"{k}_yi") for k in ("fy1", "fy2", "fy3")])
