"""Read queries over the whole pool: lists, feeds, aligned series, counters, alerts."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.functions.columns import c, nonzero
from tapeloom.operators.daily_watch import box_state, tier_state
from tapeloom.session import cut_lineage

# fixed values: indicator columns on the price scale, which fold with the factor
PRICE_SCALE = ("ma5", "ma10", "ma20", "ma60", "ma120", "ma250", "boll_mid", "boll_upper", "boll_lower")


def paged(df: DataFrame, sort: str, ascending: bool, page: int, size: int, tie: str) -> DataFrame:
    """Sorted page; NULLs last when descending, first when ascending."""
    order = c(sort).asc_nulls_first() if ascending else c(sort).desc_nulls_last()
    return df.orderBy(order, c(tie).asc()).offset((page - 1) * size).limit(size)


def latest(df: DataFrame, keys, order, cols) -> DataFrame:
    """Newest row per key, as a mergeable aggregate."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(*keys, "_r.*")


def recent_counts(facts: DataFrame, bars: DataFrame, days: int) -> DataFrame:
    """Triggered facts since each symbol's n-th latest bar."""
    w = Window.partitionBy("symbol").orderBy(F.col("trade_date").desc())
    since = bars.select("symbol", "trade_date").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= days).groupBy("symbol").agg(
        F.min("trade_date").alias("_from"))
    return facts.where("triggered").join(since, "symbol").where("observed_on >= _from").groupBy("symbol").agg(F.count("*").alias("signal_count"))


def pe_kind(want: str) -> Column:
    s = F.col("pe_status")
    return {"ok": (s == "") | s.startswith("ok"), "degraded": F.contains(s, F.lit("degraded")),
            "missing": s.isNotNull() & (s != "") & ~s.startswith("ok") & ~F.contains(s, F.lit("degraded"))}.get(want, s == want)


def stock_list(pool: DataFrame, bars: DataFrame, ind: DataFrame, pe: DataFrame, cards: DataFrame, facts: DataFrame, runs: DataFrame,
               filters: dict | None = None, recent_days: int = 5) -> DataFrame:
    """One row per pool symbol: latest bar, indicator, PE, active card with tier and box state, recent signals, last run."""
    f = filters or {}
    bar = latest(bars, "symbol", "trade_date", ["trade_date", "close_raw", "volume_raw", "price_adj_factor"])
    x = pool.join(bar, "symbol", "left")
    x = x.join(ind.select("symbol", "trade_date", "pct_chg"), ["symbol", "trade_date"], "left")
    x = x.join(pe.select("symbol", "trade_date", "pe_ttm", F.col("pe_status_full").alias("pe_status")), ["symbol", "trade_date"], "left")
    card = latest(cards.where("status = 'active'"), "symbol", "card_version_id", [F.col("card_version_id").alias("active_card_id"), "tiers", "box"])
    x = x.join(card, "symbol", "left").join(recent_counts(facts, bars, recent_days), "symbol", "left")
    run = latest(runs.where("stage like 'symbol:%'").withColumn("symbol", F.substring("stage", 8, 1000)), "symbol", F.struct("started_at", "run_key"),
                 [F.col("status").alias("last_run_status")])
    x = x.join(run, "symbol", "left").withColumn("signal_count", F.coalesce("signal_count", F.lit(0).cast("long")))
    x = tier_state(x).withColumn("box_state", F.when(F.col("box").isNotNull() & F.col("close_raw").isNotNull(), box_state(F.col("close_raw").cast("decimal(28,10)"))))
    tests = {"market": lambda v: F.col("market").isin(v), "q": lambda v: search_test(v), "pe_min": lambda v: F.col("pe_ttm") >= v, "pe_max": lambda v: F.col("pe_ttm") <= v,
             "pct_chg_min": lambda v: F.col("pct_chg") >= v, "pct_chg_max": lambda v: F.col("pct_chg") <= v, "volume_min": lambda v: F.col("volume_raw") >= v,
             "volume_max": lambda v: F.col("volume_raw") <= v, "has_active_card": lambda v: F.col("active_card_id").isNotNull() == v,
             "pe_status": lambda v: reduce(lambda a, b: a | b, [pe_kind(k) for k in v]), "recent_signal": lambda v: (F.col("signal_count") > 0) == v}
    for k, v in f.items():
        x = x.where(tests[k](v))
    return x.drop("tiers", "box")


def search_test(text: str) -> Column:
    t = F.lit(text)
    return F.contains("symbol", t) | F.contains("name", t) | F.exists("aliases", lambda a: F.contains(a, t))


def search(pool: DataFrame, text: str, limit: int = 10) -> DataFrame:
    x = pool if not text else pool.where(search_test(text))
    return x.select("symbol", "market", "name").orderBy("symbol").limit(limit)


def latest_signals(facts: DataFrame) -> DataFrame:
    return latest(facts, ["symbol", "signal"], F.struct("observed_on", "card_version_id"), ["observed_on", "state", "triggered"])


def exhaustion_summary(weekly: DataFrame) -> DataFrame:
    """Active signals at each symbol's last completed week."""
    last = weekly.groupBy("symbol").agg(F.max("observed_on").alias("observed_on"))
    return weekly.join(last, ["symbol", "observed_on"]).groupBy("symbol", "observed_on").agg(
        F.count(F.when(F.col("state") == "active", 1)).alias("active"), F.count("*").alias("total"), F.max("anchor_id").alias("anchor_id"))


def stock_overview(pool: DataFrame, bars: DataFrame, ind: DataFrame, pe: DataFrame, cards: DataFrame, facts: DataFrame, panel: DataFrame) -> DataFrame:
    """Head of the stock page: key figures, card state and the newest state of each signal as a map."""
    none = pool.select(F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("long").alias("run_key"))
    x = stock_list(pool, bars, ind, pe, cards, facts, none).drop("last_run_status")
    sig = latest_signals(facts).groupBy("symbol").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "state")))).alias("signals"))
    card_only = F.map_filter("signals", lambda k, v: F.col("active_card_id").isNotNull() | ~k.isin("tier_proximity", "tier_triggered", "falsification_breach", "box_position", "right_side"))
    return x.join(sig, "symbol", "left").withColumn("signals", card_only).join(panel, "symbol", "left")


def signal_events(facts: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Per symbol the newest facts that triggered or changed state, with how many there are."""
    w = Window.partitionBy("symbol", "signal").orderBy("observed_on")
    ev = facts.withColumn("_p", F.lag("state").over(w)).where(F.col("triggered") | ~F.col("_p").eqNullSafe(F.col("state"))).drop("_p")
    total = ev.groupBy("symbol").agg(F.count("*").alias("total"))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("observed_on").desc(), F.col("signal").desc()))
    top = ev.withColumn("rank", rank).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    return top.join(total, "symbol")


def bars_view(bars: DataFrame, mode: str = "unadjusted", start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily bars, raw or fully adjusted. Unknown prices stay NULL in both."""
    x = between(bars, "trade_date", start, end)
    if mode != "fully_adjusted":
        return x.select("symbol", "trade_date", *[F.col(f"{k}_raw").alias(k) for k in ("open", "high", "low", "close", "volume", "amount")])
    f = nonzero("price_adj_factor")
    return x.select("symbol", "trade_date", *[(F.col(f"{k}_raw") * f).alias(k) for k in ("open", "high", "low", "close")],
                    (F.col("volume_raw") / nonzero("share_factor")).alias("volume"), F.col("amount_raw").alias("amount"))


def between(df: DataFrame, day: str, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(day) >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col(day) <= F.lit(end).cast("date"))


def indicators_view(ind: DataFrame, bars: DataFrame, fields, mode: str = "unadjusted", day: str = "trade_date", start=None, end=None) -> DataFrame:
    """Chosen indicators; those on the price scale fold by the day's factor unless the adjusted scale is asked for."""
    unknown = [f for f in fields if f not in ind.columns]
    if unknown:
        raise ValueError(f"unknown indicator fields: {unknown}")
    x = between(ind.select("symbol", day, *fields), day, start, end)
    if mode == "fully_adjusted":
        return x
    f = bars.select("symbol", F.col("trade_date").alias(day), nonzero("price_adj_factor").alias("_f"))
    x = x.join(f, ["symbol", day], "left")
    return x.select("symbol", day, *[(F.col(k) / F.coalesce("_f", F.lit(1.0))).alias(k) if k in PRICE_SCALE else F.col(k) for k in fields])


def align(ind: DataFrame, fields, symbols, day: str = "trade_date") -> DataFrame:
    """Fields of several symbols side by side: one row per field and day, one column per symbol."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("double").alias("value")) for k in fields]))
    x = ind.where(F.col("symbol").isin(list(symbols))).select("symbol", day, cells.alias("f")).select("symbol", day, "f.*").where("value is not null")
    return x.groupBy("field", day).pivot("symbol", list(symbols)).agg(F.first("value"))


def compare(df: DataFrame, symbols, metric: str, day: str = "trade_date", spine: str = "first") -> DataFrame:
    """One metric of several symbols on the first symbol's days (bars) or on all their days (indicators)."""
    wide = align(df, [metric], symbols, day).drop("field")
    if spine != "first":
        return wide
    days = df.where(F.col("symbol") == symbols[0]).select(day).distinct()
    return days.join(wide, day, "left")


def signal_list(facts: DataFrame, anchors: DataFrame, filters: dict | None = None) -> DataFrame:
    """Facts under filters with their anchor."""
    f = filters or {}
    tests = {"symbols": lambda v: F.col("symbol").isin(v), "signals": lambda v: F.col("signal").isin(v), "states": lambda v: F.col("state").isin(v),
             "triggered": lambda v: F.col("triggered") == v, "start": lambda v: F.col("observed_on") >= v, "end": lambda v: F.col("observed_on") <= v,
             "anchor_id": lambda v: F.col("anchor_id") == v}
    x = facts
    for k, v in f.items():
        x = x.where(tests[k](v))
    a = anchors.select("anchor_id", F.col("trade_date").alias("anchor_date"), F.col("adjusted_price").alias("anchor_price"))
    return x.join(a, "anchor_id", "left")


def card_list(cards: DataFrame, pool: DataFrame, symbol=None, status=None, start=None, end=None) -> DataFrame:
    """Cards whose window meets [start, end]; drafts without a window only appear without that filter."""
    x = cards
    if symbol is not None:
        x = x.where(F.col("symbol") == symbol)
    if status is not None:
        x = x.where(F.col("status").isin(status))
    if start is not None or end is not None:
        x = x.where("effective_from is not null")
    if start is not None:
        x = x.where(F.col("effective_to").isNull() | (F.col("effective_to") >= start))
    if end is not None:
        x = x.where(F.col("effective_from") <= end)
    return x.join(pool.select("symbol", "name"), "symbol", "left")


def card_chain(cards: DataFrame) -> DataFrame:
    """Chain of versions each card supersedes, newest first, of any length; a cycle ends the walk, an unknown version ends its chain.

    Each round doubles the known part of all chains, so a chain of n versions takes log2(n) joins. The result holds the chain of
    every card given; for the history of one symbol pass its cards only.
    """
    walk = cards.select("card_version_id", F.array("card_version_id").alias("chain"), F.col("supersedes_id").alias("nxt"))
    while True:
        walk = cut_lineage(walk)
        if walk.where("nxt is not null").isEmpty():
            return walk.select("card_version_id", "chain")
        on = walk.select(F.col("card_version_id").alias("nxt"), F.col("chain").alias("more"), F.col("nxt").alias("then"))
        longer = F.when(F.col("nxt").isNull(), F.col("chain")).otherwise(F.concat("chain", F.coalesce("more", F.array("nxt"))))
        x = walk.join(on, "nxt", "left").select("card_version_id", longer.alias("chain"), "then")
        once = F.array_distinct("chain")  # a walk round a cycle repeats what it has passed
        walk = x.select("card_version_id", once.alias("chain"), F.when(F.size(once) == F.size("chain"), F.col("then")).alias("nxt"))


def executions_between(x: DataFrame, start: str, end: str, symbol: str | None = None) -> DataFrame:
    """Executions from the first day up to the end of the last."""
    y = x.where((F.col("executed_at") >= F.lit(start).cast("timestamp")) & (F.col("executed_at") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")))
    return y if symbol is None else y.where(F.col("symbol") == symbol)


def run_list(runs: DataFrame, run_id=None, stage=None, status=None, start=None, end=None) -> DataFrame:
    x = runs
    if run_id is not None:
        x = x.where(F.contains("run_id", F.lit(run_id)))
    if stage is not None:
        x = x.where(F.contains("stage", F.lit(stage)))
    if status is not None:
        x = x.where(F.col("status").isin(status))
    if start is not None:
        x = x.where(F.col("started_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        x = x.where(F.col("started_at") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    return x.withColumn("duration_sec", F.round(F.col("finished_at").cast("double") - F.col("started_at").cast("double"), 2))


def lookups(cal: DataFrame, index: DataFrame, cards: DataFrame, pool: DataFrame, runs: DataFrame, start: str, end: str) -> DataFrame:
    """Trading dates of a range, latest trading date, benchmark closes, and the distinct lists, as (kind, key, value) rows."""
    row = lambda df, kind, key, val: df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), val.cast("double").alias("value"))
    none = F.lit(None)
    return reduce(DataFrame.unionByName, [
        row(between(cal.where("is_open"), "trade_date", start, end), "trading_date", F.col("trade_date"), none),
        row(cal.where("is_open").groupBy("market").agg(F.max("trade_date").alias("d")), "latest_date", F.concat_ws(":", "market", F.col("d").cast("string")), none),
        row(between(index, "trade_date", start, end), "benchmark", F.col("trade_date"), F.round("close", 4)),
        row(cards.select("status").distinct(), "card_status", F.col("status"), none), row(pool.select("market").distinct(), "market", F.col("market"), none),
        row(runs.groupBy("run_id").agg(F.max("started_at").alias("t")), "run", F.col("run_id"), none)])


def dashboard(pool: DataFrame, bars: DataFrame, cards: DataFrame, facts: DataFrame, runs: DataFrame) -> DataFrame:
    """Counters of the home page as (name, value) rows. Each is one aggregate; "today" is the newest day of its table."""
    today = bars.agg(F.max("trade_date")).scalar()
    last_sig = facts.where("triggered").agg(F.max("observed_on")).scalar()
    n = lambda df, name, e: df.agg(e.cast("long").alias("value")).select(F.lit(name).alias("name"), "value")
    stats = runs.where(F.col("status").isin("success", "degraded", "failed", "running")).groupBy("status").agg(F.count("*").alias("value")).select(
        F.concat(F.lit("runs_"), "status").alias("name"), "value")
    return reduce(DataFrame.unionByName, [
        n(pool, "total_stocks", F.count("*")), n(bars.where(F.col("trade_date") == today), "stocks_with_data_today", F.countDistinct("symbol")),
        n(cards.where("status = 'active'"), "stocks_with_active_card", F.countDistinct("symbol")),
        n(facts.where(F.col("triggered") & (F.col("observed_on") == last_sig)), "stocks_with_signal_today", F.countDistinct("symbol")), stats])


def alerts(runs: DataFrame, facts: DataFrame, pe: DataFrame, bars: DataFrame, cards: DataFrame, due: DataFrame, as_of: str, limit: int = 20) -> DataFrame:
    """Bad runs and incomplete signals (newest ones), PE status and suspension at the latest day, reviews due, calendar items."""
    none = F.lit(None).cast("string")
    bad = runs.where(F.col("status").isin("failed", "degraded")).orderBy(F.col("started_at").desc(), F.col("run_key").desc()).limit(limit).select(
        F.when(F.startswith("stage", F.lit("symbol:")), F.substring("stage", 8, 1000)).alias("symbol"), F.concat(F.lit("run_"), "status").alias("type"), F.coalesce("error", "stage").alias("message"))
    inc = facts.where("state = 'incomplete'").orderBy(F.col("observed_on").desc(), "symbol", "signal").limit(limit).select(
        "symbol", F.lit("signal_incomplete").alias("type"), F.concat_ws(" ", "signal", F.col("observed_on").cast("string")).alias("message"))
    p = latest(pe.where("pe_status_full is not null"), "symbol", "trade_date", ["pe_status_full"]).where("pe_status_full <> ''").select(
        "symbol", F.lit("pe_status").alias("type"), F.col("pe_status_full").alias("message"))
    sus = latest(bars, "symbol", "trade_date", ["trade_date", "trading_status"]).where("trading_status = 'suspended'").select("symbol", F.lit("suspended").alias("type"), F.col("trade_date").cast("string").alias("message"))
    rev = cards.where((F.col("status") == "active") & (F.col("next_review_at") <= F.lit(as_of).cast("date"))).select("symbol", F.lit("review_due").alias("type"), F.col("next_review_at").cast("string").alias("message"))
    cal = due.where("kind <> 'card_review'").select("symbol", F.lit("calendar").alias("type"), F.coalesce("note", "kind").alias("message"))
    return reduce(DataFrame.unionByName, [bad, inc, p, sus, rev, cal]).withColumn("symbol", F.coalesce("symbol", none))


def run_trend(runs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Runs per day and status over the last n days, zero-filled."""
    known = ("success", "degraded", "failed")
    x = runs.select(F.to_date("started_at").alias("day"), F.when(F.col("status").isin(*known), F.col("status")).otherwise("other").alias("s"))
    x = x.where((F.col("day") > F.date_sub(F.lit(as_of).cast("date"), days)) & (F.col("day") <= F.lit(as_of).cast("date")))
    wide = x.groupBy("day").pivot("s", [*known, "other"]).agg(F.count(F.lit(1)))
    spine = runs.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(as_of).cast("date"), days - 1), F.lit(as_of).cast("date"))).alias("day"))
    return spine.join(wide, "day", "left").na.fill(0)
