"""Decision points, settlement and decision statistics."""
from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.functions.columns import nonzero
from tapeloom.operators.timeops import asof

NOTIONAL = 100000.0
MAX_HOLD = 60
DECISION_WINDOW = 1
COOL_DOWN = 5
DEEP_EXIT = 0.05
SMALL_SAMPLE = 30


def with_ordinals(x: DataFrame, spine: DataFrame, day: str, name: str) -> DataFrame:
    """Open days before the day and up to it, by one equi-join on the date."""
    s = spine.select(F.col("day").alias(day), F.col("open_before").alias(f"{name}_before"),
                     (F.col("open_before") + F.col("is_open").cast("int")).alias(f"{name}_upto"), F.col("next_open").alias(f"{name}_next"))
    return x.join(s, day, "left")


def td_between(a: str = "a", b: str = "b") -> Column:
    """Open days from one day to another, both included; 0 when reversed."""
    return F.greatest(F.lit(0), F.col(f"{b}_upto") - F.col(f"{a}_before"))


# --------------------------------------------------------------------------- decision points

def entry_points(facts: DataFrame, cal: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Tier newly triggered, right side confirmed, falsification confirmed, and newly in the buy zone with a
    cool-down of more than five open days since the last point taken."""
    w = Window.partitionBy("symbol", "signal").orderBy("observed_on")
    prev = F.last("state", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = facts.where(F.col("signal").isin("tier_triggered", "right_side", "falsification_breach", "box_position")).withColumn("_p", prev)
    fresh = lambda sig, st: (F.col("signal") == sig) & (F.col("state") == st) & ~F.coalesce(F.col("_p") == st, F.lit(False))
    direct = x.where(fresh("tier_triggered", "triggered") | ((F.col("signal") == "right_side") & (F.col("state") == "confirmed"))
                     | ((F.col("signal") == "falsification_breach") & F.col("triggered")))
    direct = direct.select("symbol", F.col("observed_on").alias("decision_date"), F.col("signal").alias("source"))
    box = x.where(fresh("box_position", "buy_zone")).join(
        cal.select(F.col("trade_date").alias("observed_on"), "td_ord"), "observed_on")
    out = direct.unionByName(cool_down(box, decisions, cal))
    if decisions is not None:
        out = out.join(decisions.where("decision_type = 'entry'").select("symbol", "decision_date", F.col("signal_source").alias("source")),
                       ["symbol", "decision_date", "source"], "left_anti")
    return out


def cool_down(box: DataFrame, decisions: DataFrame | None, cal: DataFrame) -> DataFrame:
    """Greedy thinning of a symbol's buy-zone days (at most one per open day) as a fold over their ordinals."""
    g = box.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("td_ord", "observed_on"))).alias("c"))
    if decisions is None:
        g = g.withColumn("last", F.lit(None).cast("int"))
    else:
        d = decisions.where("signal_source = 'box_entry'").groupBy("symbol").agg(F.max("decision_date").alias("trade_date"))
        g = g.join(d.join(cal.select("trade_date", F.col("td_ord").cast("int").alias("last")), "trade_date").select("symbol", "last"), "symbol", "left")
    start = F.struct(F.col("last").alias("last"), F.array().cast("array<date>").alias("kept"))

    def take(acc, c):
        ok = acc["last"].isNull() | (c["td_ord"] - acc["last"] + 1 > COOL_DOWN)
        return F.struct(F.when(ok, c["td_ord"].cast("int")).otherwise(acc["last"]).alias("last"),
                        F.when(ok, F.concat(acc["kept"], F.array(c["observed_on"]))).otherwise(acc["kept"]).alias("kept"))
    return g.select("symbol", F.explode(F.aggregate("c", start, take)["kept"]).alias("decision_date"), F.lit("box_entry").alias("source"))


def _first_below(pdf: pd.DataFrame) -> pd.DataFrame:
    """One pass over days and entries in order; open entries wait in a heap, highest line first."""
    pdf = pdf.sort_values(["trade_date", "kind"])
    heap, out = [], []
    for day, kind, close, line, key in zip(pdf["trade_date"], pdf["kind"], pdf["close_raw"], pdf["line"], pdf["key"]):
        if kind == 0:
            while heap and close < -heap[0][0]:
                out.append((heapq.heappop(heap)[1], day))
        else:
            heapq.heappush(heap, (-line, key))
    res = pd.DataFrame(out, columns=["key", "deep_date"])
    res.insert(0, "symbol", pdf["symbol"].iloc[0])
    return res


def first_below(entries: DataFrame, bars: DataFrame, key: str, day: str, line: str) -> DataFrame:
    """First later day whose close is strictly below the entry's line. No pairs of entries and days are formed."""
    none = lambda t: F.lit(None).cast(t)
    a = bars.where("close_raw is not null").select("symbol", "trade_date", F.lit(0).alias("kind"), "close_raw", none("double").alias("line"), none("string").alias("key"))
    b = entries.select("symbol", F.col(day).alias("trade_date"), F.lit(1).alias("kind"), none("double").alias("close_raw"),
                       F.col(line).cast("double").alias("line"), F.col(key).cast("string").alias("key"))
    return a.unionByName(b).groupBy("symbol").applyInPandas(_first_below, "symbol string, key string, deep_date date")


def exit_points(positions: DataFrame, facts: DataFrame, bars: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """Exits offered to an open position: confirmed falsifications and stop-outs after entry, first close below the deep line.

    Exits in ``decided`` (symbol, decision_date, source) aren't offered again; a decided deep exit is not followed by a later one.
    """
    pos = positions.select("symbol", "position_id", "entry_date", "deep_exit_line")
    sig = facts.where(((F.col("signal") == "falsification_breach") & F.col("triggered")) | ((F.col("signal") == "right_side") & (F.col("state") == "stopped_out")))
    sig = sig.select("symbol", "observed_on", F.when(F.col("signal") == "right_side", "stopped_out").otherwise(F.col("signal")).alias("source"))
    hits = pos.join(sig, "symbol").where("observed_on > entry_date").select("symbol", "position_id", F.col("observed_on").alias("exit_date"), "source")
    deep = first_below(pos, bars, "position_id", "entry_date", "deep_exit_line").select(
        "symbol", F.col("key").alias("position_id"), F.col("deep_date").alias("exit_date"), F.lit("deep_exit").alias("source"))
    points = hits.unionByName(deep)
    return points if decided is None else points.join(decided.withColumnRenamed("decision_date", "exit_date"), ["symbol", "exit_date", "source"], "left_anti").select(points.columns)


def decision_fields(points: DataFrame, bar_cards: DataFrame, spine: DataFrame, now: str) -> DataFrame:
    """Late flag, round-lot quantity and deep line of each decision point."""
    x = points.join(bar_cards.select("symbol", F.col("trade_date").alias("decision_date"), "close_raw", "tiers"), ["symbol", "decision_date"], "left")
    x = with_ordinals(x, spine, "decision_date", "a")
    x = with_ordinals(x.withColumn("now", F.lit(now).cast("date")), spine, "now", "b")
    zone = F.array_max(F.filter(F.transform("tiers", lambda t: t["zone_low"].cast("double")), lambda v: v <= F.col("close_raw")))
    base = F.coalesce(F.when(F.col("source") == "tier_triggered", zone), F.col("close_raw"))
    lots = F.floor(F.floor(NOTIONAL / F.col("close_raw")) / 100)
    return x.select("symbol", "decision_date", "source", "close_raw", (td_between() > DECISION_WINDOW + 1).alias("late"),
                    (lots * 100).cast("long").alias("quantity"), F.round(base * (1.0 - DEEP_EXIT), 6).alias("deep_exit_line"))


# --------------------------------------------------------------------------- settlement

def settle(x: DataFrame, bars: DataFrame, spine: DataFrame) -> DataFrame:
    """Return over adjusted closes, profit and open days held; a missing factor counts as 1."""
    f = bars.select("symbol", "trade_date", "price_adj_factor")
    for side in ("entry", "exit"):
        x = x.join(f.select("symbol", F.col("trade_date").alias(f"{side}_date"), F.col("price_adj_factor").alias(f"_f_{side}")), ["symbol", f"{side}_date"], "left")
    ret = (F.col("exit_close") * nonzero("_f_exit")) / (F.col("entry_close") * nonzero("_f_entry")) - 1.0
    x = with_ordinals(with_ordinals(x, spine, "entry_date", "a"), spine, "exit_date", "b")
    drop = [c for c in x.columns if c.startswith(("_f_", "a_", "b_"))]
    return x.withColumns({"ret": ret, "hold_days": td_between()}).withColumn("pnl", NOTIONAL * F.col("ret")).drop(*drop)


def timeout_exits(positions: DataFrame, bars: DataFrame, cal: DataFrame, spine: DataFrame, now: str) -> DataFrame:
    """Positions held for 60 open days close on that day, or on the symbol's next traded day up to now."""
    x = with_ordinals(with_ordinals(positions.withColumn("now", F.lit(now).cast("date")), spine, "entry_date", "a"), spine, "now", "b")
    x = x.where(td_between() >= MAX_HOLD).withColumn("td_ord", F.col("a_before") + MAX_HOLD)
    x = x.join(cal.select("td_ord", F.col("trade_date").alias("target")), "td_ord")
    live = bars.where("close_raw is not null").select("symbol", "trade_date", "close_raw")
    x = asof(x, live, ["symbol"], "target", "trade_date", [F.col("trade_date").alias("exit_date"), F.col("close_raw").alias("exit_close")], backward=False)
    return x.where("exit_date <= now").select("symbol", "position_id", "entry_date", "target", "exit_date", "exit_close")


def baseline_exit(entries: DataFrame, facts: DataFrame, bars: DataFrame) -> DataFrame:
    """First later day with a confirmed falsification, a stop-out or a close below 95 % of the entry; else the last bar."""
    x = entries.withColumn("_line", F.col("entry_close") * (1.0 - DEEP_EXIT)).withColumn("_key", F.concat_ws("/", "symbol", F.col("entry_date").cast("string"), "source"))
    sig = facts.where(((F.col("signal") == "falsification_breach") & F.col("triggered")) | ((F.col("signal") == "right_side") & (F.col("state") == "stopped_out")))
    sig = sig.select("symbol", "observed_on").distinct()
    x = asof(x, sig, ["symbol"], "entry_date", "observed_on", [F.col("observed_on").alias("_sig")], strict=True, backward=False)
    deep = first_below(x, bars, "_key", "entry_date", "_line").select("symbol", F.col("key").alias("_key"), "deep_date")
    last = bars.groupBy("symbol").agg(F.max("trade_date").alias("_last"))
    x = x.join(deep, ["symbol", "_key"], "left").join(last, "symbol", "left")
    hit = F.least("_sig", "deep_date")
    x = x.withColumns({"exit_date": F.coalesce(hit, F.greatest("_last", "entry_date")), "exit_kind": F.when(hit.isNull(), "last_bar").when(
        F.col("_sig") == hit, "signal").otherwise("deep_exit")})
    close = bars.select("symbol", F.col("trade_date").alias("exit_date"), F.col("close_raw").alias("exit_close"))
    return x.join(close, ["symbol", "exit_date"], "left").drop("_line", "_key", "_sig", "deep_date", "_last")


def outcome_stats(settled: DataFrame, decisions: DataFrame, virtual: DataFrame, baseline: DataFrame, exclude_late: bool = False) -> DataFrame:
    """Followed, skipped and countered decisions against following everything; per symbol and, as '*', over all.

    ``settled``: followed positions with ret and is_open. ``virtual``: entry decisions with the return following
    would have had. Reversed decisions do not count; late ones can be left out of skip and counter only.
    """
    def both(df):
        return df.withColumn("symbol", F.explode(F.array(F.col("symbol"), F.lit("*"))))
    num = lambda cond: F.count(F.when(cond, 1))
    total = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), F.lit(0.0))
    f = both(settled).groupBy("symbol").agg(
        F.count("*").alias("follow_n"), num(F.col("ret") > 0).alias("follow_wins"), F.avg("ret").alias("follow_avg_ret"),
        F.sum(NOTIONAL * F.col("ret")).alias("follow_pnl"), num(F.col("is_open")).alias("open_n"))
    v = virtual.where("reversed_by is null and vret is not null")
    if exclude_late:
        v = v.where("not late")
    r, skip, counter = F.col("vret"), F.col("decision") == "skip", F.col("decision") == "counter"
    g = both(v.where(skip | counter)).groupBy("symbol").agg(
        num(skip).alias("skip_n"), num(skip & F.col("constraint_tag").isNotNull()).alias("skip_structural_n"),
        (total(skip & (r > 0), r) * NOTIONAL).alias("missed_profit"), (total(skip & (r <= 0), -r) * NOTIONAL).alias("avoided_loss"),
        num(counter).alias("counter_n"), num(counter & (r < 0)).alias("counter_correct_n"), (total(counter, r) * NOTIONAL).alias("counter_virtual_pnl"))
    b = both(baseline).groupBy("symbol").agg(F.count("*").alias("baseline_n"), F.sum(NOTIONAL * F.col("ret")).alias("baseline_pnl"),
                                             num(F.col("ret") > 0).alias("baseline_wins"))
    late = both(decisions).groupBy("symbol").agg(num(F.col("late")).alias("late_count"))
    x = late.join(f, "symbol", "full_outer").join(g, "symbol", "full_outer").join(b, "symbol", "full_outer")
    keep = {"follow_avg_ret"}
    x = x.na.fill(0, [c for c in x.columns if c not in keep and c != "symbol"])
    rate = lambda a, n: F.when(F.col(n) > 0, F.col(a) / F.col(n))
    return x.withColumns({
        "follow_winrate": rate("follow_wins", "follow_n"), "counter_correct_rate": rate("counter_correct_n", "counter_n"),
        "baseline_winrate": rate("baseline_wins", "baseline_n"), "skip_autonomous_n": F.col("skip_n") - F.col("skip_structural_n"),
        "judgement_diff": F.col("follow_pnl") - F.col("baseline_pnl"),
        "small_sample": F.col("follow_n") + F.col("skip_n") + F.col("counter_n") < SMALL_SAMPLE})


# --------------------------------------------------------------------------- executions

def net_reversals(executions: DataFrame) -> DataFrame:
    """Executions that stand: neither reversals nor reversed by one."""
    rev = executions.where("reverses_execution_id is not null").select(F.col("reverses_execution_id").alias("execution_id"))
    return executions.where("reverses_execution_id is null").join(rev, "execution_id", "left_anti")


def signal_snapshot(facts: DataFrame, anchors: DataFrame, as_of: str) -> DataFrame:
    """Latest fact of each signal up to the day, and the anchors last identified by then."""
    day = F.lit(as_of).cast("date")
    f = facts.where(F.col("observed_on") <= day).groupBy("symbol", "signal").agg(
        F.max_by(F.struct("observed_on", "state", "triggered"), F.struct("observed_on", "card_version_id")).alias("r"))
    f = f.select("symbol", "signal", "r.observed_on", "r.state", "r.triggered")
    seen = anchors.where(F.col("as_of") <= day)
    last = seen.groupBy("symbol").agg(F.max("as_of").alias("as_of"))
    a = seen.join(last, ["symbol", "as_of"]).select("symbol", F.concat(F.lit("anchor:"), "anchor_type").alias("signal"), F.col("trade_date").alias("observed_on"),
                                                   F.when(F.col("is_fallback"), "fallback").otherwise("panic").alias("state"), F.lit(False).alias("triggered"))
    return f.unionByName(a)


def dedup_key(x: DataFrame, order: str = "execution_id") -> DataFrame:
    """Derived idempotency key; the first row of each key stays."""
    raw = F.concat_ws("|", "symbol", "action_type", "price", "quantity", F.coalesce("tier", F.lit("")), F.coalesce("fees", F.lit("")), "executed_day")
    y = x.withColumn("idempotency_key", F.concat(F.lit("auto_"), F.substring(F.sha2(raw, 256), 1, 24)))
    rest = [c for c in y.columns if c != "idempotency_key"]
    return y.groupBy("idempotency_key").agg(F.min_by(F.struct(*rest), order).alias("r")).select("idempotency_key", "r.*")
