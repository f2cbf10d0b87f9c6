"""Rows behind the daily report and the card-input documents."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tapeloom.functions.columns import full, series
from tapeloom.operators.reads import latest
from tapeloom.params import DRYUP_RATIO, DRYUP_WEEKS, PANIC_VOLUME

FOLLOW_UP_DAYS = 10


def followups(facts: DataFrame, executions: DataFrame, as_of: str, days: int = FOLLOW_UP_DAYS) -> DataFrame:
    """Right-side confirmations and stops of the last days that no execution of the symbol follows.

    "No execution on or after" only needs the last execution day of a symbol, so nothing is paired.
    """
    day = F.lit(as_of).cast("date")
    hit = facts.where((F.col("signal") == "right_side") & F.col("state").isin("confirmed", "stopped_out") & F.col("observed_on").between(F.date_sub(day, days), day))
    last = executions.groupBy("symbol").agg(F.to_date(F.max("executed_at")).alias("_last"))
    return hit.select("symbol", "observed_on", "state").distinct().join(last, "symbol", "left").where("_last is null or _last < observed_on").drop("_last")


def state_of_day(pool: DataFrame, gate: DataFrame, facts: DataFrame, prox: DataFrame, card: DataFrame, freezes: DataFrame, drafts: DataFrame,
                 follow: DataFrame, as_of: str) -> DataFrame:
    """One row per symbol with everything priority and decision points look at. Facts are the latest up to the day."""
    day = F.lit(as_of).cast("date")
    f = facts.where(F.col("observed_on") <= day)
    pick = lambda s: F.max_by(F.when(F.col("signal") == s, F.struct("observed_on", "state", "triggered")), F.when(F.col("signal") == s, F.col("observed_on"))).alias(s)
    sig = f.groupBy("symbol").agg(*[pick(s) for s in ("tier_triggered", "falsification_breach", "box_position", "right_side")])
    p = latest(prox.where(F.col("trade_date") <= day), "symbol", "trade_date", [F.col("trade_date").alias("prox_on"), "prox_state", "min_dist"])
    n = lambda df, name: df.groupBy("symbol").agg(F.count("*").alias(name))
    x = pool.select("symbol").join(gate.select("symbol", "status").withColumnRenamed("status", "gate"), "symbol", "left")
    x = x.join(sig, "symbol", "left").join(p, "symbol", "left").join(card.select("symbol", "card_version_id", "next_review_at"), "symbol", "left")
    for df, name in ((freezes, "n_freeze"), (drafts, "n_draft"), (follow, "n_follow")):
        x = x.join(n(df, name), "symbol", "left")
    x = x.na.fill(0, ["n_freeze", "n_draft", "n_follow"]).withColumn("day", day)
    now = lambda s: F.coalesce(F.col(f"{s}.observed_on") == F.col("day"), F.lit(False))
    st = lambda s, *v: F.coalesce(F.col(f"{s}.state").isin(*v), F.lit(False))
    trig = lambda s: F.coalesce(F.col(f"{s}.triggered"), F.lit(False))
    return x.withColumns({
        "overdue": F.coalesce(F.col("next_review_at") < F.col("day"), F.lit(False)), "broken": st("falsification_breach", "active"),
        "tier_now": now("tier_triggered") & trig("tier_triggered"), "tier_wait": now("tier_triggered") & st("tier_triggered", "pending_signals"),
        "right_now": F.when(now("right_side"), F.col("right_side.state")), "box_now": F.when(now("box_position") & trig("box_position"), F.col("box_position.state")),
        "near_now": F.coalesce((F.col("prox_on") == F.col("day")) & (F.col("prox_state") == "active"), F.lit(False))})


def report_priority(x: DataFrame) -> DataFrame:
    """Status and one of five priorities; within one, closest to a bound first, then by symbol."""
    yes = lambda col: F.coalesce(col, F.lit(False))
    bad = F.col("gate").isin("incomplete", "source_missing", "suspended")
    status = (F.when(F.col("gate") == "incomplete", "incomplete").when(bad | (F.col("card_version_id").isNull() & (F.col("gate") == "trading_with_bars")), "degraded").otherwise("complete"))
    two = (F.col("n_freeze") > 0) | (F.col("n_draft") > 0) | F.col("broken") | F.col("overdue") | yes(F.col("right_now") == "stopped_out")
    three = F.col("tier_now") | yes(F.col("right_now").isin("confirmed", "invalidated")) | F.col("box_now").isNotNull()
    prio = F.when(bad, 1).when(two, 2).when(three, 3).when(F.col("near_now") | (F.col("n_follow") > 0), 4).otherwise(5)
    return x.select("symbol", status.alias("status"), prio.alias("priority"), F.col("min_dist").alias("distance"), "card_version_id").orderBy(
        "priority", F.col("distance").asc_nulls_last(), "symbol")


def decision_points(x: DataFrame) -> DataFrame:
    """What needs a decision, one row per symbol and kind."""
    k = lambda cond, kind: F.when(cond, F.lit(kind))
    right = F.col("right_now")
    kinds = F.array_compact(F.array(
        k(F.col("n_freeze") > 0, "frozen"), k(F.col("n_draft") > 0, "draft_pending"), k(F.col("overdue"), "review_overdue"), k(F.col("broken"), "falsified"),
        k(F.col("tier_now"), "tier_triggered"), k(F.col("tier_wait"), "tier_pending"),
        F.when(right.isin("confirmed", "invalidated", "expired", "stopped_out", "holding"), F.concat(F.lit("right_side_"), right)),
        F.when(F.col("box_now").isNotNull(), F.concat(F.lit("box_"), "box_now")), k(F.col("n_follow") > 0, "follow_up")))
    return x.select("symbol", F.explode(kinds).alias("kind"))


def draft_queue(versions: DataFrame) -> DataFrame:
    return versions.where("status = 'draft' and ca_id is not null").groupBy("symbol").agg(F.count("*").alias("drafts"), F.min("ca_id").alias("first_ca"))


def study_counts(study: DataFrame) -> DataFrame:
    pend = (F.coalesce(F.col("t1_mark"), F.lit("")) == "pending") | (F.coalesce(F.col("t5_mark"), F.lit("")) == "pending")
    return study.groupBy("symbol", "status").agg(F.count("*").alias("n"), F.count(F.when(pend, 1)).alias("pending"))


def next_revision(wanted: DataFrame, report_runs: DataFrame) -> DataFrame:
    """Next report revision per type, symbol (NULL for the pool) and day."""
    k = ["report_type", "symbol", "trade_date"]
    have = report_runs.groupBy(*k).agg(F.max("revision").alias("_r"))
    w, h = wanted.alias("w"), have.alias("h")
    on = reduce(lambda a, b: a & b, [F.col(f"w.{c}").eqNullSafe(F.col(f"h.{c}")) for c in k])
    return w.join(h, on, "left").select("w.*", (F.coalesce("_r", F.lit(0)) + 1).alias("revision"))


def exhaustion_params(anchors: DataFrame, weeks: DataFrame) -> DataFrame:
    """Base volume after the latest decline start and the volume thresholds drawn from it."""
    last = anchors.groupBy("symbol").agg(F.max("as_of").alias("as_of"))
    cur = anchors.join(last, ["symbol", "as_of"])
    pick = lambda t, col: F.max(F.when(F.col("anchor_type") == t, F.col(col)))
    a = cur.groupBy("symbol", "as_of").agg(pick("panic_low", "raw_price").alias("prev_low_raw"), pick("decline_start", "trade_date").alias("decline_week"))
    w = series("symbol", order="week_end_date")
    base = weeks.withColumn("mean_volume", full(F.avg, "volume", w, 1, DRYUP_WEEKS, DRYUP_WEEKS)).select("symbol", F.col("week_end_date").alias("decline_week"), "mean_volume", F.lit(True).alias("_w"))
    x = a.join(base, ["symbol", "decline_week"], "left")
    note = F.when(F.col("decline_week").isNull(), "no_decline_start").when(F.col("_w").isNull(), "week_missing").when(F.col("mean_volume").isNull(), "too_few_weeks").otherwise("ok")
    times = {"panic_volume_x2": PANIC_VOLUME, "dryup_040": 0.40, "dryup_050": DRYUP_RATIO, "dryup_060": 0.60}
    return x.select("symbol", "as_of", "prev_low_raw", "decline_week", "mean_volume", *[(F.col("mean_volume") * k).alias(n) for n, k in times.items()], note.alias("note"))


def card_inputs(sections: dict[str, DataFrame]) -> DataFrame:
    """One document per symbol with a JSON object per section; the pool comes first and keeps every symbol."""
    names = list(sections)
    out = None
    for name, df in sections.items():
        cols = [c for c in df.columns if c != "symbol"]
        part = df.select("symbol", F.struct(*cols).alias(name))
        out = part if out is None else out.join(part, "symbol", "left")
    return out.select("symbol", F.to_json(F.struct(*names)).alias("document"))


def write_documents(docs: DataFrame, path: str) -> None:
    """JSON lines, one folder per symbol."""
    docs.write.mode("overwrite").partitionBy("symbol").text(path)


def run_summary(runs: DataFrame) -> DataFrame:
    """Runs per day with the worst status and the counts of each."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    x = runs.groupBy(F.to_date("started_at").alias("day")).agg(n("success"), n("degraded"), n("failed"), n("running"))
    return x.withColumn("overall", F.when(F.col("failed") > 0, "failed").when(F.col("degraded") > 0, "degraded").otherwise("success"))
