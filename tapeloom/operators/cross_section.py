"""Cross-section factors, scores, target weights and timing flags."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tapeloom.functions.columns import series, trailing, week_of
from tapeloom.operators.timeops import asof
from tapeloom.params import WEEKLY_SIGNALS

# fixed values: weights of the factors in the score
WEIGHTS = {"momentum": 0.5, "volatility": -0.3, "liquidity": 0.2}
WINDOW = 20
WINSOR = 0.05
MIN_NAMES = 3
CASH_BUFFER = 0.05
TOP_N = 5


def symbol_factors(adj: DataFrame) -> DataFrame:
    """20-row return, deviation of 20 daily returns, 20-row mean amount without gaps."""
    w = series("symbol")
    x = adj.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1)
    return x.select("symbol", "trade_date", (F.col("close") / F.lag("close", WINDOW).over(w) - 1).alias("momentum"),
                    trailing(F.stddev_pop, "_r", w, WINDOW).alias("volatility"), trailing(F.avg, "amount", w, WINDOW).alias("liquidity"))


def factor_scores(factors: DataFrame) -> DataFrame:
    """Daily score: winsorised, centred on the clipped mean, over the deviation of the unclipped factor.

    A factor with fewer than three names or no spread adds nothing that day; a day without any factor has no score.
    """
    full = factors.where("momentum is not null and volatility is not null and liquidity is not null")
    aggs = [F.count("*").alias("n")]
    for k in WEIGHTS:
        aggs += [F.percentile(k, F.array(F.lit(WINSOR), F.lit(1 - WINSOR))).alias(f"q_{k}"), F.stddev_pop(k).alias(f"s_{k}")]
    x = full.join(full.groupBy("trade_date").agg(*aggs), "trade_date")
    x = x.withColumns({f"c_{k}": F.least(F.greatest(F.col(k), F.col(f"q_{k}")[0]), F.col(f"q_{k}")[1]) for k in WEIGHTS})
    x = x.join(x.groupBy("trade_date").agg(*[F.avg(f"c_{k}").alias(f"m_{k}") for k in WEIGHTS]), "trade_date")
    on = {k: (F.col("n") >= MIN_NAMES) & (F.col(f"s_{k}") > 0) for k in WEIGHTS}
    total = sum((F.when(on[k], w * ((F.col(f"c_{k}") - F.col(f"m_{k}")) / F.col(f"s_{k}"))).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    neutral = sum((F.when(on[k], 0).otherwise(1) for k in WEIGHTS), F.lit(0))
    return x.select("symbol", "trade_date", F.when(neutral < len(WEIGHTS), total).alias("score"), neutral.cast("int").alias("neutral_factors"))


def score_coverage(factors: DataFrame, scores: DataFrame) -> DataFrame:
    """Per symbol: days, scored days, first and last scored day; symbols without a score stay."""
    days = factors.groupBy("symbol").agg(F.count("*").alias("days"))
    hit = scores.where("score is not null").groupBy("symbol").agg(
        F.count("*").alias("scored_days"), F.min("trade_date").alias("first_score"), F.max("trade_date").alias("last_score"))
    return days.join(hit, "symbol", "left").withColumn("scored_days", F.coalesce("scored_days", F.lit(0).cast("long")))


def score_asof(days: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of the last scored day strictly before each day."""
    scored = scores.where("score is not null")
    dates = scored.select(F.lit(1).alias("_k"), F.col("trade_date").alias("score_date")).distinct()
    x = asof(days.select(F.lit(1).alias("_k"), "as_of").distinct(), dates, ["_k"], "as_of", "score_date", ["score_date"], strict=True, unique=True)
    return x.where("score_date is not null").join(scored.withColumnRenamed("trade_date", "score_date"), "score_date").select(
        "as_of", "score_date", "symbol", "score")


def rebalance_days(bars: DataFrame) -> DataFrame:
    """First day with any bar of each ISO week."""
    return bars.groupBy(week_of("trade_date").alias("wk")).agg(F.min("trade_date").alias("as_of")).select("as_of")


def _top(x: DataFrame, by: str, n: int) -> DataFrame:
    w = Window.partitionBy("as_of")
    y = x.withColumn("rank", F.row_number().over(w.orderBy(F.col(by).desc(), "symbol"))).where(F.col("rank") <= n)
    return y.withColumn("weight", (1.0 - CASH_BUFFER) / F.count("*").over(w))


def topn_weights(bars: DataFrame, scores: DataFrame, n: int = TOP_N) -> DataFrame:
    """Weekly equal weights of the n best scores of the day before, less the cash buffer."""
    return _top(score_asof(rebalance_days(bars), scores), "score", n).select("as_of", "symbol", "rank", "weight")


def momentum_topn(adj: DataFrame, lookback: int = WINDOW, n: int = TOP_N) -> DataFrame:
    """Weekly equal weights of the n best returns over the last ``lookback`` closes of each symbol."""
    base = F.lag("close", lookback - 1).over(series("symbol"))
    mom = adj.withColumn("_b", base).where("_b > 0").select("symbol", "trade_date", (F.col("close") / F.col("_b") - 1).alias("score"))
    every = rebalance_days(adj).agg(F.array_sort(F.collect_list("as_of"))).scalar()  # one day per week
    grid = adj.groupBy("symbol").agg(F.min("trade_date").alias("_lo")).select("symbol", "_lo", F.explode(every).alias("as_of")).where("as_of >= _lo")
    x = asof(grid.drop("_lo"), mom, ["symbol"], "as_of", "trade_date", ["score"], unique=True).where("score is not null")
    return _top(x, "score", n).select("as_of", "symbol", "rank", "weight")


def dual_ma_signal(adj: DataFrame, short: int = 5, long: int = 20, target: float = 0.95) -> DataFrame:
    """Target position: in while the short mean was last above the long one, out once below; equal keeps it."""
    w = series("symbol")
    x = adj.withColumns({"short_ma": trailing(F.avg, "close", w, short), "long_ma": trailing(F.avg, "close", w, long)})
    want = F.when(F.col("long_ma").isNotNull(), F.when(F.col("short_ma") > F.col("long_ma"), target).when(F.col("short_ma") < F.col("long_ma"), 0.0))
    pos = F.coalesce(F.last(want, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    x = x.withColumn("position", pos)
    before = F.coalesce(F.lag("position").over(w), F.lit(0.0))
    return x.select("symbol", "trade_date", "position", F.when(F.col("position") > before, "enter").when(F.col("position") < before, "exit").alias("action"))


def eligible_universe(pool: DataFrame, bars: DataFrame, min_bars: int) -> DataFrame:
    """Symbols with enough bars; the others with the reason they are left out."""
    x = pool.select("symbol").distinct().join(bars.groupBy("symbol").agg(F.count("*").alias("bars")), "symbol", "left")
    return x.select("symbol", F.coalesce("bars", F.lit(0).cast("long")).alias("bars"), F.coalesce(F.col("bars") >= min_bars, F.lit(False)).alias("eligible"),
                    F.when(F.col("bars").isNull(), "no_data").when(F.col("bars") < min_bars, "too_few_bars").alias("reason"))


def period_return(index: DataFrame, start: str, end: str) -> DataFrame:
    """Percent return from the first to the last close of the period; fewer than two rows give NULL."""
    x = index.where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).groupBy("index_code").agg(
        F.count("*").alias("n"), F.min_by("close", "trade_date").alias("first_close"), F.max_by("close", "trade_date").alias("last_close"))
    ok = (F.col("n") >= 2) & (F.col("first_close") != 0)
    return x.select("index_code", "n", F.when(ok, (F.col("last_close") / F.col("first_close") - 1.0) * 100.0).alias("return_pct"))


def weekly_counts(facts: DataFrame) -> DataFrame:
    """Largest number of active exhaustion signals of one anchor per week; the smaller id on ties."""
    g = facts.where(F.col("signal").isin(*WEEKLY_SIGNALS) & F.col("anchor_id").isNotNull()).groupBy("symbol", "observed_on", "anchor_id").agg(
        F.count(F.when(F.col("state") == "active", 1)).alias("n_active"))
    best = F.min_by(F.struct("anchor_id", "n_active"), F.struct(-F.col("n_active"), F.col("anchor_id"))).alias("b")
    return g.groupBy("symbol", "observed_on").agg(best).select("symbol", F.col("observed_on").alias("week_end_date"), "b.*")


def stop_lines(anchors: DataFrame, bars: DataFrame, stop_pct: float) -> DataFrame:
    """Stop line of each real decline start; no line where that day's factor is unknown."""
    x = anchors.where("anchor_type = 'decline_start' and not is_fallback").join(
        bars.select("symbol", "trade_date", "price_adj_factor"), ["symbol", "trade_date"], "left")
    return x.select("symbol", "trade_date", "adjusted_price", F.when(F.col("price_adj_factor").isNotNull(), F.round(F.col("adjusted_price") * (1 - stop_pct), 6)).alias("stop_adj"))


def _timing(min_signals: int, discount: float):
    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trade_date", ignore_index=True)
        held, used, before, out = False, None, -1, []
        for b in pdf.itertuples(index=False):
            flag = None
            if held:
                if not pd.isna(b.stop) and b.close <= b.stop:
                    flag, held, used = "exit_stop", False, None
                elif before != b.anchor_no and b.anchor_no > used:
                    flag, held, used = "exit_new_anchor", False, None
            else:
                cheap = discount <= 0 or (not pd.isna(b.ref) and b.close <= b.ref * (1 - discount))
                if not pd.isna(b.n_active) and b.n_active >= min_signals and cheap and b.anchor_no != used:
                    flag, held, used = "enter", True, b.anchor_no
            before = b.anchor_no
            out.append((b.symbol, b.trade_date, flag))
        return pd.DataFrame(out, columns=["symbol", "trade_date", "flag"]).dropna(subset=["flag"])
    return scan


def exhaustion_flags(adj: DataFrame, counts: DataFrame, lines: DataFrame, min_signals: int = 2, discount: float = 0.0) -> DataFrame:
    """Entry when the last completed week has enough active signals and the anchor is unused; exit at the stop line
    or once a newer anchor appears. Counts, anchor number, stop and reference are as-of columns; only holding is state."""
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumns({"anchor_no": F.row_number().over(Window.partitionBy("symbol").orderBy("trade_date")) - 1,
                              "stop": F.last("stop_adj", True).over(w)})
    x = adj.select("symbol", "trade_date", "close")
    x = asof(x, counts, ["symbol"], "trade_date", "week_end_date", ["n_active"], unique=True)
    x = asof(x, rows.withColumnRenamed("trade_date", "_d"), ["symbol"], "trade_date", "_d", ["anchor_no", "stop", F.col("adjusted_price").alias("ref")], unique=True)
    x = x.withColumn("anchor_no", F.coalesce("anchor_no", F.lit(-1)))
    return x.groupBy("symbol").applyInPandas(_timing(min_signals, discount), "symbol string, trade_date date, flag string")
