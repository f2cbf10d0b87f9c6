"""Announcement screen, score table and scenario schedule, as column expressions over tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: keyword groups, loss words, growth patterns
KEYWORD_GROUPS = {
    "供不应求": "供不应求|供应短缺|供给短缺|供货紧张|产能不足",
    "需求旺盛": "需求旺盛|需求强劲|需求持续旺盛",
    "高景气": "景气度|高景气|景气上行|景气度回升|景气度提升",
    "供给偏紧": "供给偏紧|供应偏紧|供需偏紧|供应紧张|供给紧张|供应缺口|供需格局.{0,6}改善|供需格局.{0,6}优化",
    "价格上涨/中枢": "价格中枢|价格上涨|价格上行|价格攀升|价格走高|提价|涨价|价格快速上涨|价格维持高位|量价齐升",
    "满产/满销": "满产|满销|产能利用率.{0,4}(满|高)|产销两旺",
    "超预期": "超预期",
    "订单充足": "订单充足|订单饱满|订单充裕|订单充沛|在手订单|手持订单|订单.{0,6}大幅增长|订单放量",
}
LOSS_WORDS = "预亏|业绩预降|首亏|续亏|扭盈为亏"
TURN_WORDS = "扭亏为盈|实现扭亏|预盈"
GROWTH_PATTERNS = (
    r"(?:同比)?(?:增长|上升|增幅|增加|变动比例区间为?|上升幅度区间为?)[^\d]{0,12}([\d,.]+)%\s*[\-—–~至到]\s*([\d,.]+)%",
    r"增长\s*([\d,.]+)%\s*[\-—–~]\s*([\d,.]+)%",
    r"同比(?:增长|上升|增幅)[^\d]{0,12}([\d,.]+)%",
)
PROFIT_WORD = "净利润"
BEFORE, AFTER = 60, 200


def normalise(col: Column) -> Column:
    return F.translate(col, "－—–~：％", "----:%")


def growth_in(win: Column) -> Column:
    """(low, high) of the first pattern that matches, NULL when none does."""
    num = lambda e: F.regexp_replace(e, ",", "").try_cast("double")
    out = []
    for i, p in enumerate(GROWTH_PATTERNS):
        lo = F.regexp_extract(win, p, 1)
        hi = F.regexp_extract(win, p, 2) if i < 2 else lo
        out.append(F.when(lo != "", F.struct(num(lo).alias("low"), num(hi).alias("high"))))
    return F.coalesce(*out)


def profit_windows(text: str) -> Column:
    """Stretches of text around each mention of profit."""
    lens = F.transform(F.split(text, PROFIT_WORD), lambda p: F.length(p))
    at = F.transform(F.sequence(F.lit(1), F.size(lens) - 1), lambda k: F.aggregate(F.slice(lens, F.lit(1), k), F.lit(0), lambda a, b: a + b) + (k - 1) * len(PROFIT_WORD))
    at = F.when(F.size(lens) > 1, at).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda s: F.substring(F.col(text), F.greatest(s - BEFORE, F.lit(0)) + 1, s + AFTER - F.greatest(s - BEFORE, F.lit(0))))


def surge_screen(docs: DataFrame, min_growth: float = 50.0) -> DataFrame:
    """Companies whose announcements name a prosperity keyword and a profit surge, with losers left out.

    Every document is read whole where it lies; the company only merges flags and the growth of its first
    document that states one, so a company with any number of documents needs no concatenation. A match
    does not reach across two documents.
    """
    company = F.trim(F.regexp_extract("title", r"^([^:：]+)[:：]", 1))
    x = docs.select(F.when(company != "", company).otherwise(F.col("title")).alias("company"), "doc_order", F.col("text").alias("raw"), normalise(F.col("text")).alias("norm"))
    # every pattern holds a Han character, so one cheap look spares texts without any the rest
    x = x.withColumns({"han": F.col("raw").rlike(r"\p{IsHan}"), "mentions": F.contains("norm", F.lit(PROFIT_WORD))})
    has = lambda p: F.col("han") & F.col("raw").rlike(p)
    wins = F.transform(profit_windows("norm"), growth_in)
    pair = "struct<low:double,high:double>"
    near = F.element_at(F.concat(F.filter(wins, lambda g: g.isNotNull()), F.array(F.lit(None).cast(pair))), 1)
    x = x.withColumns({
        **{f"k{i}": has(p) for i, p in enumerate(KEYWORD_GROUPS.values())}, "loss": has(LOSS_WORDS), "turn": has(TURN_WORDS),
        "near": F.when(F.col("mentions"), near), "any": F.when(F.col("han") & ~F.col("mentions"), growth_in(F.col("norm")))})
    first = lambda col: F.min_by(col, F.when(F.col(col).isNotNull(), F.col("doc_order")))
    g = x.groupBy("company").agg(*[F.max(f"k{i}").alias(f"k{i}") for i in range(len(KEYWORD_GROUPS))], F.max("loss").alias("loss"), F.max("turn").alias("turn"),
                                 F.max("mentions").alias("mentions"), first("near").alias("near"), first("any").alias("any"))
    names = F.array_compact(F.array(*[F.when(F.col(f"k{i}"), F.lit(n)) for i, n in enumerate(KEYWORD_GROUPS)]))
    growth = F.when(F.col("mentions"), F.col("near")).otherwise(F.col("any"))
    out = F.col("loss") & ~F.col("turn")
    y = g.withColumns({"_g": growth, "keywords": F.array_join(names, ","), "n_keywords": F.size(names), "excluded": out})
    surge = ~F.col("excluded") & (F.col("turn") | F.coalesce(F.col("_g.low") >= min_growth, F.lit(False)))
    return y.select("company", "keywords", "n_keywords", F.col("_g.low").alias("growth_low"), F.col("_g.high").alias("growth_high"),
                    F.col("turn").alias("turnaround"), "excluded", (surge & (F.col("n_keywords") > 0)).alias("qualified"))


# fixed values: dimensions, weights per horizon, thresholds of the score table
DIMS = ("technical", "volume", "news", "macro", "industry", "position")
HORIZON_WEIGHTS = {"intraday": (0.30, 0.25, 0.20, 0.05, 0.10, 0.10), "short": (0.28, 0.20, 0.22, 0.08, 0.12, 0.10),
                   "swing": (0.25, 0.15, 0.20, 0.15, 0.15, 0.10), "long": (0.15, 0.05, 0.15, 0.25, 0.20, 0.20)}
DIRECTION_AT, P_FLOOR, P_CAP, LOGISTIC_K, MAX_POSITION = 0.6, 0.30, 0.72, 0.6, 0.25


def ev_scores(df: DataFrame) -> DataFrame:
    """Weighted score, direction, win rate, odds, expected value, position and grade per row.

    Missing dimensions give their weight to the others. Between the thresholds no value is computed.
    """
    zero = F.lit(0.0)
    w = {d: F.coalesce(*[F.when(F.col("horizon") == h, F.lit(ws[i])) for h, ws in HORIZON_WEIGHTS.items()]) for i, d in enumerate(DIMS)}
    have = reduce(lambda a, b: a + b, [F.when(F.col(d).isNotNull(), w[d]).otherwise(zero) for d in DIMS])
    x = df.withColumn("completeness", have)
    share = lambda d: F.when(F.col(d).isNotNull(), w[d] / F.nullif("completeness", zero) * F.col(d)).otherwise(zero)
    x = x.withColumn("z", F.when(F.col("completeness") > 0, reduce(lambda a, b: a + b, [share(d) for d in DIMS])))
    z, e, s, t = F.col("z"), F.col("entry"), F.col("stop"), F.col("target")
    lng, sht = (t > e) & (s < e), (t < e) & (s > e)
    priced = e.isNotNull() & s.isNotNull() & t.isNotNull()
    x = x.withColumns({"suggested": F.when(z >= DIRECTION_AT, "long").when(z <= -DIRECTION_AT, "short").when(z.isNotNull(), "neutral"),
                       "direction": F.when(priced, F.when(lng, "long").when(sht, "short")),
                       "error": F.when(z.isNull(), "no_scores").when(priced & ~lng & ~sht, "bad_prices")})
    good = F.col("error").isNull()
    live = good & (F.col("suggested") != "neutral")
    z_dir = F.when(F.col("direction") == "long", z).when(F.col("direction") == "short", -z).otherwise(F.abs(z))
    p = F.least(F.greatest(1.0 / (1.0 + F.exp(-LOGISTIC_K * z_dir)), F.lit(P_FLOOR)), F.lit(P_CAP))
    risk = F.when(F.col("direction") == "long", e - s).when(F.col("direction") == "short", s - e)
    gain = F.when(F.col("direction") == "long", t - e).when(F.col("direction") == "short", e - t)
    x = x.withColumns({"win_rate": F.when(live, p), "odds": F.when(good, gain / risk)})
    p, r = F.col("win_rate"), F.col("odds")
    half = 0.05 + 0.10 * (1.0 - F.col("completeness"))
    x = x.withColumns({"win_low": F.greatest(p - half, F.when(p.isNotNull(), 0.05)), "win_high": F.least(p + half, F.when(p.isNotNull(), 0.95)),
                       "ev": F.when(live, p * r - (1.0 - p)), "position_pct": F.when(live & r.isNotNull(), F.least(F.greatest((p - (1.0 - p) / r) / 4.0, zero), F.lit(MAX_POSITION)) * 100)})
    ev = F.col("ev")
    grade = F.when((ev >= 0.30) & (p >= 0.60) & (F.col("completeness") >= 0.999), "A").when(ev >= 0.15, "B").when(ev > 0, "C").when(ev.isNotNull(), "D")
    return x.withColumns({"grade": grade, "against": live & F.coalesce(((F.col("direction") == "long") & (z < 0)) | ((F.col("direction") == "short") & (z > 0)), F.lit(False))})


def schedule(df: DataFrame) -> DataFrame:
    """Three buying zones from EPS and PE scenarios, quarter-Kelly caps and where the price stands. One row per zone.

    Columns: eps_base, eps_bear, eps_worst, pe_high, pe_base, pe_low, price, split_1..3, win_1..3 (percent).
    """
    t1, t2, t3 = F.col("eps_base") * F.col("pe_base"), F.col("eps_bear") * F.col("pe_base"), F.col("eps_worst") * F.col("pe_low")
    z = lambda n, lo, hi: F.struct(F.lit(n).alias("zone"), lo.alias("zone_low"), hi.alias("zone_high"), F.col(f"split_{n}").alias("split"), F.col(f"win_{n}").alias("win"))
    x = df.withColumns({"line": t3, "goal": F.col("eps_base") * F.col("pe_high")})
    x = x.select(*df.columns, "line", "goal", F.explode(F.array(z(1, t1 * 0.96, t1), z(2, t2 * 0.95, t2), z(3, t3, t3 * 1.08))).alias("z")).select(*df.columns, "line", "goal", "z.*")
    buy = (F.col("zone_low") + F.col("zone_high")) / 2
    x = x.withColumn("buy", buy)
    down = F.col("buy") - F.col("line")
    p = F.col("win") / 100.0
    b = (F.col("goal") - F.col("buy")) / F.when(down > 0, down)
    cap = F.greatest(F.lit(0.0), (p * b - (1 - p)) / F.nullif(b, F.lit(0.0)) / 4.0) * 100.0
    x = x.withColumns({"odds": b, "kelly_cap": F.when(b.isNotNull() & p.isNotNull(), cap)})
    price, lo, hi = F.col("price"), F.col("zone_low"), F.col("zone_high")
    where = F.when(price.between(lo, hi), "inside").when(price > hi, "above").when(price < lo, "below")
    dist = F.when(price > hi, (price / hi - 1) * 100).when(price < lo, (1 - price / lo) * 100)
    return x.withColumns({"cap": F.when(F.col("kelly_cap").isNull(), F.col("split")).otherwise(F.least("split", "kelly_cap")), "position": where, "distance_pct": dist})


def scenario_matrix(df: DataFrame) -> DataFrame:
    """Price of every EPS and PE scenario."""
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("eps"), F.lit(b).alias("pe"), (F.col(a) * F.col(b)).alias("value"))
                                for a in ("eps_base", "eps_bear", "eps_worst") for b in ("pe_high", "pe_base", "pe_low")]))
    return df.select(*df.columns, cells.alias("c"))
