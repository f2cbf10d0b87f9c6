"""Price, index, FX and corporate-action files to facts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.functions.columns import DELIVERY, one_per_key
from tapeloom.operators.quality import clean_num, gate_calendar, lookup, market_of, ohlc_reason, text, to_symbol

# fixed values
INDEX_ALIAS = {"000300.SS": "000300.SH"}
INDEX_SETCODES = ("62", "32")
MARKET_TZ_HK = "Asia/Hong_Kong"
BAR_COLS = ("open", "high", "low", "close", "volume", "amount")


def compact_date(x: str) -> Column:
    """yyyyMMdd only."""
    return F.try_to_date(F.when(F.trim(x).rlike(r"^\d{8}$"), F.trim(x)), "yyyyMMdd")


def loose_date(x: str) -> Column:
    """yyyyMMdd or ISO."""
    return F.coalesce(compact_date(x), F.try_to_date(F.substring(F.trim(x), 1, 10), "yyyy-MM-dd"))


def utc_local_date(x: str, tz: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(F.try_to_timestamp(F.regexp_replace(F.trim(x), "Z$", "")), tz))


def gate(rows: DataFrame, cal: DataFrame | None, pre: Column, bad_row: str = "conflict") -> DataFrame:
    """Outcome of each row: earlier faults, then the calendar, then the bar itself. An empty bar is skipped."""
    x = rows if cal is None else gate_calendar(rows, cal)
    why = F.col("cal_reason") if cal is not None else F.lit(None).cast("string")
    bar = ohlc_reason()
    reason = F.coalesce(pre, F.when(why.isin("outside_calendar", "closed_day"), why), bar)
    outcome = (F.when(pre.isNotNull() | why.isin("outside_calendar", "closed_day"), "conflict").when(bar == "EMPTY", "skip")
               .when(bar.isNotNull(), bad_row).otherwise("ok"))
    return x.withColumns({"reason": reason, "outcome": outcome, "incomplete": F.coalesce(why == "calendar_missing", F.lit(False))}).drop("cal_reason")


def _faults() -> Column:
    return F.when(F.col("symbol").isNull(), "missing_symbol").when(F.col("trade_date").isNull(), "bad_date").when(F.col("market").isNull(), "unknown_market")


def parse_price_a(df: DataFrame, cal: DataFrame) -> DataFrame:
    x = df.select("file_path", text("thscode").alias("symbol"), compact_date("time").alias("trade_date"), market_of(F.trim("thscode")).alias("market"),
                  *[clean_num(k).alias(k) for k in BAR_COLS], text("currency").alias("currency"))
    return gate(x, cal, _faults())


def parse_price_b(df: DataFrame, cal: DataFrame) -> DataFrame:
    """Same layout with the turnover ratio."""
    x = df.select("file_path", text("thscode").alias("symbol"), compact_date("time").alias("trade_date"), market_of(F.trim("thscode")).alias("market"),
                  *[clean_num(k).alias(k) for k in BAR_COLS], clean_num("turnover").alias("turnover"), text("currency").alias("currency"))
    return gate(x, cal, _faults())


def turnover_update(bars: DataFrame, parsed: DataFrame) -> DataFrame:
    """Turnover written onto existing bars, only where it is known and differs; of repeated deliveries the last counts."""
    t = parsed.where("turnover is not null").select("symbol", "trade_date", F.col("turnover").alias("_t"), *[x for x in DELIVERY if x in parsed.columns])
    t = one_per_key(t, ["symbol", "trade_date"]).select("symbol", "trade_date", "_t")
    x = bars.join(t, ["symbol", "trade_date"], "left")
    change = F.col("_t").isNotNull() & (F.col("turnover").isNull() | (F.col("turnover") != F.col("_t")))
    return x.withColumns({"turnover_changed": change, "turnover": F.when(change, F.col("_t")).otherwise(F.col("turnover"))}).drop("_t")


def shares_of(volume: str, unit: str) -> Column:
    """Lots to shares: default lot of 100, unit 1 as it is."""
    return clean_num(volume) * F.coalesce(clean_num(unit), F.lit(100.0))


def parse_kline(df: DataFrame, cal: DataFrame) -> DataFrame:
    code, setcode = text("code"), text("setcode")
    sym = to_symbol("code", "setcode")
    x = df.select("file_path", sym.alias("symbol"), code.alias("_c"), setcode.alias("_s"), loose_date("data").alias("trade_date"), market_of(sym).alias("market"),
                  F.coalesce(text("tqflag"), F.lit("0")).alias("_tq"), *[clean_num(k).alias(k) for k in ("open", "high", "low", "close")],
                  shares_of("volume", "unit").alias("volume"), clean_num("amount").alias("amount"))
    pre = (F.when(F.col("_s").isin(*INDEX_SETCODES), "index_in_kline").when(F.col("_c").isNull() | F.col("_s").isNull(), "missing_code")
           .when(F.col("symbol").isNull(), "unknown_setcode").when(F.col("trade_date").isNull() & ~F.col("_tq").isin("1", "2"), "bad_date"))
    y = gate(x, cal, pre)
    forward = F.col("_tq").isin("1", "2") & ~F.coalesce(F.col("reason").isin("index_in_kline", "missing_code", "unknown_setcode"), F.lit(False))
    return y.withColumns({"outcome": F.when(forward, "skip").otherwise(F.col("outcome")), "reason": F.when(forward, "forward_row").otherwise(F.col("reason")),
                          "currency": F.when(F.col("market") == "HK", "HKD").otherwise("CNY")}).drop("_c", "_s", "_tq")


def parse_price_utc(df: DataFrame, cal: DataFrame) -> DataFrame:
    """UTC timestamps become market-local days; no amount."""
    m = market_of(F.trim("thscode"))
    tz = F.when(m == "HK", MARKET_TZ_HK).otherwise("Asia/Shanghai")
    x = df.select("file_path", text("thscode").alias("symbol"), utc_local_date("Date", tz).alias("trade_date"), m.alias("market"),
                  *[clean_num(k.capitalize()).alias(k) for k in ("open", "high", "low", "close", "volume")], F.lit(None).cast("double").alias("amount"),
                  text("currency").alias("currency"))
    return gate(x, cal, _faults())


def _index(x: DataFrame, bad_row: str = "conflict") -> DataFrame:
    y = x.withColumn("amount", F.lit(None).cast("double"))
    pre = F.coalesce(F.col("_pre"), F.when(F.col("trade_date").isNull(), "bad_date"))
    return gate(y, None, pre, bad_row).drop("_pre", "amount", "incomplete")


def parse_index(a: DataFrame, b: DataFrame, kline: DataFrame, utc: DataFrame) -> DataFrame:
    """Index bars of four vendors in one layout; vendor B skips bad rows, the others reject their file."""
    none = F.lit(None).cast("string")
    num = lambda cols: [clean_num(k).alias(k.lower()) for k in cols]
    five = ("open", "high", "low", "close", "volume")
    plain = lambda df: df.select("file_path", text("thscode").alias("index_code"), compact_date("time").alias("trade_date"), *num(five), text("currency").alias("currency"), none.alias("_pre"))
    pre = (F.when(text("code").isNull() | text("setcode").isNull(), "missing_code").when(~F.trim("setcode").isin(*INDEX_SETCODES), "not_an_index"))
    k = kline.select("file_path", to_symbol("code", "setcode").alias("index_code"), loose_date("data").alias("trade_date"), *num(five[:4]),
                     shares_of("volume", "unit").alias("volume"), F.when(F.trim("setcode") == "32", "HKD").otherwise("CNY").alias("currency"), pre.alias("_pre"))
    code = F.coalesce(lookup(F.trim("thscode"), INDEX_ALIAS), F.trim("thscode"))
    tz = F.when(market_of(code) == "HK", MARKET_TZ_HK).otherwise("Asia/Shanghai")
    u = utc.select("file_path", code.alias("index_code"), utc_local_date("Date", tz).alias("trade_date"), *num([c.capitalize() for c in five]), text("currency").alias("currency"), none.alias("_pre"))
    return _index(plain(a)).unionByName(_index(plain(b), "skip")).unionByName(_index(k)).unionByName(_index(u))


def parse_fx(df: DataFrame, direction: tuple[str, str]) -> DataFrame:
    """Rates in the wanted direction; a file of the opposite pair is inverted. Missing closes are skipped, others must be positive."""
    a, b = direction
    pair = F.regexp_replace(F.upper(F.regexp_extract("file_path", r"([^/]+)\.csv$", 1)), "=X", "")
    f, t = F.substring(pair, 1, 3), F.substring(pair, 4, 3)
    inv = (f == b) & (t == a)
    tz = F.when((f == "HKD") | (t == "HKD"), MARKET_TZ_HK).otherwise("Asia/Shanghai")
    close = clean_num("Close")
    d = close.cast("decimal(20,10)")
    rate = F.when(inv, (F.lit(1).cast("decimal(10,0)") / d).cast("decimal(28,12)")).otherwise(d.cast("decimal(28,12)"))
    pre = F.when(F.length(pair) != 6, "bad_pair").when(~inv & ~((f == a) & (t == b)), "wrong_direction")
    reason = F.coalesce(pre, F.when(close.isNull(), "missing_close").when(close <= 0, "not_positive"))
    outcome = F.when(pre.isNotNull() | (close <= 0), "conflict").when(close.isNull(), "skip").otherwise("ok")
    return df.select("file_path", F.lit(a).alias("from_currency"), F.lit(b).alias("to_currency"), utc_local_date("Date", tz).alias("rate_date"),
                     F.when(outcome == "ok", rate).alias("rate"), outcome.alias("outcome"), reason.alias("reason"))


def parse_actions(df: DataFrame) -> DataFrame:
    """A dividend and a split of one day become two actions; one row per symbol, ex-date and type."""
    sym = F.regexp_extract("file_path", r"([^/]+)\.csv$", 1)
    tz = F.when(market_of(sym) == "HK", MARKET_TZ_HK).otherwise("Asia/Shanghai")
    div, split = F.coalesce(clean_num("Dividends"), F.lit(0.0)), F.coalesce(clean_num("Stock Splits"), F.lit(0.0))
    acts = F.array_compact(F.array(
        F.when(div > 0, F.struct(F.lit("cash_dividend").alias("action_type"), div.alias("cash_per_share"), F.lit(None).cast("double").alias("split_ratio"))),
        F.when(split > 0, F.struct(F.lit("split").alias("action_type"), F.lit(None).cast("double").alias("cash_per_share"), split.alias("split_ratio")))))
    x = df.select(sym.alias("symbol"), utc_local_date("Date", tz).alias("ex_date"), F.explode(acts).alias("a")).select("symbol", "ex_date", "a.*")
    return x.groupBy("symbol", "ex_date", "action_type").agg(F.min("cash_per_share").alias("cash_per_share"), F.min("split_ratio").alias("split_ratio"))


def normalise_units(df: DataFrame) -> DataFrame:
    """Lots to shares, 1e8 units to single ones, percent turnover to a fraction."""
    return df.withColumns({"volume": F.floor(clean_num("volume_lots") * 100), "amount": F.floor(clean_num("amount_yi") * 1e8), "turnover": clean_num("turnover_pct") / 100})
