"""Statements, abstracts, holders, forecasts, share counts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.functions.columns import DELIVERY
from tapeloom.operators.quality import append_revision, clean_dec, clean_num, lookup, market_of, merge_facts, text, to_symbol
from tapeloom.operators.valuation import PREFERRED_GROUP

# fixed values: period types by month and day, unit multipliers, columns of vendors
PERIOD_TYPES = {"1231": "annual", "0630": "interim", "0331": "quarterly", "0930": "quarterly"}
UNITS = {"yuan": "1", "万元": "10000", "wan_yuan": "10000", "百万元": "1000000", "million_yuan": "1000000", "亿元": "100000000",
         "hundred_million_yuan": "100000000"}
INCOME_COLUMNS = {"revenue": ("ths_operating_total_revenue_stock", "ths_revenue_stock"), "net_profit_attr": ("ths_np_atoopc_stock",),
                  "eps_basic": ("ths_basic_eps_stock",), "eps_diluted": ("ths_dlt_earnings_per_share_stock",)}
BALANCE_FIELDS = ("total_assets", "total_liabilities", "total_equity_attr", "monetary_fund", "short_term_borrowing", "long_term_borrowing",
                  "bonds_payable", "noncurrent_liab_1y", "inventory", "accounts_receivable", "accounts_payable", "goodwill")
CASH_FIELDS = ("ocf", "capex", "icf", "financing_cf", "net_cash_increase")
ABSTRACT_INCOME = {"net_profit_attr": "归母净利润", "revenue": "营业总收入", "eps_basic": "基本每股收益"}
RECONCILE_TOL = 0.005
FACTS = ["revenue", "net_profit_attr", "eps_basic", "eps_diluted"]
REPORT_KEY = ["symbol", "period_end", "period_type", "is_cumulative"]


def period_type(day: Column) -> Column:
    return F.coalesce(lookup(F.date_format(day, "MMdd"), PERIOD_TYPES), F.lit("quarterly"))


def file_period() -> Column:
    return F.try_to_date(F.regexp_extract("file_path", r"_is_(\d{8})", 1), "yyyyMMdd")


def parse_income_a(df: DataFrame, current: DataFrame) -> DataFrame:
    """Income statements whose period is in the file name; the first filled candidate column wins. Only new content
    comes back, as revision 1 or one above the newest."""
    facts = [F.coalesce(*[clean_dec(k) for k in cols]).alias(n) for n, cols in INCOME_COLUMNS.items()]
    at = [k for k in DELIVERY if k in df.columns]
    x = df.select(text("thscode").alias("symbol"), file_period().alias("period_end"), *facts, *at).where("symbol is not null and period_end is not null")
    x = x.select("symbol", "period_end", period_type(F.col("period_end")).alias("period_type"), F.lit(True).alias("is_cumulative"),
                 F.year("period_end").alias("fiscal_year"), *FACTS, *at)
    return append_revision(current, x, REPORT_KEY, FACTS)


def parse_income_b(df: DataFrame) -> DataFrame:
    """Statements with a unit: amounts scale to single units, per-share values do not; an unknown unit counts as one and says so."""
    scale = lookup(F.trim("unit"), UNITS)
    k = F.coalesce(scale, F.lit("1")).cast("decimal(10,0)")
    money = lambda c: (clean_dec(c).cast("decimal(26,6)") * k).cast("decimal(38,6)")
    end = F.coalesce(file_period(), F.try_to_date(F.trim("period_end"), "yyyy-MM-dd"))
    sym = to_symbol("code", "setcode")
    cum = F.coalesce(text("is_cumulative"), F.lit("1")).isin("1", "true", "True", "yes")
    x = df.select(sym.alias("symbol"), end.alias("period_end"), cum.alias("is_cumulative"), money("revenue").alias("revenue"),
                  money("net_profit_attr").alias("net_profit_attr"), clean_dec("eps_basic").alias("eps_basic"), clean_dec("eps_diluted").alias("eps_diluted"),
                  F.coalesce(text("currency"), F.lit("CNY")).alias("currency"), F.try_to_date(F.substring(F.trim("published_at"), 1, 10), "yyyy-MM-dd").alias("published_on"),
                  scale.isNull().alias("unit_unknown"), market_of(sym).alias("market"))
    return x.where("symbol is not null and period_end is not null").withColumns({"period_type": period_type(F.col("period_end")), "fiscal_year": F.year("period_end")})


def fill_published(current: DataFrame, parsed: DataFrame) -> DataFrame:
    """Publication dates filled in where content is unchanged and the stored date is missing."""
    last = current.groupBy(*REPORT_KEY).agg(F.max_by(F.struct("revision", "published_on", *FACTS), "revision").alias("l"))
    x = parsed.join(last, REPORT_KEY)
    same = F.lit(True)
    for v in FACTS:
        same = same & F.col(f"l.{v}").eqNullSafe(F.col(v))
    return x.where(same & F.col("l.published_on").isNull() & F.col("published_on").isNotNull()).select(
        *REPORT_KEY, F.col("l.revision").alias("revision"), "published_on")


def parse_statement(df: DataFrame, fields, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a statement attached to the newest report header, and the degraded headers that had to be created."""
    x = df.select(to_symbol("code", "setcode").alias("symbol"), F.try_to_date(F.trim("period_end"), "yyyy-MM-dd").alias("period_end"),
                  *[clean_dec(f).alias(f) for f in fields], F.coalesce(text("currency"), F.lit("CNY")).alias("currency"))
    x = x.where(F.col("symbol").isNotNull() & F.col("period_end").isNotNull() & F.coalesce(*fields).isNotNull()).withColumn(
        "period_type", period_type(F.col("period_end")))
    key = ["symbol", "period_end", "period_type"]
    last = headers.where("is_cumulative").groupBy(*key).agg(F.max("revision").alias("revision"))
    y = x.join(last, key, "left").withColumn("created", F.col("revision").isNull()).withColumn("revision", F.coalesce("revision", F.lit(1)))
    return y, y.where("created").select(*key, "revision", "currency").distinct()


def fold_abstract(df: DataFrame) -> DataFrame:
    """Long (period, group, indicator, value) rows to one nested map per symbol and period."""
    sym = F.regexp_extract("file_path", r"(\d{6}\.(?:SH|SZ|BJ))_abstract", 1)
    x = df.select(sym.alias("symbol"), F.try_to_date(F.trim("period_end"), "yyyy-MM-dd").alias("period_end"), text("group").alias("grp"),
                  text("indicator").alias("indicator"), clean_dec("value").alias("value"))
    x = x.where("symbol <> '' and period_end is not null and grp is not null and indicator is not null and value is not null")
    x = x.groupBy("symbol", "period_end", "grp", "indicator").agg(F.max("value").alias("value"))
    g = x.groupBy("symbol", "period_end", "grp").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("indicator", "value")))).alias("m"))
    return g.groupBy("symbol", "period_end").agg(F.map_from_entries(F.collect_list(F.struct("grp", "m"))).alias("payload"))


def abstract_income(snap: DataFrame) -> DataFrame:
    common = F.col("payload")[PREFERRED_GROUP]
    return snap.select("symbol", "period_end", *[common[v].alias(k) for k, v in ABSTRACT_INCOME.items()])


def reconcile(abstract: DataFrame, facts: DataFrame, tol: float = RECONCILE_TOL) -> DataFrame:
    """Values of the abstract that differ from the stored ones by more than the tolerance, relative to the stored one."""
    f = facts.select("symbol", "period_end", *[F.col(k).alias(f"_{k}") for k in ("net_profit_attr", "revenue")])
    x = abstract.join(f, ["symbol", "period_end"])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("double").alias("abstract_value"), F.col(f"_{k}").cast("double").alias("stored_value"))
                               for k in ("net_profit_attr", "revenue")]))
    y = x.select("symbol", "period_end", rows.alias("r")).select("symbol", "period_end", "r.*")
    return y.where((F.col("stored_value") != 0) & (F.abs(F.col("abstract_value") - F.col("stored_value")) / F.abs("stored_value") > tol))


def backfill_nulls(facts: DataFrame, abstract: DataFrame) -> DataFrame:
    """Fill only what is missing, and only where neither profit nor revenue is known; periods without facts are added."""
    a = abstract.where("net_profit_attr is not null or revenue is not null").select("symbol", "period_end", *[F.col(k).alias(f"_{k}") for k in ABSTRACT_INCOME])
    x = facts.join(a, ["symbol", "period_end"], "full_outer")
    empty = F.col("net_profit_attr").isNull() & F.col("revenue").isNull()
    known = F.coalesce(*[F.col(f"_{k}") for k in ABSTRACT_INCOME]).isNotNull()
    return x.select("symbol", "period_end", *[F.when(empty, F.coalesce(k, f"_{k}")).otherwise(F.col(k)).alias(k) for k in ABSTRACT_INCOME],
                    (empty & known).alias("filled"))


HOLDER_FIELDS = ("holder_count", "holder_count_prev", "holder_count_delta", "holder_count_delta_pct", "avg_hold_value", "avg_hold_shares", "total_share", "share_change")


def parse_holders(df: DataFrame, current: DataFrame) -> DataFrame:
    """Holder counts per symbol and date, merged into the current ones; rows without a date or a count are dropped."""
    whole = lambda k: F.floor(clean_num(k)).cast("double")
    cols = [(whole(k) if k.startswith("holder_count") and k != "holder_count_delta_pct" else clean_num(k)).alias(k) for k in HOLDER_FIELDS]
    x = df.select(F.regexp_extract("file_path", r"(\d{6}\.(?:SH|SZ|BJ))_gdhs", 1).alias("symbol"), F.try_to_date(F.trim("stat_date"), "yyyy-MM-dd").alias("stat_date"),
                  *cols, text("announced_at").alias("announced_at"), *[k for k in DELIVERY if k in df.columns])
    x = x.where("symbol <> '' and stat_date is not null and holder_count is not null")
    return merge_facts(current, x, ["symbol", "stat_date"], [*HOLDER_FIELDS, "announced_at"], HOLDER_FIELDS)


def parse_forecast(df: DataFrame, snapshot_at: str) -> DataFrame:
    """Rows of forecast files, one JSON document each with its place, under the first symbol that the file names."""
    cols = [c for c in df.columns if c not in ("file_path", "row_no", "corrupt")]
    named = df.where(text("thscode").isNotNull()).groupBy("file_path").agg(F.min_by(text("thscode"), "row_no").alias("symbol"))
    return df.join(named, "file_path").select("symbol", F.lit(snapshot_at).cast("date").alias("snapshot_at"), "row_no", F.to_json(F.struct(*cols)).alias("payload_json"))


def parse_shares(df: DataFrame, bars: DataFrame, current: DataFrame) -> DataFrame:
    """Share snapshots in force from the symbol's first bar: new, equal to a stored one (skip) or different (conflict)."""
    first = bars.groupBy("symbol").agg(F.min("trade_date").alias("effective_at"))
    x = df.select(text("thscode").alias("symbol"), F.round(clean_dec("ths_total_shares_stock"), 0).cast("decimal(28,0)").alias("shares"))
    x = x.where("symbol is not null").join(first, "symbol", "left")
    old = current.where("share_count_type = 'group_total'").select("symbol", "effective_at", F.col("shares").cast("decimal(28,0)").alias("_old"))
    x = x.join(old, ["symbol", "effective_at"], "left")
    outcome = (F.when(F.col("shares").isNull(), "missing_shares").when(F.col("effective_at").isNull(), "no_bars").when(F.col("_old").isNull(), "insert")
               .when(F.col("_old") == F.col("shares"), "skip").otherwise("conflict"))
    return x.select("symbol", "effective_at", "shares", outcome.alias("outcome"))


def parse_quotes(df: DataFrame, current: DataFrame) -> DataFrame:
    """Total shares in units of 10,000 to single shares, once per symbol and snapshot day. Its own count type keeps it out of PE."""
    day = F.coalesce(F.try_to_date(F.trim("snapshot_at"), "yyyy-MM-dd"), F.try_to_date(F.trim("hqdate"), "yyyyMMdd"))
    wan = clean_num("zgb")
    x = df.select(to_symbol("code", "setcode").alias("symbol"), day.alias("effective_at"), F.bround(wan * 10000, 0).cast("long").alias("shares"),
                  (wan > 0).alias("_ok")).where("symbol is not null and effective_at is not null and _ok").drop("_ok")
    x = x.groupBy("symbol", "effective_at").agg(F.min("shares").alias("shares"))
    return x.join(current.select("symbol", "effective_at"), ["symbol", "effective_at"], "left_anti").withColumn("share_count_type", F.lit("group_total_tdx"))

