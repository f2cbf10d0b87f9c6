"""Announcements, news, flow events, calendars, macro and industry files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.functions.columns import DELIVERY, occurrences, one_per_key
from tapeloom.session import cut_lineage
from tapeloom.operators.quality import clean_dec, clean_num, local_midnight_utc, market_of, next_open, text, to_symbol, tz_of

SUMMARY_CHARS = 120  # fixed value: length of the summary a message without one gets
# fixed values: column names under which vendors deliver a field, in order of preference
ALIASES = {"date": ("reportdate", "time", "date", "announcement_date", "公告日期"), "title": ("reporttitle", "title", "announcement_title", "公告标题"),
           "url": ("pdfurl", "url", "pdf_url", "announcement_url", "公告链接"), "seq": ("seq", "sequence", "announcement_id", "id", "公告序号"),
           "symbol": ("thscode", "ticker", "symbol")}
TICKER = r"(\d{6}\.(?:SH|SZ|BJ)|\d{4,5}\.HK)"


def event_id(*parts: Column) -> Column:
    return F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def file_ticker(pattern: str = TICKER) -> Column:
    t = F.regexp_extract(F.regexp_extract("file_path", r"([^/]+)\.csv$", 1), pattern, 1)
    return F.nullif(t, F.lit(""))


def _dated(x: DataFrame, spine: DataFrame, source: Column, dedup: Column) -> DataFrame:
    """Publication at local midnight, availability at the next open day, one row per event id."""
    y = next_open(x.withColumn("market", market_of("symbol")), spine, "pub_date", "_avail")
    tz = tz_of("market")
    y = y.withColumns({"event_id": event_id(source, dedup), "published_at": local_midnight_utc("pub_date", tz), "available_at": local_midnight_utc("_avail", tz)})
    cols = [c for c in y.columns if c not in ("_avail", "event_id")]
    return y.groupBy("event_id").agg(F.min_by(F.struct(*cols), F.struct("symbol", "title")).alias("r")).select("event_id", "r.*")


def parse_disclosure(df: DataFrame, source: str, spine: DataFrame) -> DataFrame:
    """Announcements in the common layout; the ticker is in the file name, else in code and setcode."""
    x = df.select(F.coalesce(file_ticker(), to_symbol("code", "setcode")).alias("symbol"), text("title").alias("title"),
                  F.try_to_date(F.substring(F.trim("time"), 1, 10), "yyyy-MM-dd").alias("pub_date"), text("url").alias("url"),
                  F.coalesce(text("summary"), text("source")).alias("summary")).where("symbol is not null and title is not null and pub_date is not null")
    return _dated(x, spine, F.lit(source), F.concat_ws("|", "title", F.col("pub_date").cast("string"))).withColumn("source_tier", F.lit(1))


def parse_ann_uuid(df: DataFrame, spine: DataFrame, source: str = "tianyancha") -> tuple[DataFrame, DataFrame]:
    """Announcements with a vendor id. A row of another domestic code rejects its file; rows of other markets are skipped."""
    code = text("stock_code")
    sym = file_ticker(r"(\d{6}\.(?:SH|SZ|BJ))")
    x = df.select("file_path", sym.alias("symbol"), text("title").alias("title"), F.try_to_date(F.substring(F.trim("time"), 1, 10), "yyyy-MM-dd").alias("pub_date"),
                  text("uuid").alias("uuid"), code.alias("_c"))
    other = F.col("_c").isNotNull() & (F.col("_c") != F.substring_index("symbol", ".", 1))
    pre = (F.when(F.col("symbol").isNull(), "conflict").when(F.col("title").isNull() | F.col("pub_date").isNull(), "conflict")
           .when(other & F.col("_c").rlike(r"^\d{6}$"), "conflict").when(other, "skip").otherwise("ok"))
    x = x.withColumn("outcome", pre)
    files = x.groupBy("file_path").agg(*[F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in ("ok", "skip", "conflict")])
    good = x.where("outcome = 'ok'").join(files.where("conflict > 0").select("file_path"), "file_path", "left_anti")
    dedup = F.coalesce("uuid", F.concat_ws("|", "title", F.col("pub_date").cast("string")))
    return _dated(good.drop("_c", "outcome"), spine, F.lit(source), dedup), files


def pick(df: DataFrame, field: str) -> Column:
    """First filled column among the aliases of a field, whatever the case of the names."""
    have = {c.lower(): c for c in df.columns}
    cols = [text(F.col(f"`{have[a]}`")) for a in ALIASES[field] if a in have]
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def parse_ann_alias(df: DataFrame, spine: DataFrame, source: str = "stock_finance_data") -> DataFrame:
    x = df.select(F.coalesce(pick(df, "symbol"), file_ticker(r"^(\d{6}\.(?:SH|SZ|BJ))$")).alias("symbol"), pick(df, "title").alias("title"),
                  F.try_to_date(F.substring(pick(df, "date"), 1, 10), "yyyy-MM-dd").alias("pub_date"), pick(df, "url").alias("url"), pick(df, "seq").alias("external_id"))
    x = x.where("title is not null and pub_date is not null")
    return _dated(x, spine, F.lit(source), F.coalesce("external_id", F.concat_ws("|", "title", F.col("pub_date").cast("string"))))


def first_of_two_keys(x: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """Rows that no earlier kept row equals in key ``a`` or key ``b``; NULL keys equal nothing.

    Rows that come first under both keys are kept, everything they share a key with goes, and what is left is
    looked at again. Chains of mixed keys are rare, so few rounds are needed; each is two map-side combined
    minima and two anti-joins, whatever share of the rows a key has.
    """
    own = F.concat(F.lit("row:"), F.col(order).cast("string"))
    rest = x.withColumns({"_a": F.coalesce(F.concat(F.lit("k:"), a), own), "_b": F.coalesce(F.concat(F.lit("k:"), b), own)})
    kept = None
    while True:
        firsts = lambda k: rest.groupBy(k).agg(F.min(order).alias(order)).select(order)
        now = cut_lineage(rest.join(firsts("_a").intersect(firsts("_b")), order, "left_semi"))
        kept = now if kept is None else kept.unionByName(now)
        rest = cut_lineage(rest.join(now.select("_a"), "_a", "left_anti").join(now.select("_b"), "_b", "left_anti"))
        if rest.isEmpty():
            return kept.drop("_a", "_b")


def parse_news(df: DataFrame, known: DataFrame, source: str = "akshare") -> DataFrame:
    """News without duplicates: same external id or same content hash, against the stored ones and each other.

    Messages with neither are known by their title; of one event id the first row stays.
    """
    x = df.select(text("title").alias("title"), F.coalesce(text("content"), F.lit("")).alias("content"), text("published_at").alias("published_at"),
                  text("source_external_id").alias("ext_id"), text("content_hash").alias("content_hash"), text("summary").alias("_sum"), "row_no")
    x = x.where("title is not null and published_at is not null")
    x = x.join(known.where("ext_id is not null").select("ext_id").distinct(), "ext_id", "left_anti").join(
        known.where("content_hash is not null").select("content_hash").distinct(), "content_hash", "left_anti")
    ids = first_of_two_keys(x.select("row_no", "ext_id", "content_hash"), "ext_id", "content_hash", "row_no").select("row_no")
    kept = x.join(ids, "row_no", "left_semi").select(
        "row_no", event_id(F.lit(source), F.coalesce("ext_id", "content_hash", "title")).alias("event_id"), "title", "content", "published_at",
        F.col("published_at").alias("available_at"), F.coalesce("_sum", F.substring("content", 1, SUMMARY_CHARS)).alias("summary"), F.lit(4).alias("source_tier"))
    return one_per_key(kept, ["event_id"], last=False, order=("row_no",)).select(*kept.columns)


def match_entities(news: DataFrame, watch: DataFrame) -> DataFrame:
    """Symbols named in a message: six-digit codes with suffix, or a pool name or alias as it stands in the text."""
    t = F.concat_ws(" ", "title", F.coalesce("content", F.lit("")))
    texts = news.select("event_id", t.alias("text"))
    codes = texts.select("event_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?<![0-9A-Za-z_])(\d{6}\.(?:SH|SZ|BJ|HK))(?![0-9A-Za-z_])"), F.lit(1))).alias("symbol"))
    terms = watch.where("active").select("symbol", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("term")).where("term <> ''")
    named = occurrences(texts, terms).join(terms, "term").select("event_id", "symbol")
    return codes.unionByName(named).distinct()


def yi(col: str) -> Column:
    return F.concat(F.format_string("%.2f", clean_num(col) / 1e8), F.lit(" 亿"))


def flow_lhb(df: DataFrame) -> DataFrame:
    """One event per symbol and day: reasons joined in order of appearance, values of the first row."""
    val = F.struct("net_buy", "net_buy_ratio", "pct_chg")
    one = df.where("symbol is not null and trade_date is not null").groupBy("symbol", "trade_date", "reason").agg(
        F.min("row_no").alias("row_no"), F.min_by(val, "row_no").alias("f"))  # one row per reason from here on
    x = one.groupBy("symbol", "trade_date").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "reason"))), lambda v: v["reason"]), "；").alias("reasons"),
        F.min_by("f", "row_no").alias("f"))
    ext = F.concat_ws(":", F.lit("lhb"), "symbol", F.col("trade_date").cast("string"))
    buy = F.col("f.net_buy")
    side = F.when(F.startswith(buy, F.lit("-")), "净卖出").otherwise("净买入")
    body = F.concat_ws("；", F.when(buy.isNotNull(), F.concat(side, F.lit(" "), yi("f.net_buy"), F.lit("元"))),
                       F.when(F.col("f.net_buy_ratio").isNotNull(), F.concat(F.lit("占成交比 "), "f.net_buy_ratio", F.lit("%"))),
                       F.when(F.col("f.pct_chg").isNotNull(), F.concat(F.lit("当日涨跌幅 "), "f.pct_chg", F.lit("%"))))
    return x.select(event_id(F.lit("akshare"), F.lit("lhb"), ext).alias("event_id"), "symbol", "trade_date",
                    F.concat(F.lit("龙虎榜上榜（"), F.coalesce(F.nullif("reasons", F.lit("")), F.lit("上榜")), F.lit("）")).alias("title"), F.nullif(body, F.lit("")).alias("summary"))


def flow_block(df: DataFrame) -> DataFrame:
    """One event per symbol, day, price and volume, whole as it was delivered first."""
    x = df.where(F.coalesce(text("price"), F.lit("")) != "").where("symbol is not null and trade_date is not null and volume is not null")
    ext = F.concat_ws(":", F.lit("dzjy"), "symbol", F.col("trade_date").cast("string"), "price", "volume")
    title = F.concat(F.lit("大宗交易：成交价 "), "price", F.coalesce(F.concat(F.lit("（折溢价 "), text("premium_rate"), F.lit("%）")), F.lit("")))
    body = F.concat_ws("；", F.concat(F.lit("成交量 "), "volume", F.lit(" 股")), F.concat(F.lit("成交额 "), yi("amount"), F.lit("元")),
                       F.concat(F.lit("买方 "), text("buy_branch")), F.concat(F.lit("卖方 "), text("sell_branch")))
    y = x.select(event_id(F.lit("akshare"), F.lit("dzjy"), ext).alias("event_id"), "symbol", "trade_date", title.alias("title"), body.alias("summary"), *[k for k in DELIVERY if k in df.columns])
    return one_per_key(y, ["event_id"], last=False).select("event_id", "symbol", "trade_date", "title", "summary")


def cal_id(kind: str, day: Column) -> Column:
    return F.concat(F.lit("cal_"), F.substring(F.sha2(F.concat_ws("|", F.lit("akshare"), F.lit(kind), F.coalesce("symbol", F.lit("")), day.cast("string")), 256), 1, 16))


def cal_disclosure(df: DataFrame) -> DataFrame:
    """Disclosure bookings: the latest of three changes, else the first booking; the note tells of changes."""
    when = F.coalesce("change3", "change2", "change1", "first_booking")
    note = F.concat(F.lit("财报披露预约（"), "period", F.lit("）"),
                    F.when(F.col("first_booking").isNotNull() & (F.col("first_booking") != when), F.concat(F.lit("，首次预约 "), F.col("first_booking").cast("string"), F.lit("（已变更）"))).otherwise(""),
                    F.when(F.col("actual").isNotNull(), "，已实际披露").otherwise(""))
    x = df.where(F.col("symbol").isNotNull() & when.isNotNull()).select(cal_id("report_disclosure", when).alias("cal_id"), "symbol", when.alias("scheduled_date"), note.alias("note"))
    return x.groupBy("cal_id", "symbol", "scheduled_date").agg(F.min("note").alias("note"))


def cal_unlock(df: DataFrame) -> DataFrame:
    note = F.concat_ws("；", F.concat(F.lit("解禁 "), F.format_string("%.2f", clean_num("shares_free") / 1e8), F.lit(" 亿股")),
                       F.concat(F.lit("占总市值 "), F.format_string("%.2f", clean_num("ratio_total") * 100), F.lit("%")), text("share_type"))
    x = df.where("symbol is not null and unlock_date is not null").select(cal_id("unlock", F.col("unlock_date")).alias("cal_id"), "symbol",
                                                                         F.col("unlock_date").alias("scheduled_date"), F.nullif(note, F.lit("")).alias("note"))
    return x.groupBy("cal_id", "symbol", "scheduled_date").agg(F.min("note").alias("note"))


def parse_macro(df: DataFrame, current: DataFrame) -> DataFrame:
    """Upsert by factor type, code and day: the row delivered last replaces the stored one, with its name, change and unit."""
    key, values = ["factor_type", "code", "trade_date"], ["market", "close", "name", "change_pct", "unit"]
    x = df.dropna(subset=[*key, "close"]).select(
        *key, F.coalesce(text("market"), F.lit("CN")).alias("market"), "close", text("name").alias("name"), clean_dec("change_pct").alias("change_pct"),
        text("unit").alias("unit"), *[k for k in DELIVERY if k in df.columns])
    x = one_per_key(x, key).select(*key, *values)
    return current.select(*key, *values).join(x, key, "left_anti").withColumn("fresh", F.lit(False)).unionByName(x.withColumn("fresh", F.lit(True)))


def parse_industry(df: DataFrame, current: DataFrame) -> DataFrame:
    """Industry membership, the row delivered last; the classification day is the folder after ``industry``."""
    x = df.select(text("symbol").alias("symbol"), text("industry_code").alias("industry_code"), text("industry_name").alias("industry_name"),
                  F.try_to_date(F.regexp_extract("file_path", r"/industry/(\d{4}-\d{2}-\d{2})/", 1), "yyyy-MM-dd").alias("classification_date"), *[k for k in DELIVERY if k in df.columns])
    key = ["symbol", "classification_date"]
    fields = [*key, "industry_code", "industry_name"]
    x = one_per_key(x.dropna(subset=fields), key).select("symbol", "industry_code", "industry_name", "classification_date")
    return current.join(x, key, "left_anti").unionByName(x)


def expand_calendar(spec: DataFrame, holidays: DataFrame, half_days: DataFrame) -> DataFrame:
    """One row per day of each (market, year): holiday before weekend before half day before trading."""
    days = spec.select("market", F.explode(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))).alias("trade_date"))
    h = holidays.select("market", F.explode(F.sequence("from_date", "to_date")).alias("trade_date"), F.col("name").alias("_h")).dropDuplicates(["market", "trade_date"])
    half = half_days.select("market", "trade_date", F.col("name").alias("_d")).dropDuplicates(["market", "trade_date"])
    x = days.join(h, ["market", "trade_date"], "left").join(half, ["market", "trade_date"], "left")
    status = F.when(F.col("_h").isNotNull(), "holiday").when(F.weekday("trade_date") >= 5, "weekend").when(F.col("_d").isNotNull(), "half_day").otherwise("trading")
    return x.select("market", "trade_date", status.alias("status"), status.isin("half_day", "trading").alias("is_open"), (status == "trading").alias("is_full_day"),
                    F.when(status == "holiday", F.col("_h")).when(status == "half_day", F.col("_d")).alias("status_detail"))


def explode_md_table(df: DataFrame, col: str = "table_markdown", key: str = "doc_id") -> DataFrame:
    """Markdown tables inside cells to long (row, column, value) rows.

    Blank headers get a number, repeated ones a suffix; separator lines and ragged rows drop out, equal rows count once.
    Equal rows are found by one string: cells hold neither bars nor line ends. Sorts compare its hash first.
    """
    strip = lambda v: F.btrim(v, F.lit(" \t\n\x0b\f\r"))
    bars = lambda v: F.btrim(v, F.lit("|"))
    cells = lambda v: F.transform(F.split(v, r"\|"), strip)
    ruler = lambda s: (F.length(s) > 2) & F.endswith(s, F.lit("|")) & (F.translate(s, " \t\n\x0b\f\r-:|", "") == "")
    width = lambda v: F.length(v) - F.length(F.replace(v, F.lit("|"), F.lit(""))) + 1
    lines = F.filter(F.transform(F.split(col, r"\\n|\n"), strip), lambda s: F.startswith(s, F.lit("|")))
    # no filter on the number of lines: it would be pushed below and split every table once more
    x = df.select(key, lines.alias("l")).select(key, cells(bars(F.get("l", F.lit(0)))).alias("h"), F.slice("l", 2, 2147483647).alias("l"))
    named = F.transform("h", lambda v, i: F.when(v == "", F.concat(F.lit("_col"), (i + 1).cast("string"))).otherwise(v))
    x = x.withColumn("h", named)
    seen = lambda v, i: F.size(F.filter(F.slice("h", F.lit(1), i + 1), lambda u: u == v))
    uniq = F.transform("h", lambda v, i: F.when(seen(v, i) > 1, F.concat(v, F.lit("_"), seen(v, i).cast("string"))).otherwise(v))
    rows = F.filter(F.transform(F.filter("l", lambda s: ~ruler(s)), bars), lambda v: width(v) == F.size("h"))
    x = x.withColumn("u", F.array_join(uniq, "|")).select(key, "u", F.posexplode(rows).alias("row_no", "c"))
    x = x.select(F.struct(key, "row_no").alias("k"), F.concat(F.array_join(cells(F.col("c")), "|"), F.lit("\n"), "u").alias("row"))
    x = x.groupBy(F.xxhash64("row").alias("hash"), "row").agg(F.min("k").alias("k"))
    part = lambda i: F.split(F.split_part("row", F.lit("\n"), F.lit(i)), r"\|")
    x = x.select("k.*", F.explode(F.arrays_zip(part(2).alias("h"), part(1).alias("c"))).alias("z"))
    return x.select(key, "row_no", F.col("z.h").alias("column"), F.col("z.c").alias("value"))
