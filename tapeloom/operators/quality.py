"""Row checks, batch policy, change capture and day status."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.functions.columns import DELIVERY, c, one_per_key

TOL = 1e-6
SEARCH_DAYS = 40
# fixed values: suffix and setcode tables
SUFFIX_MARKET = {"SH": "CN", "SZ": "CN", "BJ": "CN", "HK": "HK"}
SETCODE_SUFFIX = {"1": "SH", "0": "SZ", "2": "BJ", "31": "HK", "62": "SH", "32": "HK"}
MARKET_TZ = {"CN": "Asia/Shanghai", "HK": "Asia/Hong_Kong"}
BLANKS = ("", "NA", "nan", "None", "null")


def lookup(col: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[col]


def text(x) -> Column:
    """Trimmed text, NULL when empty."""
    return F.nullif(F.trim(c(x)), F.lit(""))


def _filled(x) -> Column:
    t = F.trim(c(x))
    return F.when(~t.isin(*BLANKS), t)


def clean_num(x) -> Column:
    return _filled(x).try_cast("double")


def clean_dec(x) -> Column:
    """Fixed-point decimal; no exponent survives."""
    return _filled(x).try_cast("decimal(38,10)")


def dec_text(x: Column) -> Column:
    """Decimal as text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def market_of(symbol) -> Column:
    return lookup(F.upper(F.substring_index(c(symbol), ".", -1)), SUFFIX_MARKET)


def to_symbol(code, setcode) -> Column:
    """code + setcode to a suffixed symbol; NULL for an unknown setcode."""
    return F.concat(F.trim(c(code)), F.lit("."), lookup(F.trim(c(setcode)), SETCODE_SUFFIX))


def tz_of(market) -> Column:
    return lookup(c(market), MARKET_TZ)


def ohlc_reason(o="open", h="high", l="low", cl="close", v="volume", a="amount") -> Column:
    """NULL when the bar is fine, EMPTY when it has no price at all, else why it is wrong."""
    ps = [c(k) for k in (o, h, l, cl)]
    every = reduce(lambda x, y: x & y, [p.isNull() for p in ps])
    some = reduce(lambda x, y: x | y, [p.isNull() for p in ps])
    order = (c(l) - TOL <= F.least(c(o), c(cl))) & (F.greatest(c(o), c(cl)) <= c(h) + TOL)
    return (F.when(every, "EMPTY").when(some, "partial_ohlc").when(F.least(*ps) < 0, "negative_price").when(~order, "ohlc_order")
            .when(c(v) < 0, "negative_volume").when(c(a) < 0, "negative_amount"))


def validate_ohlc(bars: DataFrame) -> DataFrame:
    return bars.withColumn("reason", ohlc_reason())


def gate_calendar(rows: DataFrame, cal: DataFrame) -> DataFrame:
    """Why a row's day cannot be: no calendar of the market (incomplete), outside its range, or closed (conflicts)."""
    have = cal.select("market").distinct().withColumn("_have", F.lit(True))
    x = rows.join(have, "market", "left").join(cal.select("market", "trade_date", "is_open"), ["market", "trade_date"], "left")
    reason = F.when(F.col("_have").isNull(), "calendar_missing").when(F.col("is_open").isNull(), "outside_calendar").when(~F.col("is_open"), "closed_day")
    return x.withColumn("cal_reason", reason).drop("_have", "is_open")


def batch_policy(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One conflicting row rejects its whole file; returns the surviving ok rows and a status row per file.

    ``rows`` carries file_path, outcome (ok, skip, conflict) and incomplete. Files are summarised by a
    map-side combined aggregate and bad ones removed by an anti-join, so a file of any size stays spread out.
    """
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    files = rows.groupBy("file_path").agg(n("ok").alias("ok"), n("skip").alias("skipped"), n("conflict").alias("conflicts"),
                                          F.max(F.col("incomplete")).alias("incomplete"))
    status = F.when(F.col("conflicts") > 0, "conflict").when(F.col("incomplete"), "incomplete").otherwise("ok")
    files = files.withColumns({"status": status, "kept": F.when(F.col("conflicts") > 0, 0).otherwise(F.col("ok")).cast("long")})
    bad = rows.where("outcome = 'conflict'").select("file_path").distinct()
    return rows.where("outcome = 'ok'").join(bad, "file_path", "left_anti"), files


def vals_equal(a, b, tol: float | None = TOL) -> Column:
    """Equal when both are NULL or, for numbers, within the tolerance."""
    if tol is None:
        return c(a).eqNullSafe(c(b))
    return F.when(c(a).isNull() | c(b).isNull(), c(a).isNull() & c(b).isNull()).otherwise(F.abs(c(a) - c(b)) <= tol)


def merge_facts(cur: DataFrame, new: DataFrame, key: list[str], values: list[str], numeric: tuple[str, ...] = ()) -> DataFrame:
    """Upsert by full outer join: the resulting rows with action insert, update, same or keep and old/new JSON of changes.

    Of a key that was delivered more than once the last row counts.
    """
    last = one_per_key(new.select(*key, *values, *[x for x in DELIVERY if x in new.columns and x not in key + values]), key)
    a = cur.select(*key, F.struct(*values).alias("_old"))
    b = last.select(*key, F.struct(*values).alias("_new"))
    x = a.join(b, key, "full_outer")
    same = reduce(lambda p, q: p & q, [vals_equal(F.col(f"_old.{v}"), F.col(f"_new.{v}"), TOL if v in numeric else None) for v in values])
    action = F.when(F.col("_new").isNull(), "keep").when(F.col("_old").isNull(), "insert").when(same, "same").otherwise("update")
    pick = F.when(action.isin("insert", "update"), F.col("_new")).otherwise(F.col("_old"))
    upd = action == "update"
    return x.select(*key, action.alias("action"), pick.alias("_v"), F.when(upd, F.to_json("_old")).alias("old_value"),
                    F.when(upd, F.to_json("_new")).alias("new_value")).select(*key, "action", "_v.*", "old_value", "new_value")


def _numbered(cur: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Delivered rows with their revision: numbered on from the newest stored one (``_l``) in delivery order; ``_add`` tells
    whether the content differs from the one before it, so that the row starts that revision.

    A batch holds few deliveries of a key, so the window per key stays small.
    """
    at = [x for x in DELIVERY if x in new.columns and x not in key + values]
    last = cur.groupBy(*key).agg(F.max_by(F.struct("revision", *values), "revision").alias("_l"))
    w = Window.partitionBy(*key).orderBy(*at, *values)
    x = new.join(last, key, "left").withColumn("_n", F.row_number().over(w))
    before = lambda v: F.when(F.col("_n") == 1, F.col(f"_l.{v}")).otherwise(F.lag(v).over(w))
    same = reduce(lambda p, q: p & q, [before(v).eqNullSafe(F.col(v)) for v in values])
    x = x.withColumn("_add", ((F.col("_n") == 1) & F.col("_l").isNull()) | ~same)
    number = F.coalesce(F.col("_l.revision"), F.lit(0)) + F.sum(F.col("_add").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("revision", number.cast(cur.schema["revision"].dataType))


def append_revision(cur: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows to append, numbered on from the newest revision in delivery order; content equal to the one before it is skipped."""
    at = [x for x in DELIVERY if x in new.columns and x not in key + values]
    return _numbered(cur, new, key, values).where("_add").drop("_l", "_n", "_add", *at)


def revise(cur: DataFrame, new: DataFrame, key: list[str], values: list[str], spine: DataFrame) -> DataFrame:
    """Every revision after a delivery, on two times: the period in the key, and ``available_on``, from which it is known.

    ``cur`` holds key, revision, values, published_on, available_on; ``new`` key, values, published_on, market, ingested_on.
    Corrected content becomes the next revision with its own availability: the open day after its publication or, unpublished,
    the day of its delivery. Content equal to the revision before it changes nothing, but a publication date dates that revision
    where it had none. ``action`` is insert, date or keep; before_* are the times until now, which ``revision_log`` writes down.
    Within a batch the first known date of a revision counts. Rows with a NULL in the key take no part.
    """
    x = _numbered(cur, new.dropna(subset=key), key, values)
    first = x.groupBy(*key, "revision").agg(
        F.min_by(F.struct(F.col("_add").alias("add"), *values, "market", "ingested_on"), "_n").alias("_d"),
        F.min_by("published_on", F.when(F.col("published_on").isNotNull(), F.col("_n"))).alias("_p"))
    first = next_open(first.withColumn("market", F.col("_d.market")), spine, "_p", "_avail").drop("market")
    old = cur.select(*key, "revision", F.struct(*values, "published_on", "available_on").alias("_o"))
    y = old.join(first, [*key, "revision"], "full_outer")
    insert, date = F.col("_o").isNull(), F.col("_o.published_on").isNull() & F.col("_p").isNotNull()
    return y.select(
        *key, "revision", *[F.when(insert, F.col(f"_d.{v}")).otherwise(F.col(f"_o.{v}")).alias(v) for v in values],
        F.coalesce("_o.published_on", "_p").alias("published_on"),
        F.when(date, F.col("_avail")).otherwise(F.coalesce("_o.available_on", "_d.ingested_on")).alias("available_on"),
        F.when(insert, "insert").when(date, "date").otherwise("keep").alias("action"),
        F.col("_o.published_on").alias("before_published_on"), F.col("_o.available_on").alias("before_available_on"))


def revision_log(history: DataFrame, key: list[str]) -> DataFrame:
    """Change log of ``revise``: one row for each revision that was added or dated, with old and new times as JSON."""
    times = lambda at: F.to_json(F.struct(F.col(f"{at}published_on").cast("string").alias("published_on"),
                                          F.col(f"{at}available_on").cast("string").alias("available_on")))
    dated = F.col("action") == "date"
    return history.where("action <> 'keep'").select(*key, "revision", "action", F.when(dated, times("before_")).alias("old_value"), times("").alias("new_value"))


def known_on(history: DataFrame, key: list[str], day) -> DataFrame:
    """The revision of each key that was the newest one known on a day; keys of which nothing was known are left out."""
    rest = [x for x in history.columns if x not in key]
    x = history.where(F.col("available_on") <= F.lit(day).cast("date"))
    return x.groupBy(*key).agg(F.max_by(F.struct(*rest), "revision").alias("_k")).select(*key, "_k.*")


def next_open(rows: DataFrame, spine: DataFrame, day: str, name: str = "available_on") -> DataFrame:
    """First open day after the date, searched for 40 days; without a calendar the next day. Joined on market and date."""
    s = spine.select("market", F.col("day").alias(day), F.col("next_open").alias("_n"))
    have = spine.select("market").distinct().withColumn("_have", F.lit(True))
    x = rows.join(s, ["market", day], "left").join(have, "market", "left")
    near = F.col("_n").isNotNull() & (F.datediff("_n", day) <= SEARCH_DAYS + 1)
    return x.withColumn(name, F.when(F.col("_have").isNull(), F.date_add(day, 1)).when(near, F.col("_n")).otherwise(
        F.date_add(day, SEARCH_DAYS + 1))).drop("_n", "_have")


def local_midnight_utc(day, tz) -> Column:
    return F.to_utc_timestamp(c(day).cast("timestamp"), tz)


def day_status(pairs: DataFrame, cal: DataFrame, bars: DataFrame, index: DataFrame) -> DataFrame:
    """Symbol-day: incomplete, non_trading_day, trading_with_bars, suspended or source_missing."""
    x = gate_calendar(pairs, cal)
    x = x.join(bars.select("symbol", "trade_date", F.lit(True).alias("_bar")), ["symbol", "trade_date"], "left")
    x = x.join(index.select("trade_date", F.lit(True).alias("_idx")).distinct(), "trade_date", "left")
    why = F.col("cal_reason")
    return x.withColumn("status", F.when(why.isin("calendar_missing", "outside_calendar"), "incomplete").when(why == "closed_day", "non_trading_day")
                        .when(F.col("_bar"), "trading_with_bars").when(F.col("_idx"), "suspended").otherwise("source_missing")).drop("_bar", "_idx", "cal_reason")


def calendar_conflicts(cal: DataFrame, index: DataFrame, market: str, start: str, end: str) -> DataFrame:
    """Days on which the index and the calendar disagree, over a natural-day spine."""
    spark = cal.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("trade_date"))
    x = days.join(cal.where(F.col("market") == market).select("trade_date", "is_open"), "trade_date", "left").join(
        index.select("trade_date", F.lit(True).alias("_idx")), "trade_date", "left")
    has = F.coalesce("_idx", F.lit(False))
    kind = (F.when(F.col("is_open").isNull(), "outside_calendar").when(F.col("is_open") & ~has, "open_without_index")
            .when(~F.col("is_open") & has, "closed_with_index"))
    return x.select("trade_date", kind.alias("conflict")).where("conflict is not null")


def market_day_status(days: DataFrame, cal: DataFrame) -> DataFrame:
    """Open, closed or missing for each market and day."""
    x = gate_calendar(days, cal)
    return x.withColumn("status", F.when(F.col("cal_reason").isNull(), "open").when(F.col("cal_reason") == "closed_day", "closed").otherwise("missing")).drop("cal_reason")


# --------------------------------------------------------------------------- disclosure dates

# fixed values: words that rule a title out as the first disclosure, and the word of an abstract
EXCLUDE_WORDS = ("英文", "修订", "更正", "更新", "问询", "回复", "说明会", "审核")
ABSTRACT_WORD = "摘要"


def title_keys(reports: DataFrame) -> DataFrame:
    """Title phrases under which each report's disclosure is looked for."""
    fy, md = F.col("fiscal_year").cast("string"), F.date_format("period_end", "MM-dd")
    say = lambda *parts: F.array(*[F.concat(fy, F.lit(p)) for p in parts])
    t = F.col("period_type")
    keys = (F.when((t == "annual") & (md == "12-31"), say("年年度报告", "年度报告")).when((t == "interim") & (md == "06-30"), say("年半年度报告"))
            .when((t == "quarterly") & (md == "03-31"), say("年第一季度报告", "年一季度报告"))
            .when((t == "quarterly") & (md == "09-30"), say("年第三季度报告", "年三季度报告")))
    return reports.withColumn("_keys", keys)


def match_disclosures(reports: DataFrame, anns: DataFrame) -> DataFrame:
    """First disclosure of each report: full text before abstract, earliest date; NULL when nothing matches.

    Titles name their fiscal year, so the join runs on symbol and that year and fans out to one year's titles only.
    """
    clean = anns.where(~F.col("title").rlike("|".join(EXCLUDE_WORDS)))
    clean = clean.withColumn("_fy", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit(r"(\d{4})年"), F.lit(1)))))
    rep = title_keys(reports).withColumn("_fy", F.col("fiscal_year").cast("string"))
    hit = rep.join(clean.select("symbol", "_fy", "title", "ann_date"), ["symbol", "_fy"]).where(
        F.exists("_keys", lambda k: F.contains(F.col("title"), k)))
    tier = F.when(F.contains(F.col("title"), F.lit(ABSTRACT_WORD)), "abstract").otherwise("full")
    key = ["symbol", "period_end", "period_type"]
    best = hit.groupBy(*key).agg(F.min_by(F.struct("ann_date", "title", tier.alias("tier")), F.struct(
        F.when(tier == "full", 0).otherwise(1), "ann_date", "title")).alias("b"))
    return reports.join(best, key, "left").select(*reports.columns, F.col("b.ann_date").alias("disclosed_on"), F.col("b.tier").alias("tier"),
                                                  F.col("b.title").alias("disclosure_title"))


def backfill_pit(reports: DataFrame, anns: DataFrame, spine: DataFrame) -> DataFrame:
    """Publication and availability from the matched disclosure; unmatched reports keep theirs."""
    m = next_open(match_disclosures(reports, anns).withColumn("market", F.lit("CN")), spine, "disclosed_on", "_avail")
    hit = F.col("disclosed_on").isNotNull()
    return m.withColumns({
        "new_published_at": F.when(hit, local_midnight_utc("disclosed_on", "Asia/Shanghai")),
        "new_available_on": F.when(hit, F.col("_avail")).otherwise(F.col("available_date")), "matched": hit}).drop("_avail", "market")


def pit_revisions(filled: DataFrame) -> DataFrame:
    """Revision rows of ``backfill_pit``: old and new publication and availability of every report whose times changed, as JSON,
    with the title and tier that they come from. A repeated run changes nothing and so logs nothing."""
    moved = ~F.col("new_published_at").eqNullSafe(F.col("published_at")) | ~F.col("new_available_on").eqNullSafe(F.col("available_date"))
    say = lambda at, on, *more: F.to_json(F.struct(F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("published_at"),
                                                   F.col(on).cast("string").alias("available_on"), *more))
    return filled.where(F.col("matched") & moved).select(
        "symbol", "period_end", "period_type", say("published_at", "available_date").alias("old_value"),
        say("new_published_at", "new_available_on", F.col("disclosure_title").alias("title"), "tier").alias("new_value"))
