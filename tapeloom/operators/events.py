"""Event study, scope and links of messages, reviews, labels, due items."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.functions.columns import occurrences

# fixed values: keywords that decide the scope of a message
MACRO_WORDS = ("降准", "降息", "加息", "MLF", "LPR", "逆回购", "存款准备金", "美联储", "FOMC", "CPI", "PPI", "社融", "汇率", "国债")
POLICY_WORDS = ("发改委", "财政部", "央行", "证监会", "国资委", "工信部", "商务部", "住建部", "国务院", "集采", "征税", "关税")
# fixed values: label enumerations and the review gate
SCOPES = ("macro", "policy", "industry", "company", "flow")
DIRECTIONS = ("positive", "negative", "neutral")
MATERIALITIES = ("low", "medium", "high", "critical")
TARGETS = ("eps", "pe", "sentiment")
HALF_LIVES = ("day", "week", "month", "quarter")
HINTS = ("none", "swing", "schedule", "redraw_anchor")
BANNED_WORDS = ("必涨", "必跌", "建议买入", "建议卖出", "目标价", "涨停", "抄底", "逃顶")
HIGH_MATERIALITY = ("high", "critical")
LOW_CONFIDENCE = 0.4
COMPANY_TIER_MAX = 2
DIRECTION_CN = {"positive": "利好", "negative": "利空", "neutral": "中性"}
MATERIALITY_CN = {"low": "轻微", "medium": "一般", "high": "重大", "critical": "关键"}
STATUS_CN = {"ok": "已过审", "needs_review": "待人审"}
EVENT_LEVEL = "__event__"


# --------------------------------------------------------------------------- event study

def event_days(events: DataFrame, spine: DataFrame, cal: DataFrame, ks=(1, 5)) -> DataFrame:
    """Base day (last open day before A) and T+k (k-th open day from A on), by calendar ordinals.

    Works on the distinct days of the events; a day outside the spine lies outside the calendar.
    """
    ords = cal.where("is_open").select("td_ord", F.col("trade_date").alias("d"))
    span = cal.where("is_open").agg(F.struct(F.min("trade_date").alias("lo"), F.count("*").alias("n"))).scalar()
    days = events.select("a_date").distinct().join(spine.select(F.col("day").alias("a_date"), "open_before"), "a_date", "left")
    days = days.withColumn("o", F.coalesce("open_before", F.when(F.col("a_date") < span["lo"], 0).otherwise(span["n"])))
    out = days.select("a_date", F.col("o").alias("td_ord")).join(ords.withColumnRenamed("d", "base_date"), "td_ord", "left").withColumnRenamed("td_ord", "o")
    for k in ks:
        out = out.withColumn("td_ord", F.col("o") + k).join(ords.withColumnRenamed("d", f"t{k}_date"), "td_ord", "left").drop("td_ord")
    return out.drop("o")


def event_study(events: DataFrame, bars: DataFrame, index: DataFrame, spine: DataFrame, cal: DataFrame) -> DataFrame:
    """T+1/T+5 return, benchmark return and excess per event.

    The study depends on (symbol, day) only, so it runs on the distinct pairs and events pick theirs; a
    symbol with a third of all events adds at most one pair per day.
    """
    pairs = events.select("symbol", "a_date").distinct().join(event_days(events, spine, cal), "a_date")
    close = bars.where("close_raw is not null").select(
        "symbol", "trade_date", (F.col("close_raw") * F.coalesce(F.nullif("price_adj_factor", F.lit(0.0)), F.lit(1.0))).alias("c"))
    idx = index.where("close is not null").select("trade_date", F.col("close").alias("b"))
    last = close.groupBy("symbol").agg(F.max("trade_date").alias("_s")).select(
        "symbol", F.least("_s", idx.agg(F.max("trade_date")).scalar()).alias("cutoff"))
    x = pairs.join(last, "symbol", "left")
    for p in ("base", "t1", "t5"):
        x = x.join(close.select("symbol", F.col("trade_date").alias(f"{p}_date"), F.col("c").alias(f"{p}_close")), ["symbol", f"{p}_date"], "left")
        x = x.join(idx.select(F.col("trade_date").alias(f"{p}_date"), F.col("b").alias(f"{p}_bench")), f"{p}_date", "left")
    early = (F.when(F.col("base_date").isNull(), "no_base_date").when(F.col("base_close").isNull(), "base_no_bar")
             .when(F.col("base_bench").isNull(), "bench_base_missing"))
    x = x.withColumn("_early", early)
    cols = {}
    for p in ("t1", "t5"):
        pend = F.col(f"{p}_date").isNull() | F.coalesce(F.col(f"{p}_date") > F.col("cutoff"), F.lit(False))
        mark = F.when(F.col("_early").isNull(), F.when(pend, "pending").when(F.col(f"{p}_close").isNull(), "suspended"))
        live = F.col("_early").isNull() & mark.isNull()
        ret = F.col(f"{p}_close") / F.col("base_close") - 1.0
        bench = F.col(f"{p}_bench") / F.col("base_bench") - 1.0
        cols.update({f"{p}_mark": mark, f"{p}_ret": F.when(live, ret), f"{p}_bench_ret": F.when(live, bench),
                     f"{p}_excess": F.when(live, ret - bench), f"_{p}_hole": live & F.col(f"{p}_bench").isNull()})
    x = x.withColumns(cols).withColumn("reason", F.coalesce(
        "_early", F.when(F.col("_t5_hole"), "bench_missing_t5").when(F.col("_t1_hole"), "bench_missing_t1")))
    x = x.withColumn("status", study_status()).select(
        "symbol", "a_date", "base_date", "cutoff", *[f"{p}_{k}" for p in ("t1", "t5") for k in ("mark", "ret", "bench_ret", "excess")], "reason", "status")
    return events.join(x, ["symbol", "a_date"], "left")


def study_status() -> Column:
    """Degraded before suspended before ok; pending alone is no fault."""
    stopped = (F.coalesce(F.col("t1_mark"), F.lit("")) == "suspended") | (F.coalesce(F.col("t5_mark"), F.lit("")) == "suspended")
    return F.when(F.col("reason").isNotNull(), "degraded").when(stopped, "suspended").otherwise("ok")


def has_pending() -> Column:
    return (F.coalesce(F.col("t1_mark"), F.lit("")) == "pending") | (F.coalesce(F.col("t5_mark"), F.lit("")) == "pending")


def merge_studies(events: DataFrame, old: DataFrame, study) -> DataFrame:
    """Keep finished rows; study the rest again. ``study`` computes events, only unfinished ones are passed to it."""
    done = old.where(F.col("status").isin("ok", "suspended") & ~has_pending())
    todo = events.join(done.select("event_id", "symbol"), ["event_id", "symbol"], "left_anti")
    again = study(todo).join(old.select("event_id", "symbol", F.lit(True).alias("_old")), ["event_id", "symbol"], "left")
    again = again.withColumn("action", F.when(F.col("_old"), "recomputed").otherwise("new")).drop("_old")
    return done.withColumn("action", F.lit("kept")).unionByName(again, allowMissingColumns=True)


# --------------------------------------------------------------------------- scope and links

def any_word(words) -> str:
    return "|".join(words)


def message_text() -> Column:
    return F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")))


def classify_scope(news: DataFrame) -> DataFrame:
    """Flow and company by type, then macro words, then policy words, else unknown. A scope that is stored already stays."""
    text = message_text()
    told = (F.when(F.col("event_type") == "flow", "flow").when(F.col("event_type") == "announcement", "company")
                           .when(text.rlike(any_word(MACRO_WORDS)), "macro").when(text.rlike(any_word(POLICY_WORDS)), "policy"))
    return news.withColumn("scope", F.coalesce(F.nullif("scope", F.lit("")), told) if "scope" in news.columns else told)


def link_events(news: DataFrame, watch: DataFrame, industry: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """Symbols whose theme or industry a macro, policy or industry message names, besides links that exist already."""
    texts = news.where(F.col("scope").isin("industry", "policy", "macro")).select("event_id", message_text().alias("text"))
    live = watch.where("active")
    themes = live.select("symbol", F.explode("themes").alias("term"))
    names = industry.join(live.select("symbol"), "symbol", "left_semi").select("symbol", F.col("industry_name").alias("term"))
    terms = themes.unionByName(names).where("term <> ''").distinct()
    hits = occurrences(texts, terms, not_before="周节").join(terms, "term").select("event_id", "symbol").distinct()
    return hits if linked is None else linked.select("event_id", "symbol").union(hits).distinct()


# --------------------------------------------------------------------------- reviews and labels

def _last(col: str, cond: Column | None = None) -> Column:
    """Latest non-null value by review time, as a mergeable aggregate."""
    value = F.col(col) if cond is None else F.when(cond, F.col(col))
    return F.max_by(value, F.when(value.isNotNull(), F.struct("reviewed_at", "review_id")))


def replay_reviews(reviews: DataFrame) -> DataFrame:
    """Per event and symbol: the outcome of all reviews in time order, without sorting them."""
    x = reviews.withColumns({
        "_hide": F.when(F.col("action") == "dismiss", True).when(F.col("action") == "confirm", False),
        "_ok": F.when(F.col("action") == "confirm", "ok"),
        "_mat": F.when(F.col("action") == "upgrade_materiality", F.nullif("materiality", F.lit("")))})
    amend = F.col("action") == "amend"
    return x.groupBy("event_id", "symbol").agg(
        _last("_hide").alias("hide"), _last("_ok").alias("ok"), _last("_mat").alias("mat"),
        _last("expectation_gap", amend).alias("gap"), _last("falsification", amend).alias("fals"),
        _last("target", amend).alias("tgt"), _last("half_life", amend).alias("half"))


def effective_state(links: DataFrame, assessments: DataFrame, reviews: DataFrame) -> DataFrame:
    """Shown state of events and of their symbols: label, then event reviews, then the symbol's own reviews."""
    rep = replay_reviews(reviews)
    ev = rep.where(F.col("symbol") == EVENT_LEVEL).drop("symbol")
    keys = links.select("event_id").union(assessments.select("event_id")).distinct()
    lab = assessments.select("event_id", "status", "direction", "materiality", "confidence", "rationale", "target", "half_life", "expectation_gap")
    base = keys.join(lab, "event_id", "left").join(ev, "event_id", "left").select(
        "event_id", F.coalesce("hide", F.lit(False)).alias("hidden"), F.coalesce("ok", "status").alias("status"), "direction",
        F.coalesce("mat", "materiality").alias("materiality"), "confidence", "rationale", F.coalesce("tgt", "target").alias("target"),
        F.coalesce("half", "half_life").alias("half_life"), F.coalesce("gap", "expectation_gap").alias("expectation_gap"),
        F.col("fals").alias("falsification"))
    own = rep.where(F.col("symbol") != EVENT_LEVEL)
    per = links.select("event_id", "symbol").distinct().join(base, "event_id").join(own, ["event_id", "symbol"], "left").select(
        "event_id", "symbol", F.coalesce("hide", "hidden").alias("hidden"), F.coalesce("ok", "status").alias("status"), "direction",
        F.coalesce("mat", "materiality").alias("materiality"), "confidence", "rationale", F.coalesce("tgt", "target").alias("target"),
        F.coalesce("half", "half_life").alias("half_life"), F.coalesce("gap", "expectation_gap").alias("expectation_gap"),
        F.coalesce("fals", "falsification").alias("falsification"))
    return base.withColumn("symbol", F.lit(EVENT_LEVEL)).unionByName(per)


def label_candidates(events: DataFrame, assessed: DataFrame, links: DataFrame, macro: DataFrame, as_of: str, n: int,
                     symbol: str | None = None, start: str | None = None) -> DataFrame:
    """Newest unassessed messages with their symbols and the market-wide macro lines."""
    x = events.where(F.col("event_type").isin("announcement", "news") & (F.to_date("available_at") <= F.lit(as_of).cast("date")))
    if start is not None:
        x = x.where(F.to_date("available_at") >= F.lit(start).cast("date"))
    x = x.join(assessed.select("event_id"), "event_id", "left_anti")
    if symbol is not None:
        x = x.join(links.where(F.col("symbol") == symbol), "event_id", "left_semi")
    x = x.orderBy(F.col("published_at").desc(), F.col("event_id").desc()).limit(n)
    syms = links.join(x.select("event_id"), "event_id", "left_semi").groupBy("event_id").agg(
        F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("linked_symbols"))
    last = macro.where(F.col("trade_date") <= F.lit(as_of).cast("date")).groupBy("code").agg(F.max_by(F.struct("trade_date", "close"), "trade_date").alias("m"))
    line = F.concat("code", F.lit(" "), F.format_string("%.4f", F.col("m.close").cast("double")), F.lit("（"), F.col("m.trade_date").cast("string"), F.lit("）"))
    context = last.agg(F.array_join(F.array_sort(F.collect_list(line)), ";")).scalar()
    return x.join(syms, "event_id", "left").withColumn("macro_context", context)


def write_candidates(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


TAG = ("struct<event_id:bigint,scope:string,direction:string,materiality:string,confidence:string,target:string,half_life:string,"
       "expectation_gap:string,action_hint:string,falsification_suggestion:string,rationale:string>")


def gate_labels(tags: DataFrame, events: DataFrame, assessed: DataFrame) -> DataFrame:
    """Validate label rows and decide which need a person: rejected, skipped, needs_review or ok."""
    x = tags.withColumn("t", F.from_json("tag_json", TAG)).withColumn("event_id", F.col("t.event_id"))
    ev = events.select("event_id", "source_tier", F.lit(True).alias("_known"))
    x = x.join(ev, "event_id", "left").join(assessed.select("event_id", F.lit(True).alias("_done")).distinct(), "event_id", "left")
    text = F.col("tag_json").rlike('"confidence"\\s*:\\s*"')
    num = F.regexp_replace(F.trim("t.confidence"), "%", "").try_cast("double")
    conf = F.when(text & (num > 1), num / 100).otherwise(num)
    opt = lambda k, vals: F.col(f"t.{k}").isNull() | F.col(f"t.{k}").isin(*vals)
    short = lambda k, n: F.col(f"t.{k}").isNull() | (F.length(f"t.{k}") <= n)
    valid = F.coalesce(
        F.col("t.scope").isin(*SCOPES) & F.col("t.direction").isin(*DIRECTIONS) & F.col("t.materiality").isin(*MATERIALITIES)
        & F.col("t.action_hint").isin(*HINTS) & conf.between(0, 1) & F.length("t.rationale").between(1, 300)
        & opt("target", TARGETS) & opt("half_life", HALF_LIVES) & short("expectation_gap", 200) & short("falsification_suggestion", 200), F.lit(False))
    review = (F.col("t.materiality").isin(*HIGH_MATERIALITY) | (conf < LOW_CONFIDENCE) | F.col("t.rationale").rlike(any_word(BANNED_WORDS))
              | ((F.col("t.scope") == "company") & F.coalesce(F.col("source_tier") <= COMPANY_TIER_MAX, F.lit(False))))
    outcome = (F.when(F.col("_known").isNull(), "rejected").when(F.col("_done"), "skipped").when(~valid, "rejected")
               .when(review, "needs_review").otherwise("ok"))
    return x.select("event_id", F.when(outcome.isin("ok", "needs_review"), conf).alias("confidence"), outcome.alias("outcome"))


def awaiting_confirm(assessments: DataFrame, reviews: DataFrame, links: DataFrame | None = None, symbol: str | None = None) -> DataFrame:
    """Labelled for review and neither confirmed nor dismissed, optionally of one symbol."""
    settled = reviews.where((F.col("symbol") == EVENT_LEVEL) & F.col("action").isin("confirm", "dismiss")).select("event_id")
    x = assessments.where("status = 'needs_review'").select("event_id").distinct().join(settled, "event_id", "left_anti")
    return x if symbol is None else x.join(links.where(F.col("symbol") == symbol).select("event_id"), "event_id", "left_semi")


def text_map(col: Column, mapping: dict[str, str], missing: str) -> Column:
    """Display text of an enumeration; unknown values stay as they are."""
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.when(col.isNull(), missing).otherwise(F.coalesce(m[col], col))


def review_list(state: DataFrame, links: DataFrame, names: DataFrame, pool: DataFrame) -> DataFrame:
    """Events with their shown state, display texts and symbols with names; pool names win over the directory."""
    directory = names.select("symbol", F.col("name").alias("_n")).join(pool.select("symbol", F.col("name").alias("_p")), "symbol", "full_outer").select(
        "symbol", F.coalesce("_p", "_n").alias("name"))
    label = F.when(F.col("name").isNotNull(), F.concat_ws(" ", "symbol", "name")).otherwise(F.col("symbol"))
    syms = links.select("event_id", "symbol").distinct().join(directory, "symbol", "left").groupBy("event_id").agg(
        F.array_join(F.array_sort(F.collect_list(label)), ";").alias("symbols_label"))
    x = state.where(F.col("symbol") == EVENT_LEVEL).join(syms, "event_id", "left")
    return x.select("event_id", "hidden", "status", text_map(F.col("status"), STATUS_CN, "").alias("status_cn"),
                    text_map(F.col("direction"), DIRECTION_CN, "").alias("direction_cn"),
                    text_map(F.col("materiality"), MATERIALITY_CN, "").alias("materiality_cn"), "symbols_label")


def event_summary(events: DataFrame, assessed: DataFrame, calendar: DataFrame, as_of: str, n: int = 10) -> DataFrame:
    """Per symbol: the last n messages, how many are unassessed, and what is due within 30 days."""
    day = F.lit(as_of).cast("date")
    x = events.where(F.to_date("available_at") <= day)
    w = Window.partitionBy("symbol").orderBy(F.col("available_at").desc(), F.col("event_id").desc())
    top = x.select("symbol", "event_id", "event_type", "available_at").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    pend = x.where(F.col("event_type").isin("announcement", "news")).join(assessed.select("event_id"), "event_id", "left_anti").groupBy("symbol").agg(
        F.count("*").alias("pending"))
    soon = calendar.where(F.col("scheduled_date").between(day, F.date_add(day, 30)))
    own = soon.where("symbol is not null").groupBy("symbol").agg(F.count("*").alias("own_due"))
    wide = soon.where("symbol is null").agg(F.count("*")).scalar()
    zero = F.lit(0).cast("long")
    return top.join(pend, "symbol", "left").join(own, "symbol", "left").select(
        "symbol", "rank", "event_id", "event_type", F.coalesce("pending", zero).alias("pending"),
        (F.coalesce("own_due", zero) + wide).alias("upcoming"))


def due_items(calendar: DataFrame, cards: DataFrame, as_of: str, symbol: str | None = None) -> DataFrame:
    """Calendar rows inside their own reminder window, and active cards whose review is due."""
    day = F.lit(as_of).cast("date")
    cal = calendar.where((F.col("scheduled_date") >= day) & (F.col("scheduled_date") <= F.date_add(day, F.col("remind_before_days")))).select(
        "kind", "symbol", F.col("scheduled_date").alias("due_date"), "note")
    rev = cards.where((F.col("status") == "active") & (F.col("next_review_at") <= day)).select(
        F.lit("card_review").alias("kind"), "symbol", F.col("next_review_at").alias("due_date"), F.col("card_version_id").alias("note"))
    out = cal.unionByName(rev)
    if symbol is not None:
        out = out.where((F.col("symbol") == symbol) | (F.col("symbol").isNull() & (F.col("kind") != "card_review")))
    return out
