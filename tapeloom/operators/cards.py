"""Strategy cards: parsing, effective windows, mechanical conversion, guards, version rolls, input checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.functions.columns import dec
from tapeloom.operators.timeops import asof
from tapeloom.params import FASTLANE_PCT

PRICE = "decimal(18,4)"
BOX_KEYS = ("box_low", "box_high", "buy_zone_low", "buy_zone_high", "sell_zone_low", "sell_zone_high", "box_invalidation")
# fixed values: metrics a card may anchor to, and the price pattern of its input document
ANCHOR_METRICS = ("pe_scale", "pe_static_scale", "pb", "ps", "price_band", "mixed")
PRICE_PATTERN = r"^-?\d+(\.\d{1,4})?$"

TIERS_JSON = "struct<tiers:array<struct<tier:int,zone_low:string,zone_high:string>>>"
BOX_JSON = "struct<" + ",".join(f"{k}:string" for k in BOX_KEYS) + ">"
RIGHT_JSON = "struct<trigger_level:string,stop_level:string>"


def _good(price: Column) -> Column:
    """Readable and not negative."""
    return F.coalesce(price.try_cast(PRICE) >= 0, F.lit(False))


def parse_cards(docs: DataFrame) -> DataFrame:
    """JSON documents to typed columns; versions with an unreadable, missing or negative price are dropped."""
    x = docs.withColumns({
        "_t": F.from_json("price_tiers_json", TIERS_JSON), "_i": F.from_json("invalidation_json", "struct<line:string>"),
        "_b": F.from_json("swing_box_json", BOX_JSON), "_r": F.from_json("right_side_trigger_json", RIGHT_JSON)})
    tiers_ok = F.col("price_tiers_json").isNull() | (F.coalesce(F.size("_t.tiers") > 0, F.lit(False)) & F.coalesce(F.forall(
        "_t.tiers", lambda t: t["tier"].isNotNull() & _good(t["zone_low"]) & _good(t["zone_high"])), F.lit(False)))
    line_ok = F.col("invalidation_json").isNull() | _good(F.col("_i.line"))
    opt = lambda p: p.isNull() | _good(p)
    box_ok = F.lit(True)
    for k in BOX_KEYS:
        box_ok = box_ok & opt(F.col(f"_b.{k}"))
    box_ok = F.col("swing_box_json").isNull() | (F.col("_b").isNotNull() & box_ok)
    right_ok = F.col("right_side_trigger_json").isNull() | (
        F.col("_r").isNotNull() & opt(F.col("_r.trigger_level")) & opt(F.col("_r.stop_level")))
    cast = lambda p: p.try_cast(PRICE)
    return x.where(tiers_ok & line_ok & box_ok & right_ok).select(
        "symbol", "card_version_id", "status", "effective_from", "effective_to", "supersedes_id", "next_review_at",
        F.transform("_t.tiers", lambda t: F.struct(t["tier"].alias("tier"), cast(t["zone_low"]).alias("zone_low"),
                                                   cast(t["zone_high"]).alias("zone_high"))).alias("tiers"),
        cast(F.col("_i.line")).alias("invalidation_line"),
        F.when(F.col("_b").isNotNull(), F.struct(*[cast(F.col(f"_b.{k}")).alias(k) for k in BOX_KEYS])).alias("box"),
        cast(F.col("_r.trigger_level")).alias("trigger_level"), cast(F.col("_r.stop_level")).alias("stop_level"))


def cards_asof(bars: DataFrame, cards: DataFrame) -> DataFrame:
    """Card whose window [from, to) covers the day; of several the one that starts first.

    Versions per symbol are few (one per review), so the join fans a bar out to its covering versions only.
    """
    live = cards.where(F.col("status").isin("active", "superseded") & F.col("effective_from").isNotNull())
    on = ((F.col("b.symbol") == F.col("c.symbol")) & (F.col("b.trade_date") >= F.col("c.effective_from"))
          & (F.col("c.effective_to").isNull() | (F.col("b.trade_date") < F.col("c.effective_to"))))
    cols = [c for c in cards.columns if c != "symbol"]
    x = bars.alias("b").join(live.alias("c"), on).select("b.*", *[F.col(f"c.{c}") for c in cols])
    first = Window.partitionBy("symbol", "trade_date").orderBy("effective_from", "card_version_id")
    return x.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


# --------------------------------------------------------------------------- corporate actions

def open_freezes(freezes: DataFrame, rescinded: DataFrame, absorbed: DataFrame) -> DataFrame:
    """Freezes neither rescinded nor absorbed by an active card."""
    return freezes.join(rescinded.select("symbol", "ca_id"), ["symbol", "ca_id"], "left_anti").join(
        absorbed.select("symbol", "ca_id"), ["symbol", "ca_id"], "left_anti")


def pending_actions(actions: DataFrame, cards: DataFrame, handled: DataFrame, as_of) -> DataFrame:
    """Actions from the active card's start up to ``as_of`` that nothing has handled yet."""
    act = cards.where("status = 'active' and effective_from is not null").select("symbol", "effective_from", "card_version_id")
    return actions.join(act, "symbol").where((F.col("ex_date") >= F.col("effective_from")) & (F.col("ex_date") <= as_of)).join(
        handled.select("symbol", "ca_id"), ["symbol", "ca_id"], "left_anti")


def classify_actions(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """Small cash dividends (below 2 % of the close before the ex-date) convert at once; all else goes three steps."""
    x = asof(actions, bars, ["symbol"], "ex_date", "trade_date", [F.col("close_raw").alias("prev_close")], strict=True)
    x = x.withColumn("impact", dec("cash_per_share") / F.nullif(dec("prev_close"), F.lit(0)))
    fast = (F.col("action_type") == "cash_dividend") & (F.col("impact") < F.lit(FASTLANE_PCT).cast("decimal(4,2)"))
    return x.withColumn("channel", F.when(F.coalesce(fast, F.lit(False)), "fastlane").otherwise("three_step"))


def conversion(x: DataFrame) -> tuple[Column, Column]:
    """Multiplier and subtrahend of an action: 1/ratio for splits, cash for dividends."""
    split = F.col("split_ratio").isNotNull() & F.col("action_type").isin("split", "bonus_share")
    mul = F.when(split, (F.lit(1).cast("decimal(20,10)") / F.col("split_ratio").cast("decimal(20,10)")).cast("decimal(20,10)")).otherwise(
        F.lit(1).cast("decimal(20,10)"))
    sub = F.when(split, F.lit(0).cast(PRICE)).otherwise(F.col("cash_per_share").cast(PRICE))
    return mul, sub


def convert(price: Column, mul: Column, sub: Column) -> Column:
    """New price, half-up to four places."""
    return F.round(price * mul - sub, 4).cast(PRICE)


def convert_cards(x: DataFrame) -> DataFrame:
    """Apply each row's action to its card columns (tiers, line, box, trigger and stop)."""
    mul, sub = conversion(x)
    x = x.withColumns({"_m": mul, "_s": sub})
    f = lambda p: convert(p, F.col("_m"), F.col("_s"))
    tier = lambda t: F.struct(t["tier"].alias("tier"), f(t["zone_low"]).alias("zone_low"), f(t["zone_high"]).alias("zone_high"))
    cols = {"tiers": F.transform("tiers", tier),
            "box": F.when(F.col("box").isNotNull(), F.struct(*[f(F.col(f"box.{k}")).alias(k) for k in BOX_KEYS]))}
    cols.update({k: f(F.col(k)) for k in ("invalidation_line", "trigger_level", "stop_level")})
    if "eps" in x.columns:
        cols["eps"] = F.transform_values("eps", lambda k, v: F.round(v * F.col("_m"), 4).cast(PRICE))
    return x.withColumns(cols).drop("_m", "_s")


def conversion_errors() -> Column:
    """Guard on converted prices: positive, zones ordered, tiers falling without overlap. Empty means accepted."""
    pos = lambda p, name: F.when(p <= 0, F.lit(name))
    tiers = F.coalesce("tiers", F.array().cast(f"array<struct<tier:int,zone_low:{PRICE},zone_high:{PRICE}>>"))
    bad_tier = F.exists(tiers, lambda t: (t["zone_low"] <= 0) | (t["zone_high"] <= 0))
    bad_zone = F.exists(tiers, lambda t: t["zone_low"] >= t["zone_high"])
    n = F.size(tiers)
    pairs = F.when(n >= 2, F.zip_with(F.slice(tiers, 1, n - 1), F.slice(tiers, 2, n - 1),
                                      lambda a, b: b["zone_high"] >= a["zone_low"])).otherwise(F.array().cast("array<boolean>"))
    box = [pos(F.col(f"box.{k}"), f"{k}_not_positive") for k in BOX_KEYS]
    order = [F.when(F.col(f"box.{a}") >= F.col(f"box.{b}"), F.lit(f"{a}_ge_{b}"))
             for a, b in (("box_low", "box_high"), ("buy_zone_low", "buy_zone_high"), ("sell_zone_low", "sell_zone_high"))]
    return F.array_compact(F.array(
        F.when(bad_tier, "tier_not_positive"), F.when(bad_zone, "tier_zone_order"),
        F.when(F.exists(pairs, lambda v: v), "tiers_overlap"), pos(F.col("invalidation_line"), "line_not_positive"), *box, *order,
        pos(F.col("trigger_level"), "trigger_not_positive"), pos(F.col("stop_level"), "stop_not_positive")))


def lowest_price() -> Column:
    """Smallest price of a card: a subtraction keeps the order of zones, so it is accepted while this stays positive."""
    return F.least(F.array_min(F.transform("tiers", lambda t: F.least(t["zone_low"], t["zone_high"]))), F.col("invalidation_line"),
                   F.col("trigger_level"), F.col("stop_level"), *[F.col(f"box.{k}") for k in BOX_KEYS])


def roll_versions(cards: DataFrame, pending: DataFrame) -> DataFrame:
    """Walk a card's pending small dividends by ex-date; each accepted one closes the version before it.

    Subtractions add up, so the fold only carries the accepted sum and the list of accepted steps; a step
    that would push a price to zero is refused and leaves the card as it is. Larger dividends and splits
    leave drafts of the version of that moment. A card's pending actions are few: at most one per day and type.
    Every price of a version follows: all tiers, line, box, trigger and stop; earnings per share (``eps``, a map) only splits.
    """
    step = f"struct<ex_date:date,ca_id:string,cash:{PRICE},channel:string,mul:decimal(20,10)>"
    mul, _ = conversion(pending)
    steps = pending.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(
        "ex_date", "ca_id", F.col("cash_per_share").cast(PRICE).alias("cash"), "channel", mul.alias("mul")))).alias("steps"))
    x = cards.where("status = 'active'").withColumn("_low", lowest_price()).join(steps, "symbol", "left")
    row = f"struct<ca_id:string,ex_date:date,kind:string,total:{PRICE},mul:decimal(20,10)>"
    start = F.struct(F.lit(0).cast(PRICE).alias("total"), F.array().cast(f"array<{row}>").alias("rows"))

    def fold(acc, s):
        total = F.when(s["channel"] == "fastlane", acc["total"] + s["cash"]).otherwise(acc["total"]).cast(PRICE)
        fast_ok = (s["channel"] == "fastlane") & (F.col("_low") - total > 0)
        cash = F.coalesce(s["cash"], F.lit(0).cast(PRICE))
        draft_low = (F.col("_low") - acc["total"]) * s["mul"] - F.when(s["mul"] == 1, cash).otherwise(F.lit(0).cast(PRICE))
        draft_ok = (s["channel"] != "fastlane") & (F.round(draft_low, 4) > 0)
        kind = F.when(fast_ok, "version").when(draft_ok, "draft").otherwise("refused")
        out = F.struct(s["ca_id"].alias("ca_id"), s["ex_date"].alias("ex_date"), kind.alias("kind"),
                       F.when(fast_ok, total).otherwise(F.when(draft_ok & (s["mul"] == 1), acc["total"] + cash).otherwise(
                           acc["total"])).cast(PRICE).alias("total"), s["mul"].alias("mul"))
        return F.struct(F.when(fast_ok, total).otherwise(acc["total"]).cast(PRICE).alias("total"),
                        F.concat(acc["rows"], F.array(out)).alias("rows"))
    steps_col = F.coalesce("steps", F.array().cast(f"array<{step}>"))
    first = F.array(F.struct(F.lit(None).cast("string").alias("ca_id"), F.col("effective_from").alias("ex_date"),
                             F.lit("version").alias("kind"), F.lit(0).cast(PRICE).alias("total"),
                             F.lit(1).cast("decimal(20,10)").alias("mul")))
    x = x.withColumn("_rows", F.concat(first, F.aggregate(steps_col, start, fold)["rows"]))
    if "eps" not in x.columns:
        x = x.withColumn("eps", F.lit(None).cast(f"map<string,{PRICE}>"))
    x = x.select("symbol", "card_version_id", "tiers", "box", "eps", "invalidation_line", "trigger_level", "stop_level", F.posexplode("_rows").alias("seq", "s"))
    w = Window.partitionBy("symbol", "s.kind").orderBy("seq")
    nxt = F.when(F.col("s.kind") == "version", F.lead("s.ex_date").over(w))
    f = lambda p: F.round((p - F.col("s.total")) * F.col("s.mul"), 4).cast(PRICE)
    made = lambda new: F.when(F.col("s.kind") != "refused", new)
    tier = lambda t: F.struct(t["tier"].alias("tier"), f(t["zone_low"]).alias("zone_low"), f(t["zone_high"]).alias("zone_high"))
    return x.select(
        "symbol", "seq", "s.ca_id", "s.kind",
        F.when(F.col("s.kind") == "version", F.when(nxt.isNull(), "active").otherwise("superseded")).otherwise(F.col("s.kind")).alias("status"),
        F.when(F.col("s.kind") == "version", F.col("s.ex_date")).alias("effective_from"), nxt.alias("effective_to"),
        made(F.transform("tiers", tier)).alias("tiers"), made(F.when(F.col("box").isNotNull(), F.struct(*[f(F.col(f"box.{k}")).alias(k) for k in BOX_KEYS]))).alias("box"),
        made(F.transform_values("eps", lambda k, v: F.round(v * F.col("s.mul"), 4).cast(PRICE))).alias("eps"),
        *[made(f(F.col(k))).alias(k) for k in ("invalidation_line", "trigger_level", "stop_level")])


INPUT_SCHEMA = ("struct<currency:string,price_tiers:struct<tiers:array<struct<tier:int,zone_low:string,zone_high:string>>>,"
                "swing_box:" + BOX_JSON + ",invalidation:struct<line:string>,valuation:struct<anchor:struct<metric:string>>>")


def check_cards(docs: DataFrame, doc: str = "doc_json") -> DataFrame:
    """Errors of card input documents; a document that breaks the schema reports that alone."""
    x = docs.withColumn("d", F.from_json(doc, INPUT_SCHEMA))
    tiers = F.coalesce("d.price_tiers.tiers", F.array().cast("array<struct<tier:int,zone_low:string,zone_high:string>>"))
    price_ok = lambda p: p.rlike(PRICE_PATTERN)
    opt = lambda p: p.isNull() | price_ok(p)
    shape = F.col("d").isNotNull() & F.forall(tiers, lambda t: F.coalesce(
        t["tier"].between(1, 3) & price_ok(t["zone_low"]) & price_ok(t["zone_high"]), F.lit(False)))
    shape = shape & (F.col("d.price_tiers").isNull() | (F.size(tiers) > 0))
    shape = shape & (F.col("d.invalidation").isNull() | F.coalesce(price_ok(F.col("d.invalidation.line")), F.lit(False)))
    for k in BOX_KEYS:
        shape = shape & opt(F.col(f"d.swing_box.{k}"))
    num = lambda p: p.try_cast("decimal(38,10)")
    wrong = F.transform(F.filter(tiers, lambda t: num(t["zone_low"]) > num(t["zone_high"])),
                        lambda t: F.concat(F.lit("zone_order_"), t["tier"].cast("string")))
    ids = F.transform(tiers, lambda t: t["tier"])
    dup = F.transform(F.filter(ids, lambda v, i: F.array_position(ids, v) <= i), lambda v: F.concat(F.lit("duplicate_"), v.cast("string")))
    box = F.array_compact(F.array(*[
        F.when(num(F.col(f"d.swing_box.{a}")) > num(F.col(f"d.swing_box.{b}")), F.lit(f"{a}_gt_{b}"))
        for a, b in (("box_low", "box_high"), ("buy_zone_low", "buy_zone_high"), ("sell_zone_low", "sell_zone_high"))]))
    metric = F.col("d.valuation.anchor.metric")
    anchor = F.when(F.col("d.valuation.anchor").isNotNull() & ~F.coalesce(metric.isin(*ANCHOR_METRICS), F.lit(False)),
                    F.array(F.lit("anchor_metric"))).otherwise(F.array().cast("array<string>"))
    errors = F.when(~shape, F.array(F.lit("schema"))).otherwise(F.concat(wrong, dup, box, anchor))
    return x.select(*docs.columns, F.array_join(errors, ",").alias("errors"),
                    F.col("d.valuation.anchor").isNull().alias("anchor_missing"))
