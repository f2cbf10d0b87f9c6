"""Streaming jobs driven to completion over the given tables."""
from pyspark.sql import functions as F

from tapeloom.operators import cards, daily_watch as dw, right_side as rs
from tapeloom.plans.bar_queries import rounded
from tapeloom.plans.registry import query
from tapeloom.session import cut_lineage, work_folder
from tapeloom.streaming import live


def table_stream(m, name):
    """One of the given parquet files as a file stream."""
    schema = m.table(name).schema
    return m.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(m.dir)


def to_table(m, stream, folder, mode="append"):
    live.run_available(stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out"), f"{folder}/check")
    return m.spark.read.parquet(f"{folder}/out")


@query("st1_incremental_ingest", """
select event_id, case when event_type = 'click' then round(value + 1, 2) else round(value, 2) end as value, event_type from events""")
def _(m):
    """Two deliveries: all events, then corrected clicks; the second run sees only the new file."""
    folder = work_folder(m.spark)
    e = m.table("events").select("event_id", "event_type", "value", F.lit(1).alias("delivery"))
    args = (m.spark, f"{folder}/in", e.schema, f"{folder}/facts", f"{folder}/check", ["event_id"], ["event_type", "value"], "delivery")
    e.write.mode("append").parquet(f"{folder}/in")
    live.ingest(*args)
    e.where("event_type = 'click'").select("event_id", "event_type", (F.col("value") + 1).alias("value"), F.lit(2).alias("delivery")).write.mode("append").parquet(f"{folder}/in")
    live.ingest(*args)
    return rounded(live.current(m.spark, f"{folder}/facts", ["event_id"], ["event_type", "value"]), ["event_id", "event_type"], value=2)


@query("st2_dedup_news", "select distinct event_id // 3 as ext_id, event_type from events")
def _(m):
    x = table_stream(m, "events").select(F.floor(F.col("event_id") / 3).alias("ext_id"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return to_table(m, live.dedup_news(x, "ts", ["ext_id", "event_type"], "1 hour"), work_folder(m.spark)).select("ext_id", "event_type")


@query("st3_tumbling_bars", """
select symbol, trade_date::varchar as trade_date, round(open_raw, 7) as open_raw, round(high_raw, 7) as high_raw, round(low_raw, 7) as low_raw, round(close_raw, 7) as close_raw, volume_raw, round(amount_raw, 2) as amount_raw
from bars0 where trade_date + 1 <= (select max(l_shipdate)::date - 2 from lineitem where isodow(l_shipdate) <= 5)""")
def _(m):
    brand = m.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    li = table_stream(m, "lineitem").where(F.weekday("l_shipdate") < 5)
    ticks = li.join(brand, "l_partkey").select(
        "symbol", F.col("l_shipdate").cast("timestamp").alias("at"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("amt"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    out = to_table(m, live.daily_bars(ticks, "at", "2 days"), work_folder(m.spark))
    return rounded(out, ["symbol", "trade_date", "volume_raw"], open_raw=7, high_raw=7, low_raw=7, close_raw=7, amount_raw=2)


@query("st4_right_side_live", "select symbol, card_version_id, observed_on::varchar as observed_on, state, triggered, reason from rs_rows")
def _(m):
    """The daily flags arrive in two deliveries; state crosses from one micro-batch to the next."""
    folder = work_folder(m.spark)
    flags = rs.right_side_flags(cards.cards_asof(rs.right_side_inputs(m.daily_bars), m.vcards)).select(
        "symbol", "card_version_id", "trade_date", "f_break", "f_fail", "f_retest", "f_stop", "has_stop")
    parts = flags.where("trade_date < '1999-09-01'"), flags.where("trade_date >= '1999-09-01' and trade_date < '2000-09-01'"), flags.where("trade_date >= '2000-09-01'")
    for p in parts:
        p.write.mode("append").parquet(f"{folder}/in")
        stream = m.spark.readStream.schema(flags.schema).parquet(f"{folder}/in")
        out = to_table(m, live.right_side_live(stream), folder)
    return out


PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query("st4_falsification_live", "select symbol, card_version_id, trade_date::varchar as trade_date, run, state, triggered, reason from fals")
def _(m):
    """The days come in three deliveries, one of the last days of a delivery only with the next; an empty day closes the stream."""
    folder = work_folder(m.spark)
    days = m.bar_cards.select("symbol", "card_version_id", "trade_date", F.col("trade_date").cast("timestamp").alias("at"), dw.breached().alias("breached"))
    late = F.col("trade_date").isin(*(F.lit(d).cast("date") for d in ("1999-08-30", "2000-08-30")))
    part = F.when(F.col("trade_date") < "1999-09-01", 0).when(F.col("trade_date") < "2000-09-01", 1).otherwise(2) + F.when(late, 1).otherwise(0)
    days = cut_lineage(days.withColumn("part", part))
    end = days.agg(F.lit("~").alias("symbol"), F.lit("~").alias("card_version_id"), F.date_add(F.max("trade_date"), 400).alias("trade_date"), F.lit(3).alias("part"), F.lit(False).alias("breached"))
    days = days.unionByName(end.withColumn("at", F.col("trade_date").cast("timestamp")))
    before = m.spark.conf.get(PROVIDER)
    m.spark.conf.set(PROVIDER, ROCKS)
    try:
        for i in range(4):
            days.where(F.col("part") == i).drop("part").write.mode("append").parquet(f"{folder}/in")
            stream = m.spark.readStream.schema(days.drop("part").schema).parquet(f"{folder}/in")
            out = to_table(m, live.falsification_live(stream, "30 days"), folder)
    finally:
        m.spark.conf.set(PROVIDER, before)
    return out.where("symbol <> '~'")
