"""Structured Streaming forms of the naturally incremental jobs.

All run with any trigger; tests and the registered queries use AvailableNow.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeloom.functions.columns import ordered_price, price_of
from tapeloom.operators.right_side import RIGHT_SCHEMA, step
from tapeloom.params import CONFIRM_DAYS


def run_available(writer, checkpoint: str) -> None:
    """Process what is there and stop."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


# --------------------------------------------------------------------------- incremental ingest

def append_batch(target: str, key: list[str], values: list[str], order: str):
    """foreachBatch function: the newest row per key of the batch becomes one part of the table.

    A batch costs what it delivers, however large the table is. Parts are named by batch, so a batch that runs
    again after a failure writes the same part over.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*key, "_v.*")
        new.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
    return write


def current(spark: SparkSession, target: str, key: list[str], values: list[str]) -> DataFrame:
    """Rows in force: per key those of the newest part that has it."""
    parts = spark.read.option("basePath", target).parquet(target)
    return parts.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*key, "_v.*")


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key, values, order, fmt: str = "parquet", **options) -> None:
    """Read files not seen before and upsert them; the file source's checkpoint remembers which were."""
    stream = spark.readStream.format(fmt).schema(schema).options(**options).load(source)
    run_available(stream.writeStream.foreachBatch(append_batch(target, key, values, order)), checkpoint)


# --------------------------------------------------------------------------- deduplication and bars

def dedup_news(stream: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """First message per key within the delay; later duplicates and rows behind the watermark are dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def daily_bars(ticks: DataFrame, time: str, delay: str) -> DataFrame:
    """Tumbling one-day bars per symbol; a day is emitted once the watermark has passed its end."""
    return ticks.withWatermark(time, delay).groupBy("symbol", F.window(time, "1 day").alias("w")).agg(
        F.min(ordered_price(F.col("seq"), "px")).alias("_open"), F.max("px").alias("high_raw"), F.min("px").alias("low_raw"), F.max(ordered_price(F.col("seq"), "px")).alias("_close"),
        F.sum("qty").alias("volume_raw"), F.sum("amt").alias("amount_raw")).select(
        "symbol", F.to_date("w.start").alias("trade_date"), price_of("_open").alias("open_raw"), "high_raw", "low_raw", price_of("_close").alias("close_raw"), "volume_raw", "amount_raw")


# --------------------------------------------------------------------------- live state

def _advance(key, frames, state: GroupState):
    """Carry (state, days waited) of one card across micro-batches."""
    current, waited = state.get if state.exists else ("idle", 0)
    rows = pd.concat(list(frames), ignore_index=True).sort_values("trade_date")
    out = []
    for r in rows.itertuples(index=False):
        current, waited, emitted, reason = step(current, waited, r.f_break, r.f_fail, r.f_retest, r.f_stop, r.has_stop)
        if emitted:
            out.append((key[0], key[1], r.trade_date, emitted, emitted != "holding", reason))
    state.update((current, waited))
    yield pd.DataFrame(out, columns=["symbol", "card_version_id", "observed_on", "state", "triggered", "reason"])


def right_side_live(flags: DataFrame) -> DataFrame:
    """State machine over a stream of daily flags, keyed by symbol and card version. Days of a key must not arrive
    in an earlier batch than days before them."""
    return flags.groupBy("symbol", "card_version_id").applyInPandasWithState(
        _advance, RIGHT_SCHEMA, "state string, waited int", "append", GroupStateTimeout.NoTimeout)


class _Falsification(StatefulProcessor):
    """Days of one card in order of time: they wait until the watermark has passed them, so a late one takes its place."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "run int")
        self.days = handle.getListState("days", "trade_date date, at long, breached boolean")

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            at = [int(t.timestamp() * 1000) for t in pd.to_datetime(pdf["at"], utc=True)]
            self.days.appendList([(d, t, bool(b)) for d, t, b in zip(pdf["trade_date"], at, pdf["breached"])])
            for t in sorted(set(at)):
                self.handle.registerTimer(t)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = expiredTimerInfo.getExpiryTimeInMs()
        days = sorted(self.days.get(), key=lambda d: d[1])
        now, rest = [d for d in days if d[1] <= until], [d for d in days if d[1] > until]
        if not now:
            yield pd.DataFrame()
            return
        run, out = (self.run.get()[0] if self.run.exists() else 0), []
        for day, _, breached in now:
            before, run = run, run + 1 if breached else 0
            state = "active" if run >= CONFIRM_DAYS else "watching" if run else "inactive"
            reason = ("confirmed" if run == CONFIRM_DAYS else "holding" if run > CONFIRM_DAYS else f"breach_day_{run}_of_{CONFIRM_DAYS}" if run
                      else "recovered" if before >= CONFIRM_DAYS else "no_breach")
            out.append((*key, day, run, state, run == CONFIRM_DAYS, reason))
        self.run.update((run,))
        self.days.clear() if not rest else self.days.put(rest)
        yield pd.DataFrame(out, columns=["symbol", "card_version_id", "trade_date", "run", "state", "triggered", "reason"])

    def close(self) -> None:
        pass


def falsification_live(days: DataFrame, delay: str) -> DataFrame:
    """Falsification of each card over a stream of days (symbol, card_version_id, trade_date, at, breached).

    Days may arrive out of order and in later batches as long as they are not more than ``delay`` behind the newest; each is
    reported once the watermark has passed it. Needs the RocksDB state store.
    """
    schema = "symbol string, card_version_id string, trade_date date, run int, state string, triggered boolean, reason string"
    return days.withWatermark("at", delay).groupBy("symbol", "card_version_id").transformWithStateInPandas(
        statefulProcessor=_Falsification(), outputStructType=schema, outputMode="Append", timeMode="EventTime")
