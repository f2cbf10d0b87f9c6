"""Stored tables: no exchange per symbol, pruned reads, refresh of the years that change; plans of bars; terms in texts."""
import random

from pyspark.sql import functions as F

from tapeloom.functions import columns
from tapeloom.operators import adjust, indicators
from tapeloom.plans.market import Market
from tapeloom.session import work_folder
from tapeloom.sources.store import Store

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_store(spark):
    bars = Market(spark, SF).daily_bars
    store = Store(spark, work_folder(spark), 4)
    wrong = (F.year("trade_date") == 1998) & (F.col("symbol") == "Brand#12")
    store.create("bars", bars.where("trade_date < '2000-01-01'").withColumn("close_raw", F.when(wrong, -1.0).otherwise(F.col("close_raw"))))
    untouched = lambda: {f for f in store.spark.table(store.name("bars")).inputFiles() if "year=1997" in f}
    before = untouched()
    store.refresh("bars", bars.where(wrong | (F.col("trade_date") >= F.lit("2000-01-01").cast("date"))))
    assert untouched() == before
    got, want = store.read("bars"), bars
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).isEmpty()

    ind = indicators.indicators_in_place(adjust.adjusted_bars(store.read("bars")))
    assert "Exchange" not in plan(ind) and "Bucketed: true" in plan(ind)
    part = store.read("bars", "1998-03-01", "1999-02-28")
    assert "PartitionFilters: [isnotnull(year" in plan(part) and "GreaterThanOrEqual(trade_date,1998-03-01)" in plan(part)
    assert part.count() == bars.where("trade_date between '1998-03-01' and '1999-02-28'").count()
    store.drop("bars")


def test_bars_are_not_sorted(spark):
    assert "Sort" not in plan(Market(spark, SF, False).bars0)


def test_ordered_price(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(10**13), rng.choice([rng.uniform(0, 1e-3), rng.uniform(1, 1e3), rng.uniform(1e3, 1e5)])) for _ in range(500)] + [(0, 0.0), (10**13 - 1, 99999999.0)]
    df = spark.createDataFrame(rows, "seq long, px double").withColumn("k", columns.ordered_price(F.col("seq"), "px"))
    got = df.orderBy("k").select("seq", columns.price_of("k").alias("px")).collect()
    assert [r.seq for r in got] == sorted(r[0] for r in rows)
    of = dict(rows)
    assert all(abs(r.px - of[r.seq]) <= 1e-16 + 2e-16 * of[r.seq] for r in got)


def test_terms(spark, monkeypatch):
    rng = random.Random(2)
    say = lambda n: "".join(rng.choice("ab金周c") for _ in range(n))
    texts = [(i, say(rng.randrange(40))) for i in range(60)] + [(60, None), (61, ""), (62, "金"), (62, "金"), (63, "金周")]
    terms = ["a", "ab", "金", "金周", "cab", "abcabcabcabc", "", None, "a"]
    t, w = spark.createDataFrame(texts, "event_id long, text string"), spark.createDataFrame([(x,) for x in terms], "term string")
    for most in (100_000, 2):  # one automaton, and several
        monkeypatch.setattr(columns, "TERMS", most)
        for stop in ("", "周c"):
            want = {(i, x) for i, s in texts for x in terms if x and s and any(s.startswith(x, k) and (not stop or s[k + len(x):k + len(x) + 1] == "" or s[k + len(x)] not in stop) for k in range(len(s)))}
            assert {tuple(r) for r in columns.occurrences(t, w, stop).collect()} == want
    assert columns.occurrences(t, w.limit(0)).count() == 0
