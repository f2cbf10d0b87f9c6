"""Closed-form and brute-force cases for the operators."""
import datetime as dt
import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import accumulation, adjust, chips, cross_section, indicators, outcomes, quality, timeops
from tapeloom.operators.right_side import step

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def bars(closes, symbol="S", **cols):
    rows = []
    for i, c in enumerate(closes):
        row = dict(symbol=symbol, trade_date=day(i), open_raw=float(c), high_raw=float(c), low_raw=float(c), close_raw=float(c), volume_raw=100.0,
                   amount_raw=float(c) * 100, price_adj_factor=1.0, share_factor=1.0, turnover=0.1)
        row.update({k: v[i] for k, v in cols.items()})
        rows.append(row)
    return pd.DataFrame(rows)


def test_ema_is_seeded_by_first_value():
    out = indicators.ema_of(pd.Series([1.0, 2.0, 3.0]), 3)
    assert out.tolist() == pytest.approx([1.0, 1.5, 2.25])


def test_rma_waits_for_a_full_window_and_keeps_state_over_gaps():
    s = pd.Series([np.nan, 1.0, 2.0, 3.0, np.nan, 6.0])
    out = indicators.rma_of(s, 3)
    assert out.isna().tolist() == [True, True, True, False, True, False]
    assert out.iloc[3] == pytest.approx(2.0) and out.iloc[5] == pytest.approx((2.0 * 2 + 6.0) / 3)


@pytest.mark.parametrize("closes,want", [([1, 2, 3, 4, 5, 6, 7, 8], 100.0), ([8, 7, 6, 5, 4, 3, 2, 1], 0.0), ([5] * 8, 50.0)])
def test_rsi_limits(closes, want):
    out = indicators.rsi_of(pd.Series(closes, dtype=float), 6)
    assert out.iloc[:6].isna().all() and out.iloc[6] == want


def test_kdj_repeats_values_without_range():
    c = pd.Series([10.0] * 12)
    out = indicators.kdj_of(c, c, c)
    assert out["kdj_k"].iloc[:8].isna().all() and (out["kdj_k"].iloc[8:] == 50.0).all() and (out["kdj_j"].iloc[8:] == 50.0).all()


def test_plateaus_against_brute_force():
    rnd = random.Random(5)
    level, f = 1.0, []
    for _ in range(400):
        level *= 1.0 if rnd.random() > 0.02 else rnd.choice((0.99, 1.01, 0.5))
        f.append(level * (1 + rnd.uniform(-4e-4, 4e-4)))
    want, seg, start = [], [f[0]], 0
    for i, v in enumerate(f[1:], 1):
        m = statistics.median(seg)
        if abs(v - m) / abs(m) > 0.001:
            want.append((start, i - 1, statistics.median(seg)))
            seg, start = [v], i
        else:
            seg.append(v)
    want.append((start, len(f) - 1, statistics.median(seg)))
    got = adjust._plateaus_of(0.001)(pd.DataFrame({"symbol": "S", "trade_date": [day(i) for i in range(len(f))], "f": f}))
    assert [(r.start_date, r.end_date) for r in got.itertuples()] == [(day(a), day(b)) for a, b, _ in want]
    assert got["factor"].tolist() == pytest.approx([w[2] for w in want])


def test_share_factor_counts_splits_after_the_day(spark):
    b = spark.createDataFrame(bars([1, 1, 1, 1]))
    ca = spark.createDataFrame([("S", day(1), "split", 2.0), ("S", day(3), "bonus_share", 4.0), ("S", day(2), "cash_dividend", None)],
                               "symbol string, ex_date date, action_type string, split_ratio double")
    got = {r.trade_date: r.share_factor for r in adjust.share_factor(b, ca).collect()}
    assert got == {day(0): 0.125, day(1): 0.25, day(2): 0.25, day(3): 1.0}


def test_kernel_holds_unit_mass():
    edges = np.linspace(5, 15, 41)
    low, high, top = np.array([(8.0, 12.0, 8.0), (8.0, 12.0, 12.0), (8.0, 12.0, 9.3), (9.0, 9.0, 9.0), (1.0, 20.0, 3.0)]).T
    for flat in (False, True):
        mass = chips.masses(edges, low, high, top, np.full(5, flat))
        assert mass.sum(axis=1) == pytest.approx(1.0) and (mass >= -1e-12).all()
    assert mass[0] == pytest.approx(np.where((edges[:-1] >= 8) & (edges[1:] <= 12), 1 / 16, 0)) and np.flatnonzero(mass[3]).tolist() == [15]


def triangle(x, a, b, peak):
    if x <= a or x >= b:
        return float(x >= b)
    return (x - a) ** 2 / (b - a) / (peak - a) if x <= peak else 1 - (b - x) ** 2 / (b - a) / (b - peak)


def test_chip_replay_against_direct_recursion():
    rnd = random.Random(2)
    n = 2 * chips.BLOCK + 9
    c = [10 + rnd.uniform(-2, 2) for _ in range(n)]
    pdf = bars(c, high_raw=[x + 1 for x in c], low_raw=[x - 1 for x in c], turnover=[rnd.uniform(0, 1.4) if i % 7 else None for i in range(n)],
               volume_raw=[0.0 if i == 11 else 100.0 for i in range(n)])
    pdf["turnover"] = pdf["turnover"].astype(float)
    pdf["trading_status"] = "trading"
    out = chips.replay(pdf, 60)
    edges = np.linspace(min(pdf.low_raw) * 0.9, max(pdf.high_raw) * 1.1, 61)
    mid = (edges[:-1] + edges[1:]) / 2
    w = None
    for i, r in enumerate(pdf.itertuples()):
        if w is None:
            w = np.clip((edges[1:] - r.low_raw) / 2, 0, 1) - np.clip((edges[:-1] - r.low_raw) / 2, 0, 1)
        elif r.volume_raw > 0 and not math.isnan(r.turnover):
            k = min(0.7 * r.turnover, 0.8)
            w = (1 - k) * w + k * np.diff([triangle(x, r.low_raw, r.high_raw, r.close_raw) for x in edges])
        assert out["avg_cost_adj"].iloc[i] == pytest.approx(float(mid @ w))
        assert out["winner_ratio"].iloc[i] == pytest.approx(float(np.interp(r.close_raw, mid, np.cumsum(w))))
        assert [out["cost_5_adj"].iloc[i], out["cost_95_adj"].iloc[i]] == pytest.approx(np.interp([0.05, 0.95], np.cumsum(w), mid))
    assert math.isnan(out["turnover_used"].iloc[11])


def pattern_rows(closes, **kw):
    n = len(closes)
    base = dict(open=closes, high=[c * 1.001 for c in closes], low=[c * 0.999 for c in closes], close=closes, volume=[100.0] * n, vol_base=[200.0] * n,
                breakdown_reason=["condition_not_met"] * n, is_probe=[False] * n, ma_spread=[0.01] * n)
    base.update(kw)
    return pd.DataFrame(base)


def run_pattern(df):
    p = accumulation.Pattern()
    return [p.day(r)[:3] for r in df.itertuples(index=False)]


def test_accumulation_confirms_on_volume_above_the_box():
    n = 16
    closes = [100.0] * 15 + [103.0]
    why = ["condition_met"] + ["condition_not_met"] * (n - 1)
    df = pattern_rows(closes, breakdown_reason=why, volume=[100.0] * 15 + [400.0], open=[100.0] * n, is_probe=[False] * 12 + [True] + [False] * 3)
    out = run_pattern(df)
    assert out[0] == ("watching", True, "breakdown_detected") and out[9] == ("watching", False, "waiting_min_days")
    assert out[10] == ("consolidating", True, "consolidation_confirmed") and out[12] == ("consolidating", False, "probe_detected")
    assert out[15] == ("confirmed", True, "breakout_confirmed")


def test_accumulation_fails_below_the_box_and_starts_over_the_next_day():
    closes = [100.0] * 12 + [99.0, 99.0]
    df = pattern_rows(closes, breakdown_reason=["condition_met"] + ["condition_not_met"] * 13)
    out = run_pattern(df)
    assert out[12] == ("failed", True, "box_broken") and out[13][0] == "idle"


@pytest.mark.parametrize("held,last", [(120, "holding"), (121, "expired_consolidation")])
def test_accumulation_expiry_counts_from_the_box(held, last):
    closes = [100.0] * (11 + held)
    df = pattern_rows(closes, breakdown_reason=["condition_met"] + ["condition_not_met"] * (10 + held))
    assert run_pattern(df)[-1][2] == last


def test_accumulation_watch_gives_up_after_the_limit():
    closes = [100.0] * 122
    df = pattern_rows(closes, breakdown_reason=["condition_met"] + ["condition_not_met"] * 121, ma_spread=[0.2] * 122)
    out = run_pattern(df)
    assert out[120][2] == "condition_not_met" and out[121] == ("failed", True, "expired_no_consolidation")


def test_right_side_order_of_tests():
    assert step("idle", 0, True, True, True, False, True)[0] == "waiting_retest"
    assert step("waiting_retest", 0, False, True, True, False, True)[2] == "invalidated"
    assert step("waiting_retest", 9, False, False, False, False, True)[2] == "expired"
    assert step("waiting_retest", 9, False, False, True, False, False)[::2] == ("idle", "confirmed")
    assert step("holding", 0, False, False, False, True, True)[2] == "stopped_out"


def test_first_below_against_brute_force():
    rnd = random.Random(9)
    closes = [rnd.uniform(50, 150) for _ in range(300)]
    b = pd.DataFrame({"symbol": "S", "trade_date": [day(i) for i in range(300)], "kind": 0, "close_raw": closes, "line": np.nan, "key": None})
    e = pd.DataFrame([{"symbol": "S", "trade_date": day(i), "kind": 1, "close_raw": np.nan, "line": closes[i] * 0.95, "key": str(i)} for i in range(0, 300, 3)])
    got = {r.key: r.deep_date for r in outcomes._first_below(pd.concat([b, e], ignore_index=True)).itertuples()}
    for i in range(0, 300, 3):
        want = next((day(j) for j in range(i + 1, 300) if closes[j] < closes[i] * 0.95), None)
        assert got.get(str(i)) == want


def test_asof_strict_forward_and_repeated_points(spark):
    left = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("b", 2)], "k string, t int")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 5, "z")], "k string, u int, v string")
    got = lambda **kw: sorted((r.k, r.t, r.v) for r in timeops.asof(left, right, ["k"], "t", "u", ["v"], **kw).collect())
    assert got() == [("a", 1, "x"), ("a", 3, "y"), ("a", 3, "y"), ("b", 2, None)]
    assert got(strict=True) == [("a", 1, None), ("a", 3, "x"), ("a", 3, "x"), ("b", 2, None)]
    assert got(strict=True, backward=False) == [("a", 1, "y"), ("a", 3, "z"), ("a", 3, "z"), ("b", 2, None)]


def test_score_uses_unclipped_spread_and_clipped_mean(spark):
    vals = [(f"s{i}", float(v)) for i, v in enumerate((1, 2, 3, 4, 100))]
    f = spark.createDataFrame([(s, D0, v, v, v) for s, v in vals], "symbol string, trade_date date, momentum double, volatility double, liquidity double")
    x = np.array([v for _, v in vals])
    lo, hi = np.quantile(x, [0.05, 0.95])
    cl = np.clip(x, lo, hi)
    want = dict(zip([s for s, _ in vals], 0.4 * (cl - cl.mean()) / x.std()))
    got = {r.symbol: r.score for r in cross_section.factor_scores(f).collect()}
    assert got == pytest.approx(want)


def test_two_names_have_no_score(spark):
    f = spark.createDataFrame([("a", D0, 1.0, 2.0, 3.0), ("b", D0, 2.0, 3.0, 4.0)], "symbol string, trade_date date, momentum double, volatility double, liquidity double")
    assert [r.score for r in cross_section.factor_scores(f).collect()] == [None, None]


@pytest.mark.parametrize("row,why", [((None, None, None, None), "EMPTY"), ((1.0, None, 1.0, 1.0), "partial_ohlc"), ((-1.0, 1.0, -1.0, 1.0), "negative_price"),
                                     ((1.0, 1.0, 1.0 + 5e-7, 1.0), None), ((1.0, 1.0, 1.1, 1.0), "ohlc_order")])
def test_ohlc_reasons(spark, row, why):
    df = spark.createDataFrame([(*row, 1.0, 1.0)], "open double, high double, low double, close double, volume double, amount double")
    assert quality.validate_ohlc(df).first().reason == why


def test_one_conflict_rejects_the_file(spark):
    rows = spark.createDataFrame([("f1", "ok", False), ("f1", "conflict", False), ("f2", "ok", True), ("f2", "skip", False)], "file_path string, outcome string, incomplete boolean")
    kept, files = quality.batch_policy(rows)
    assert [r.file_path for r in kept.collect()] == ["f2"]
    assert {r.file_path: (r.status, r.kept) for r in files.collect()} == {"f1": ("conflict", 0), "f2": ("incomplete", 1)}


def test_news_dedup_equals_sequential_replay(spark):
    from tapeloom.sources.messages import first_of_two_keys
    rnd = random.Random(3)
    rows = [(i, f"e{rnd.randrange(40)}" if rnd.random() > 0.2 else None, f"h{rnd.randrange(40)}" if rnd.random() > 0.2 else None) for i in range(200)]
    es, hs, want = set(), set(), []
    for i, e, h in rows:
        if (e is not None and e in es) or (h is not None and h in hs):
            continue
        want.append(i)
        es |= {e} - {None}
        hs |= {h} - {None}
    df = spark.createDataFrame(rows, "n int, e string, h string")
    assert sorted(r.n for r in first_of_two_keys(df, "e", "h", "n").collect()) == want


def test_repeated_deliveries_keep_the_key(spark):
    from tapeloom.sources.prices import turnover_update
    cur = spark.createDataFrame([("a", 1.0)], "k string, v double")
    new = spark.createDataFrame([("a", 2.0, 1), ("a", 3.0, 2), ("b", 5.0, 4), ("b", 4.0, 3)], "k string, v double, row_no int")
    got = {r.k: (r.action, r.v) for r in quality.merge_facts(cur, new, ["k"], ["v"], ("v",)).collect()}
    assert got == {"a": ("update", 3.0), "b": ("insert", 5.0)}
    had = spark.createDataFrame([("a", 1.0, 3)], "k string, v double, revision int")
    new = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2), ("a", 2.0, 3), ("a", 1.0, 4), ("b", 7.0, 5), ("b", 7.0, 6)], "k string, v double, row_no int")
    got = sorted((r.k, r.revision, r.v) for r in quality.append_revision(had, new, ["k"], ["v"]).collect())
    assert got == [("a", 4, 2.0), ("a", 5, 1.0), ("b", 1, 7.0)]
    bars = spark.createDataFrame([("a", D0, 0.1), ("b", D0, 0.2)], "symbol string, trade_date date, turnover double")
    told = spark.createDataFrame([("a", D0, 0.3, "d/1"), ("a", D0, 0.4, "d/2")], "symbol string, trade_date date, turnover double, file_path string")
    assert sorted((r.symbol, r.turnover) for r in turnover_update(bars, told).collect()) == [("a", 0.4), ("b", 0.2)]


def test_long_card_chain(spark):
    from tapeloom.operators.reads import card_chain
    rows = [(f"v{i}", f"v{i - 1}" if i else None) for i in range(1000)] + [("x", "y"), ("y", "z"), ("z", "y"), ("lone", "unknown")]
    got = {r.card_version_id: r.chain for r in card_chain(spark.createDataFrame(rows, "card_version_id string, supersedes_id string")).collect()}
    assert got["v999"] == [f"v{i}" for i in range(999, -1, -1)] and got["v0"] == ["v0"]
    assert got["x"] == ["x", "y", "z"] and got["y"] == ["y", "z"] and got["z"] == ["z", "y"] and got["lone"] == ["lone", "unknown"]


def test_terms_occur_as_in_plain_search(spark):
    from tapeloom.functions.columns import occurrences
    rnd = random.Random(5)
    texts = [(i, "".join(rnd.choice("ab周节") for _ in range(rnd.randrange(12)))) for i in range(60)] + [(60, None), (61, "")]
    terms = sorted({"".join(rnd.choice("ab") for _ in range(n)) for n in (1, 2, 3, 3)}) + ["", None]
    t, w = spark.createDataFrame(texts, "event_id int, text string"), spark.createDataFrame([(x,) for x in terms], "term string")
    found = lambda n: {(r.event_id, r.term) for r in occurrences(t, w, n).collect()}
    spots = [(i, k, text[at + len(k):at + len(k) + 1]) for i, text in texts if text for k in terms if k for at in range(len(text)) if text.startswith(k, at)]
    assert found("") == {(i, k) for i, k, _ in spots}
    assert found("周节") == {(i, k) for i, k, then in spots if then not in ("周", "节")}


def test_a_stored_scope_stays(spark):
    from tapeloom.operators.events import classify_scope
    news = spark.createDataFrame([(1, "news", "MLF", None, "industry"), (2, "news", "MLF", None, None), (3, "flow", "x", None, "")], "event_id int, event_type string, title string, summary string, scope string")
    assert {r.event_id: r.scope for r in classify_scope(news).collect()} == {1: "industry", 2: "macro", 3: "flow"}
