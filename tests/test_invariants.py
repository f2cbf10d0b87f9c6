"""Truncation, rerun and registration properties on the small tables."""
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import accumulation, cross_section, exhaustion, indicators, weekly
from tapeloom.plans.all_queries import CHECKS, QUERIES, check_sql
from tapeloom.plans.market import Market
from tests.compare import compare, duck
from tests.conftest import SF

CUT = "2000-01-31"


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def market(spark):
    return Market(spark, SF)


def test_week_anchors_do_not_look_ahead(market):
    def anchors(bars, cal):
        w = weekly.weekly_bars(bars, cal)
        return exhaustion.timeline(w, bars).where(F.col("week_end_date") < CUT).select("symbol", "week_end_date", "anchor_idx", "is_fallback", "low_date", "decl_idx")
    b, c = market.daily_bars, market.trading_calendar
    early = F.col("trade_date") <= CUT
    assert rows(anchors(b, c)) == rows(anchors(b.where(early), c.where(early)))


def test_indicators_and_pattern_do_not_look_ahead(market):
    b = market.daily_bars
    early = F.col("trade_date") <= CUT
    pick = lambda d: d.where(early)
    a = indicators.recursive_indicators(market.adj).where(early)
    z = indicators.recursive_indicators(market.adj.where(early))
    assert rows(a) == rows(z)
    seen = F.col("observed_on") <= CUT
    assert rows(accumulation.accumulation(b).where(seen)) == rows(accumulation.accumulation(pick(b)))


def test_scores_of_a_day_do_not_change_with_later_days(market):
    early = F.col("trade_date") <= CUT
    s = lambda d: cross_section.factor_scores(cross_section.symbol_factors(d)).select("symbol", "trade_date", F.round("score", 9).alias("score"))
    assert rows(s(market.adj).where(early)) == rows(s(market.adj.where(early)))


def test_reruns_agree(spark):
    for name in ("s24_parse_news", "e07_effective_state", "t11_dedup_key"):
        assert rows(QUERIES[name](spark, SF)) == rows(QUERIES[name](spark, SF))


def test_every_check_names_its_views():
    for name in CHECKS:
        assert name in QUERIES and "select" in check_sql(name).lower()


@pytest.mark.parametrize("name", ["f02_detect_plateaus", "i12_indicators_weekly", "b02_factor_scores", "p06_pe_series", "e02_event_study", "d04_falsification", "r02_right_side",
                                  "k06_roll_versions", "v04_batch_policy", "s22_parse_ann_uuid", "q05_signal_events", "z01_surge_screen", "st3_tumbling_bars"])
def test_small_tables_match_their_checks(spark, name):
    status, info = compare(spark, duck(SF), name, SF)
    assert status == "ok", info
