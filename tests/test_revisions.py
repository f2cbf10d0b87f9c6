"""Statements on two times: corrections, late publication dates, reruns, what was known on a day."""
import datetime as dt

import pytest

from tapeloom.operators import quality

KEY, VALUES = ["symbol", "period_end"], ["profit"]
CUR = "symbol string, period_end date, revision int, profit int, published_on date, available_on date"
NEW = "symbol string, period_end date, profit int, published_on date, market string, ingested_on date, row_no int"
END, LANDED = dt.date(2024, 3, 31), dt.date(2024, 9, 1)


def d(m, k):
    return dt.date(2024, m, k)


@pytest.fixture(scope="module")
def spine(spark):
    return spark.createDataFrame([("CN", d(4, 26), d(4, 29)), ("CN", d(5, 8), d(5, 9))], "market string, day date, next_open date")


def revised(spark, spine, cur, new):
    rows = [("A", END, *x, "CN", LANDED, i) if len(x) == 2 else (*x, i) for i, x in enumerate(new)]
    return quality.revise(spark.createDataFrame(cur, CUR), spark.createDataFrame(rows, NEW), KEY, VALUES, spine)


def times(df):
    return [(r.revision, r.profit, r.published_on, r.available_on, r.action) for r in df.orderBy(*KEY, "revision").collect()]


def test_a_correction_is_the_next_revision_with_its_own_availability(spark, spine):
    cur = [("A", END, 1, 10, d(4, 26), d(4, 29))]
    out = revised(spark, spine, cur, [(11, d(5, 8))])
    assert times(out) == [(1, 10, d(4, 26), d(4, 29), "keep"), (2, 11, d(5, 8), d(5, 9), "insert")]
    for day, profit in ((d(4, 28), []), (d(4, 29), [10]), (d(5, 8), [10]), (d(5, 9), [11])):
        assert [r.profit for r in quality.known_on(out, KEY, day).collect()] == profit


def test_a_late_date_is_filled_in_and_logged_and_a_known_one_stays(spark, spine):
    out = revised(spark, spine, [("A", END, 1, 10, None, LANDED), ("B", END, 1, 10, d(4, 26), d(4, 29))],
                  [(10, d(5, 8)), ("B", END, 10, d(5, 8), "CN", LANDED)])
    assert times(out) == [(1, 10, d(5, 8), d(5, 9), "date"), (1, 10, d(4, 26), d(4, 29), "keep")]
    log = quality.revision_log(out, KEY).collect()
    assert [(r.symbol, r.action, r.old_value, r.new_value) for r in log] == [
        ("A", "date", '{"available_on":"2024-09-01"}', '{"published_on":"2024-05-08","available_on":"2024-05-09"}')]


def test_content_that_comes_back_is_a_revision_of_its_own_and_undated_ones_count_from_their_delivery(spark, spine):
    out = revised(spark, spine, [], [(10, None), (10, d(4, 26)), (11, None), (10, None), (None, None), (None, None)])
    assert times(out) == [(1, 10, d(4, 26), d(4, 29), "insert"), (2, 11, None, LANDED, "insert"), (3, 10, None, LANDED, "insert"), (4, None, None, LANDED, "insert")]


def test_a_rerun_changes_nothing(spark, spine):
    new = [(10, None), (11, d(5, 8))]
    once = revised(spark, spine, [], new)
    stored = [tuple(r) for r in once.select(*KEY, "revision", "profit", "published_on", "available_on").collect()]
    again = revised(spark, spine, stored, [new[-1]])
    assert {r.action for r in again.collect()} == {"keep"} and quality.revision_log(again, KEY).count() == 0


def test_empty_sides_and_unknown_keys(spark, spine):
    assert revised(spark, spine, [], []).count() == 0
    assert revised(spark, spine, [], [("A", None, 1, None, "CN", LANDED)]).count() == 0
    out = revised(spark, spine, [], [("A", END, 1, d(5, 20), "XX", LANDED)])
    assert times(out) == [(1, 1, d(5, 20), d(5, 21), "insert")]


def test_back_filled_times_are_logged_once(spark):
    cols = "symbol string, period_end date, period_type string, published_at timestamp, available_date date, matched boolean, new_published_at timestamp, new_available_on date, disclosure_title string, tier string"
    t = dt.datetime(2024, 4, 25, 16)
    rows = [("A", END, "quarterly", None, LANDED, True, t, d(4, 29), "t", "full"), ("B", END, "quarterly", t, d(4, 29), True, t, d(4, 29), "t", "full"),
            ("C", END, "quarterly", None, LANDED, False, None, LANDED, None, None)]
    log = quality.pit_revisions(spark.createDataFrame(rows, cols)).collect()
    assert [(r.symbol, r.old_value) for r in log] == [("A", '{"available_on":"2024-09-01"}')]
    assert '"title":"t","tier":"full"' in log[0].new_value
