import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from mnemoframe.functions import dates, scoring, vectors

NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def at(text):
    return F.lit(text).cast("timestamp")


def test_fused_score_with_default_weights(spark):
    row = spark.range(1).select(*[F.lit(v).alias(f"{s}_score") for s, v in zip(
        ("vector", "keyword", "graph", "salience", "recency", "temporal"),
        (.9, .5, .3, .7, .6, .0))])
    score = row.select(scoring.fused_score().alias("s")).first()["s"]
    assert score == pytest.approx(0.52)


def test_weights_are_normalised_and_all_zero_means_equal():
    assert sum(scoring.normalized_weights({"vector": 2, "graph": 6}).values()) == pytest.approx(1)
    assert scoring.normalized_weights({"vector": 2, "graph": 6})["graph"] == 0.75
    assert set(scoring.normalized_weights({"vector": 0}).values()) == {1 / 6}
    with pytest.raises(ValueError):
        scoring.normalized_weights({"taste": 1})


@pytest.mark.parametrize("importance,frequency,days", [
    (1.0, 1000, 0), (0.0, 0, 19000), (0.5, 5, 365), (0.8, 50, 30)])
def test_decay_stays_in_unit_interval_and_matches_formula(spark, importance, frequency, days):
    accessed = F.expr(f"{NOW} - INTERVAL {days} DAYS")
    got = one(spark, scoring.decay(F.lit(importance), F.lit(frequency), accessed, F.expr(NOW)))
    want = importance * 0.5 ** (days / 30) * min(1, math.log(1 + frequency) / math.log(51))
    assert 0 <= got <= 1
    assert got == pytest.approx(want, abs=1e-12)


def test_never_accessed_has_no_decay_score_and_half_recency(spark):
    never = F.lit(None).cast("timestamp")
    assert one(spark, scoring.decay(F.lit(1.0), F.lit(9), never, F.expr(NOW))) == 0
    assert one(spark, scoring.recency(never, F.expr(NOW), F.expr(NOW))) == pytest.approx(0.5)


@pytest.mark.parametrize("kind,start,end", [
    ("explicit_positive", 0.98, 1.0), ("implicit_positive", 0.5, 0.55),
    ("explicit_negative", 0.12, 0.1), ("correction", 0.5, 0.4), ("unknown", 0.5, 0.5)])
def test_feedback_steps(spark, kind, start, end):
    got = one(spark, scoring.adjusted_importance(F.lit(start), F.lit(kind)))
    assert got == pytest.approx(end)


@pytest.mark.parametrize("a,b,want", [
    ([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([1.0], [1.0, 2.0], 0.0),
    ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0, 1.0], [-1.0, -1.0], -1.0), ([], [], 0.0)])
def test_cosine(spark, a, b, want):
    def arr(v):
        return F.array(*[F.lit(x) for x in v]).cast("array<float>")
    assert one(spark, vectors.cosine(arr(a), arr(b))) == pytest.approx(want)


@pytest.mark.parametrize("query,year,month,day,ordering", [
    ("What does the user like?", None, None, None, None),
    ("What happened on March 15th?", None, 3, 15, None),
    ("What happened on March 15, 2023?", 2023, 3, 15, None),
    ("What happened on 15th March?", None, 3, 15, None),
    ("What happened in February?", None, 2, None, None),
    ("meetings in jan", None, 1, None, None),
    ("When did we first discuss this?", None, None, None, "first"),
    ("What was the last thing mentioned?", None, None, None, "last"),
    ("What happened last week?", 2024, 1, 25, None),
    ("yesterday", 2024, 1, 31, None),
    ("last month", 2024, 1, None, None),
    ("how is the market", None, None, None, None),
    ("the first order in January", None, 1, None, "first")])
def test_time_reference(spark, query, year, month, day, ordering):
    ref = one(spark, dates.time_reference(F.lit(query), F.expr(NOW)))
    assert (ref.point.year if ref.point else None,
            ref.point.month if ref.point else None,
            ref.point.day if ref.point else None, ref.ordering) == (year, month, day, ordering)


def test_reference_day_past_month_end_runs_into_the_next(spark):
    ref = dates.time_reference(F.lit("on February 31, 2023"), F.expr(NOW))
    assert one(spark, dates.reference_date(ref, F.expr(NOW))) == dt.date(2023, 3, 3)


@pytest.mark.parametrize("old,new,text", [
    ("2025-06-15", "2025-06-15", "Superseded on the same day"),
    ("2025-06-15", "2025-06-16", "Updated after 1 day"),
    ("2025-06-10", "2025-06-15", "Updated after 5 days"),
    ("2025-06-01", "2025-06-11", "Changed over ~1 week"),
    ("2025-01-01", "2025-02-15", "Changed over ~2 months"),
    ("2024-01-01", "2025-02-04", "Changed over ~1 year")])
def test_timeline(spark, old, new, text):
    assert one(spark, dates.timeline(at(old), at(new))) == text


@pytest.mark.parametrize("text,want", [
    ("on 2026-03-20 we met", "2026-03-20"), ("March 20, 2026", "2026-03-20"),
    ("20 March 2026", "2026-03-20"), ("in March 2026", "2026-03-15"),
    ("March 20", "2026-03-20"), ("Q2 2026", "2026-05-15"), ("nothing", None)])
def test_event_date(spark, text, want):
    assert one(spark, dates.event_date_text(F.lit(text))) == want
