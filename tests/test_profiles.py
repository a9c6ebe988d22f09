from itertools import permutations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.operators import customers as C
from pulsegrid.operators import profiles as P
from pulsegrid.operators import rollups as R
from pulsegrid.operators.paging import keyset_page, page_limit
from tests.helpers import events, plan

T0 = "2024-01-01 00:00:00"


def at(days):
    secs = int(days * 86400)
    return f"2024-01-{1 + secs // 86400:02d} {secs % 86400 // 3600:02d}:00:00"


@pytest.mark.parametrize("fold, raw, anchor", [
    ([("opened", 0), ("clicked", 7)], 2.707107, at(7)),
    ([("opened", 0), ("converted", 3.5), ("clicked", 7)], 6.91159, at(7)),
    ([("opened", 0), ("converted", 3.5), ("clicked", 7), ("complained", 14)], -0.11277, at(14)),
])
def test_folded_score(spark, fold, raw, anchor):
    e = events(spark, [(1, "email", t, at(d)) for t, d in fold])
    r = P.build_profiles(e, "2024-01-31").first()
    assert abs(r.engagement_score - raw) < 1e-5
    assert str(r.score_updated_at) == anchor
    s = P.decayed_score(e, "2024-01-31").first()
    assert abs(s.raw - raw) < 1e-5


def test_order_does_not_matter(spark):
    fold = [("opened", 4), ("converted", 5), ("clicked", 6), ("unsubscribed", 2)]
    scores = set()
    for order in list(permutations(fold))[::6]:
        e = events(spark, [(1, "email", t, at(d)) for t, d in order])
        scores.add(round(P.build_profiles(e, "2024-01-31").first().engagement_score, 9))
    assert len(scores) == 1


def test_counters_and_last(spark):
    rows = [(1, "email", t, at(i)) for i, t in enumerate(("sent", "delivered", "converted", "bounced"))]
    rows += [(1, "sms", "opened", at(1)), (1, "sms", "clicked", at(2))]
    r = P.build_profiles(events(spark, rows), "2024-01-31").first()
    assert (r.total_events, r.positive_events, r.negative_events, r.conversions) == (6, 3, 1, 1)
    assert (r.last_event_type, r.preferred_channel) == ("bounced", "sms")


def test_equal_times_keep_the_smaller_id(spark):
    rows = [(1, "email", "opened", T0), (1, "sms", "clicked", T0), (1, "push", "sent", T0)]
    assert P.last_event(events(spark, rows), "2024-01-31").first().last_event_type == "opened"
    assert P.build_profiles(events(spark, rows), "2024-01-31").first().last_event_type == "opened"


@pytest.mark.parametrize("cur, prior, want", [
    (0, 0, "stable"), (3, 1, "rising"), (1, 0, "rising"), (0, 2, "declining"), (2, 5, "declining"), (4, 4, "stable")])
def test_trend(spark, cur, prior, want):
    rows = [(1, "email", "opened", "2024-01-25")] * cur + [(1, "email", "clicked", "2024-01-18")] * prior
    rows += [(1, "email", "sent", "2024-01-26")]
    assert P.build_profiles(events(spark, rows), "2024-01-31").first().activity_trend == want


@pytest.mark.parametrize("counts, want", [
    ([("email", "opened", 2), ("email", "delivered", 9), ("sms", "clicked", 1)], "email"),
    ([("email", "sent", 3), ("sms", "delivered", 2)], None),
    ([("email", "bounced", 3)], None),
    ([("whatsapp", "opened", 2), ("email", "clicked", 2)], "email"),
])
def test_preferred_channel(spark, counts, want):
    df = spark.createDataFrame([(1, *c) for c in counts], "customer_id long, channel string, type string, n long")
    assert P.preferred_channel(df).first().preferred_channel == want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from(["email", "sms"]),
                          st.sampled_from(["sent", "opened", "clicked", "converted", "complained"]),
                          st.integers(0, 29), st.integers(0, 2)), min_size=1, max_size=30))
def test_merge_equals_rebuild(spark, rows):
    e = events(spark, [(c, ch, t, at(d)) for c, ch, t, d, _ in rows])
    load = F.element_at(F.array(*[F.lit(r[4]) for r in rows]), F.col("id").cast("int"))
    parts = [P.profile_partials(e.where(load == k), at(29.5)) for k in (2, 0, 1)]
    cells = parts[0].unionByName(parts[1]).unionByName(parts[2])
    merged = P.profiles_from_cells(P.merge_cells(cells), "2024-01-31", P.activity_trend(e, "2024-01-31"))
    def key(df):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)
    assert key(merged) == key(P.build_profiles(e, "2024-01-31"))


def test_thirty_events_count_thirty(spark):
    e = events(spark, [(9, "email", "opened", at(i % 20)) for i in range(30)])
    assert P.build_profiles(e, "2024-01-31").first().total_events == 30


def test_profile_is_two_hash_aggregates(spark):
    text = plan(P.build_profiles(events(spark, [(1, "email", "sent", T0)]), "2024-01-31"))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text and "Join" not in text
    assert text.count("Exchange") == 2 and "partial_sum" in text


def test_customer_profiles_zero_fill_and_maps(spark):
    e = events(spark, [(1, "email", "opened", at(3)), (1, "sms", "sent", at(4))])
    cust = spark.createDataFrame([(1, "c1"), (2, "c2")], "id long, external_id string").selectExpr(
        "*", "'' AS email", "'{}' AS attributes", "true AS is_active", "CAST(NULL AS timestamp) AS last_event_at")
    out = C.customer_profiles(cust, P.build_profiles(e, "2024-01-31"), e, "2024-01-31",
                              P.channel_counts(e, "2024-01-31")).orderBy("id").collect()
    assert out[0].channel_counts == {"email": {"opened": 1}, "sms": {"sent": 1}}
    assert (out[1].score, out[1].total_events, out[1].trend, out[1].channel_counts) == (0, 0, "stable", {})


def test_last_event_marker_never_moves_back(spark):
    cust = spark.sql("SELECT 1L AS id, TIMESTAMP '2024-01-20' AS last_event_at UNION ALL SELECT 2L, NULL")
    e = events(spark, [(1, "email", "sent", at(1)), (2, "email", "sent", at(2))])
    got = {r.id: str(r.last_event_at) for r in P.customer_last_event(cust, e, "2024-01-31").collect()}
    assert got == {1: "2024-01-20 00:00:00", 2: at(2)}


def test_sends_and_daily(spark):
    e = events(spark, [(1, "email", "sent", at(1), 5), (1, "email", "sent", at(1)), (1, "email", "opened", at(2), 5)])
    assert R.derive_sends(e).count() == 1
    d = R.campaign_daily(e)
    assert {(r.event_type, r["count"]) for r in d.collect()} == {("sent", 1), ("opened", 1)}
    assert {r["count"] for r in R.merge_daily(d, d).collect()} == {2}


def test_pages_join_up_to_the_whole_order(spark):
    rows = [(1, "email", "sent", at(i % 4)) for i in range(23)]
    e = events(spark, rows).select("id", "occurred_at")
    order = [("occurred_at", "desc"), ("id", "desc")]
    want = [r.id for r in e.orderBy(F.desc("occurred_at"), F.desc("id")).collect()]
    got, cursor = [], None
    while True:
        page = keyset_page(e, order, cursor, 5).orderBy("page_pos").collect()
        got += [r.id for r in page]
        if not page[-1].has_more:
            break
        cursor = (str(page[-1].occurred_at), page[-1].id)
    assert got == want
    assert [page_limit(n) for n in (None, 0, 7, 200)] == [50, 50, 7, 200]
    with pytest.raises(ValueError):
        page_limit(201)


@pytest.mark.parametrize("days", [["1970-01-01"], ["1970-01-01", "2024-01-05"], ["0001-02-03", "1999-12-31", "2023-12-31", "2024-01-30"]])
def test_scores_of_any_past_are_sums(spark, days):
    """No growth from a sum that has underflowed: equal to a direct sum at the newest event."""
    import math
    from datetime import datetime

    e = events(spark, [(1, "email", "clicked", d) for d in days])
    newest = datetime.fromisoformat(days[-1])
    want = sum(2.0 * math.exp(-math.log(2) / 1209600 * (newest - datetime.fromisoformat(d)).total_seconds()) for d in days)
    direct = P.decayed_score(e, "2024-01-31").first().raw
    assert P.build_profiles(e, "2024-01-31").first().engagement_score == pytest.approx(want) and direct == pytest.approx(want)
    cells = [P.profile_partials(e.where(F.col("id") % 2 == k), "2024-01-31") for k in (0, 1)]
    merged = P.profiles_from_cells(P.merge_cells(cells[0].unionByName(cells[1])), "2024-01-31")
    assert merged.first().engagement_score == pytest.approx(want)


def test_timelines_limit_groups_before_the_shuffle(spark):
    e = events(spark, [(1, "email", "sent", at(i)) for i in range(9)])
    camp = spark.createDataFrame([(1, "c")], "id long, external_id string")
    df = C.timelines(e, camp, 3)
    assert [r.pos for r in df.orderBy("pos").collect()] == [1, 2, 3]
    assert plan(df).count("WindowGroupLimit") == 2
