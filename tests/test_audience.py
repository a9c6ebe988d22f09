import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import audience as A
from tests.helpers import plan

AS_OF = "2024-01-31 00:00:00"
REQ = ("request_id long, objective string, channel string, size int, min_score double, last_active_days int, "
       "channels array<string>, exclude_campaign_ids array<string>, respect_frequency_cap boolean")


def request(spark, **over):
    base = dict(request_id=1, objective="conversion", channel="email", size=10, min_score=0.0, last_active_days=0,
                channels=[], exclude_campaign_ids=[], respect_frequency_cap=None)
    return spark.createDataFrame([tuple({**base, **over}.values())], REQ)


@pytest.mark.parametrize("over, error", [
    ({}, None),
    ({"objective": "fame"}, "objective must be one of conversion|engagement|retention|reactivation|awareness"),
    ({"channel": "fax"}, "channel must be one of email|sms|whatsapp|push|web"),
    ({"size": 0}, "size must be between 1 and 100000"), ({"size": 100001}, "size must be between 1 and 100000"),
    ({"min_score": -0.1}, "conditions.min_score must be >= 0"),
    ({"last_active_days": -1}, "conditions.last_active_days must be >= 0"),
    ({"channels": ["email", "pager"]}, 'conditions.channels contains invalid channel "pager"'),
])
def test_validation(spark, over, error):
    r = A.validate_audience_requests(request(spark, **over)).first()
    assert r.error == error and r.respect_cap is True


def test_top_k_equals_a_full_sort(spark):
    rng = random.Random(7)
    rows = [(i, 42.0 if i < 100 else rng.random() * 100) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, score double")
    want = [i for i, s in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert [r.id for r in A.top_k(df, 50).collect()] == want[:50]
    assert "TakeOrderedAndProject" in plan(A.top_k(df, 50))
    assert A.top_k(df, 0).count() == 0 and A.top_k(df, 5000).count() == 1000
    ties = spark.createDataFrame([(i, 1.0) for i in (5, 2, 8, 1)], "id long, score double")
    assert [r.id for r in A.top_k(ties, 3).collect()] == [1, 2, 5]


def test_dedup_keeps_the_best(spark):
    df = spark.createDataFrame([(1, c, r) for r, c in enumerate((1, 2, 1, 3), 1)],
                               "request_id long, customer_id long, rank int")
    assert [(r.customer_id, r["rank"]) for r in A.dedup_candidates(df).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 4)]


def score(spark, objective, raw=1.0, conv=0, pos=0, last=None):
    return spark.range(1).select(A.objective_score(
        F.lit(objective), F.lit(raw), F.lit(conv), F.lit(pos), F.lit(last).cast("timestamp"),
        F.lit(AS_OF).cast("timestamp")).alias("s")).first().s


def test_objectives_flip_the_order(spark):
    buyer, reader = dict(conv=5, pos=5), dict(conv=0, pos=40)
    assert score(spark, "conversion", **buyer) > score(spark, "conversion", **reader)
    assert score(spark, "engagement", **buyer) < score(spark, "engagement", **reader)
    assert score(spark, "reactivation", last="2023-11-01") > score(spark, "reactivation", last="2024-01-30")
    assert score(spark, "reactivation") == 1.0 and score(spark, "fame", conv=9) == 1.0 == score(spark, "awareness", pos=3)


def world(spark, n=40, sent=None):
    cust = spark.range(1, n + 1).select(
        "id", F.concat(F.lit("c"), "id").alias("external_id"), (F.col("id") % 10 != 0).alias("is_active"))
    prof = spark.range(1, n + 1).select(
        F.col("id").alias("customer_id"), (F.col("id") * 1.0).alias("engagement_score"),
        F.when(F.col("id") % 3 == 0, "sms").when(F.col("id") % 3 == 1, "email").alias("preferred_channel"),
        (F.col("id") % 4).alias("conversions"), (F.col("id") % 7).alias("positive_events"),
        F.lit(9).cast("long").alias("total_events"),
        F.when(F.col("id") % 8 != 0, F.lit("2024-01-29").cast("timestamp")).alias("last_event_at"),
        F.lit("rising").alias("activity_trend"))
    camp = spark.createDataFrame(
        [(1, "camp_001", "email", "conversion", "paused", 9, 168, "2024-01-05"),
         (2, "camp_002", "email", "conversion", "active", 2, 168, "2023-01-05")],
        "id long, external_id string, channel string, objective string, status string, frequency_cap int, "
        "frequency_window_hours int, t string").withColumn("created_at", F.col("t").cast("timestamp")).drop("t")
    rows = sent or [(39, 2, "2024-01-30"), (39, 1, "2024-01-29"), (38, 2, "2024-01-30"), (37, 1, "2023-01-01"),
                    (37, 1, "2023-01-02")]
    sends = spark.createDataFrame([(c, k, "email", t) for c, k, t in rows],
                                  "customer_id long, campaign_id long, channel string, t string")
    return cust, prof, sends.withColumn("sent_at", F.col("t").cast("timestamp")).drop("t"), camp


def recommend(spark, exact=False, w=None, decayed=False, **over):
    cand, meta = A.recommend_audience(request(spark, **over), *(w or world(spark)), AS_OF, exact, decayed)
    return cand.orderBy("rank").collect(), meta.first()


def test_cap_context_prefers_active(spark):
    r = A.cap_contexts(world(spark)[3]).first()
    assert (r.cap, r.window_hours) == (2, 168)
    other = A.cap_context(request(spark, channel="web"), world(spark)[3]).first()
    assert (other.cap, other.window_hours) == (3, 168)


def test_capped_customer_shows_only_without_the_cap(spark):
    on, _ = recommend(spark, size=5)
    off, _ = recommend(spark, size=5, respect_frequency_cap=False)
    assert 39 in [r.customer_id for r in off] and 39 not in [r.customer_id for r in on]
    assert [r["rank"] for r in on] == [1, 2, 3, 4, 5] and 38 in [r.customer_id for r in on]
    over = A.over_cap_customers(*world(spark), AS_OF).collect()
    assert [(r.customer_id, r.sends) for r in over] == [(39, 2)]


def test_conditions(spark):
    got, _ = recommend(spark, size=40, channels=["sms"], exclude_campaign_ids=["camp_002"])
    assert {r.customer_id for r in got} == {i for i in range(3, 41, 3) if i % 10 and i != 39}
    got, _ = recommend(spark, size=40, min_score=0.75, last_active_days=7, respect_frequency_cap=False)
    assert {r.customer_id for r in got} == {i for i in range(30, 41) if i % 10 and i % 8}


def test_pool_and_meta(spark):
    got, meta = recommend(spark, size=2)
    assert (meta.candidate_pool_size, meta.candidates_considered, meta.candidates_truncated) == (20, 20, True)
    assert meta.filtered_out == 18 and meta.shortfall_reason is None
    _, meta = recommend(spark, size=100)
    assert meta.candidates_considered == 36 and not meta.candidates_truncated
    assert meta.shortfall_reason == "frequency_cap_exhausted"


def test_exact_mode_looks_past_the_pool(spark):
    """A weak customer with many conversions wins only when every match is weighed."""
    cust, prof, sends, camp = world(spark)
    prof = prof.withColumn("conversions", F.when(F.col("customer_id") == 1, F.lit(1e60)).otherwise(F.lit(0.0)))
    prof = prof.withColumn("engagement_score", F.col("engagement_score") / 100)
    w = (cust, prof, sends, camp)
    assert 1 not in [r.customer_id for r in recommend(spark, w=w, size=2)[0]]
    got, meta = recommend(spark, exact=True, w=w, size=2)
    assert got[0].customer_id == 1 and meta.candidates_considered == 36


def test_decayed_scores_change_the_order(spark):
    """The highest stored score is the oldest one."""
    cust, prof, sends, camp = world(spark)
    prof = prof.withColumn("score_updated_at", F.when(F.col("customer_id") == 38, F.lit("2023-06-01")).otherwise(
        F.lit("2024-01-30")).cast("timestamp"))
    w = (cust, prof, sends, camp)
    over = dict(size=1, respect_frequency_cap=False, objective="awareness", exclude_campaign_ids=["camp_001"])
    assert recommend(spark, w=w, **over)[0][0].customer_id == 38
    assert recommend(spark, w=w, decayed=True, **over)[0][0].customer_id == 36


def test_request_passes_agree(spark, monkeypatch):
    """More requests than one broadcast may hold give the same rows."""
    reqs = request(spark).withColumn("request_id", F.explode(F.expr("sequence(1L, 9L)")))
    def rows():
        cand, _ = A.recommend_audience(reqs, *world(spark), AS_OF)
        return sorted((r.request_id, r["rank"], r.customer_id) for r in cand.collect())
    whole = rows()
    monkeypatch.setattr(A, "REQUESTS_PER_PASS", 2)
    assert rows() == whole and len(whole) == 90


def reasons(spark, **over):
    base = dict(request_id=1, objective="conversion", channel="email", weighted=3.0, rank=1, considered=100,
                preferred_channel="email", conversions=2, positive_events=4, total_events=40, activity_trend="stable")
    row = spark.createDataFrame([{**base, **{k: v for k, v in over.items() if k != "last"}}])
    row = row.withColumn("last_event_at", F.lit(over.get("last", "2024-01-28 12:00:00")).cast("timestamp"))
    return A.audience_reasons(row, AS_OF).first().reasons


def test_reasons(spark):
    assert reasons(spark) == ["score=0.75 top-quartile of 100 considered", "preferred_channel=email matches",
                              "converted 2x", "active 2d ago"]
    assert reasons(spark, rank=60, preferred_channel="sms", conversions=0) == ["score=0.75", "active 2d ago"]
    got = reasons(spark, objective="reactivation", rank=60, preferred_channel="", last="2023-12-17")
    assert got == ["score=0.75", "dormant 45d with 40 events history", "active 45d ago"]
    assert reasons(spark, considered=3, preferred_channel="", conversions=0, last=None) == [
        "score=0.75", "matches all audience filters"]
    assert len(reasons(spark, activity_trend="rising")) == 4


def test_plan_has_no_cross_join_and_cuts_groups_early(spark):
    cand, _ = A.recommend_audience(request(spark), *world(spark), AS_OF, exact=False)
    text = plan(cand)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert text.count("WindowGroupLimit") >= 4


def test_exact_fills_every_request_it_can(spark):
    """Two thirds of the best are over their cap: more than a reserve of 2 x size would have skipped."""
    cust, prof, sends, camp = world(spark)
    many = prof.where("customer_id >= 12").select("customer_id", F.explode(F.sequence(F.lit(1), F.lit(3)))).select(
        "customer_id", F.lit(1).cast("long").alias("campaign_id"), F.lit("email").alias("channel"),
        F.lit("2024-01-30 12:00:00").cast("timestamp").alias("sent_at"))
    sends = sends.unionByName(many, allowMissingColumns=True)
    reqs = request(spark, size=5)
    got = A.recommend_audience(reqs, cust, prof, sends, camp, AS_OF)[0]
    assert got.count() == 5 and got.where("customer_id >= 12").count() == 0
    text = plan(got)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "WindowGroupLimit" in text


def many_requests(spark, n):
    i = F.col("id")
    return spark.range(n).select(
        i.alias("request_id"), F.element_at(F.array(*[F.lit(o) for o in ("conversion", "engagement", "retention", "reactivation", "awareness")]),
                                            (i % 5 + 1).cast("int")).alias("objective"),
        F.element_at(F.array(*[F.lit(c) for c in ("email", "sms", "web")]), (i % 3 + 1).cast("int")).alias("channel"),
        (i % 9 + 1).cast("int").alias("size"), ((i * 7) % 90 / 100).alias("min_score"), (i % 4 * 3).cast("int").alias("last_active_days"),
        F.when(i % 6 == 0, F.array(F.lit("sms"), F.lit("email"))).otherwise(F.array().cast("array<string>")).alias("channels"),
        F.when(i % 4 == 1, F.array(F.lit("camp_002"))).when(i % 8 == 2, F.array(F.lit("camp_001"), F.lit("camp_002"))).otherwise(
            F.array().cast("array<string>")).alias("exclude_campaign_ids"),
        (i % 2 == 0).alias("respect_frequency_cap"))


def answers(spark, reqs, w):
    cand, meta = A.recommend_audience(reqs, *w, AS_OF)
    key = lambda r: str(r)
    return sorted(map(tuple, cand.collect()), key=key), sorted(map(tuple, meta.collect()), key=key)


def test_shared_lists_give_what_a_direct_join_gives(spark, monkeypatch):
    """Conditions of all kinds, in several bands: rows, reasons, counts and shortfalls are the same."""
    sent = [(c, 1 + c % 2, f"2024-01-{28 + c % 3}") for c in range(1, 300, 2)] * 2
    w = world(spark, 300, sent)
    reqs = many_requests(spark, 72)
    monkeypatch.setattr(A, "DIRECT_REQUESTS", 1000)
    want = answers(spark, reqs, w)
    monkeypatch.setattr(A, "DIRECT_REQUESTS", 0)
    monkeypatch.setattr(A, "FIRST_BAND", 20)
    got = answers(spark, reqs, w)
    assert got == want and len(got[0]) > 100
    assert answers(spark, reqs.where("request_id < 0"), w) == ([], [])


def test_rows_of_shared_lists_do_not_grow_with_customers_times_requests(spark, monkeypatch):
    n, requests = 20_000, 2_000
    cust, prof, sends, camp = world(spark, n)
    reqs = many_requests(spark, requests).withColumn("min_score", F.lit(0.0))
    valid = A.validate_audience_requests(reqs)
    contexts = A.cap_context(reqs.select("request_id", "channel", "objective"), camp).select("request_id", "cap", "window_hours")
    shape = A.RequestShape.of(valid)
    monkeypatch.setattr(A, "FIRST_BAND", 100)
    counted = []
    chosen, pool = A.shared_audience(valid, cust, prof, sends, camp, contexts, A.send_counts(sends, contexts, AS_OF), shape, AS_OF, counted)
    assert chosen.count() == reqs.agg(F.sum("size")).first()[0]
    assert pool.count() == requests and pool.agg(F.max("considered")).first()[0] > 10_000
    # A direct join makes some 18,000 rows a request; here all requests share 360 walks.
    assert sum(counted) <= 5 * n + requests * shape.max_size * 4
