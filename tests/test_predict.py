import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid import vocab as V
from pulsegrid.functions import scalars as S
from pulsegrid.functions.beta import best_probabilities, best_probabilities_in_batches, beta_table, summaries_in_batches
from pulsegrid.operators import dominance as N
from pulsegrid.operators import predict as B
from pulsegrid.plans.base import AS_OF, Tables
from pulsegrid.session import settle
from pulsegrid.sources import fixture as X
from tests.helpers import plan

SF = "/root/testdata/sf0.001"


def evidence(spark, channels, objective="conversion", scope="platform", **shared):
    """channels: {name: dict of evidence columns}."""
    rows = []
    for pos, (name, vals) in enumerate(channels.items()):
        full = {c: 0 for c in B.EVIDENCE} | shared | vals
        rows.append((1, pos, name, objective, scope, V.SUCCESS_EVENT[objective], 90, *[full[c] for c in B.EVIDENCE]))
    cols = "request_id long, pos int, channel string, objective string, scope string, success_event string, lookback_days int"
    return spark.createDataFrame(rows, cols + "".join(f", {c} long" for c in B.EVIDENCE)).withColumn(
        "audience_size", F.lit(None).cast("long"))


def obj(s, n, xs=0, xn=0, **more):
    return {"objective_successes": s, "objective_delivered": n, "other_successes": xs, "other_delivered": xn, **more}


def post(df):
    return {r.channel: r for r in B.posteriors(df).collect()}


def predicted(df):
    return {r.channel: r for r in B.predictions(df).collect()}


def test_shrinks_to_the_platform(spark):
    p = post(evidence(spark, {"email": obj(4000, 100000, 3000, 100000), "push": obj(0, 0)}))
    assert abs(p["email"]["mean"] - 0.04) < 1e-3 and abs(p["push"]["mean"] - 0.035) < 1e-3
    assert p["push"].a + p["push"].b < 200


def test_borrows_from_other_objectives(spark):
    p = post(evidence(spark, {"sms": obj(0, 0, 900, 10000), "email": obj(200, 10000, 200, 10000)}))
    assert p["sms"]["mean"] > 0.07


def test_defaults_and_clamp(spark):
    for objective, want in (("retention", 0.2), ("conversion", 0.02), ("engagement", 0.03)):
        assert B.platform_mean(evidence(spark, {"web": {}}, objective)).first().platform_mean == want
    p = post(evidence(spark, {"web": obj(50, 10)}))["web"]
    assert p.b > 0 and p["mean"] <= 1 and p.objective_delivered == 50


def test_success_event_and_clamp(spark):
    df = spark.createDataFrame([(o,) for o in (*V.OBJECTIVES, "fame")], "o string")
    assert [r.s for r in df.select(B.S.success_event(F.col("o")).alias("s")).collect()] == [
        "converted", "clicked", "opened", "opened", "opened", None]
    s, n = B.clamp_counts(F.lit(-3), F.lit(-9))
    assert tuple(spark.range(1).select(s, n).first()) == (0, 0)


def test_clear_winner(spark):
    got = predicted(evidence(spark, {c: obj(s, 100000) for c, s in (("email", 5000), ("sms", 1000), ("push", 500))}))
    e = got["email"]
    assert (e["rank"], e.recommended_channel, e.confidence) == (1, "email", "high") and e.prob_best > 0.99
    assert abs(sum(r.prob_best for r in got.values()) - 1) < 1e-3
    assert e.advice.startswith("Send on email: it has a 100.0% chance of the highest converted rate.")
    assert e.lower < e.predicted_rate < e.upper


def test_thin_data(spark):
    got = predicted(evidence(spark, {"email": obj(6, 150), "whatsapp": obj(5, 140)}))
    assert got["email"].confidence == "low" and "A/B" in got["email"].advice
    assert all(r.low_data and "low data: treat as a directional estimate" in r.reasons for r in got.values())


def test_customer_history_flips_the_answer(spark):
    base = {"email": obj(3000, 100000), "sms": obj(1000, 100000)}
    assert predicted(evidence(spark, base))["email"]["rank"] == 1
    own = {"email": base["email"] | {"target_successes": 0, "target_delivered": 40},
           "sms": base["sms"] | {"target_successes": 8, "target_delivered": 20}}
    got = predicted(evidence(spark, own, scope="customer"))
    assert got["sms"].recommended_channel == "sms"
    assert "customer history: 8 converted over 20 deliveries" in got["sms"].reasons


def test_untried_channel_stays_uncertain(spark):
    p = post(evidence(spark, {"email": obj(3000, 100000), "web": obj(3000, 100000)}, scope="customer"))
    assert p["web"].a + p["web"].b <= 30 + 1e-9 and abs(p["web"]["mean"] - 0.03) < 2e-3


def test_risk_compares_with_the_others(spark):
    base = obj(1000, 100000, delivered_all=100000, sent=100000)
    got = predicted(evidence(spark, {"email": base | {"opt_outs": 200}, "sms": base | {"opt_outs": 3000}}))
    assert not any("opt-out" in r for r in got["email"].reasons)
    assert any(r.startswith("high opt-out risk: 3.0% unsubscribes/complaints vs 0.2%") for r in got["sms"].reasons)


def test_single_channel(spark):
    r = predicted(evidence(spark, {"web": obj(1, 10)}))["web"]
    assert (r.confidence, r.advice) == ("high", "Only web was evaluated.")


SETS = [
    [(2.0, 50.0), (30.0, 700.0), (0.6, 29.4)], [(1e5, 1e6), (20.0, 300.0), (3.0, 40.0)],
    [(0.05, 29.95), (0.6, 29.4), (0.3, 29.7), (1.2, 28.8), (5.0, 60.0)], [(4.0, 6.0)], [(3.0, 9.0)] * 2,
    [(5e6, 4e7), (5.002e6, 4e7)], [(0.003, 29.997)] * 5, [(20.0, 0.5), (9.0, 0.2)],
]


def summaries(spark, sets):
    df = spark.createDataFrame([(i, [a for a, _ in s], [b for _, b in s]) for i, s in enumerate(sets)], "i int, a array<double>, b array<double>")
    tables = df.withColumn("t", F.zip_with("a", "b", lambda a, b: beta_table(a, b, *V.INTERVAL)))
    return [tuple(np.array(x) for x in r[1:]) for r in sorted(
        tables.select("i", "t.lower", "t.upper", best_probabilities(F.col("t")).alias("p")).collect())]


def test_summary_matches_draws(spark):
    """Within 0.02 of 4,000 draws, and within 0.005 of 400,000, from very sharp to very wide posteriors."""
    rng = np.random.default_rng(20240131)
    for s, (lower, upper, p) in zip(SETS, summaries(spark, SETS)):
        a, b = np.array(s).T
        for n, near in ((V.SAMPLES, 0.02), (400_000, 0.005)):
            draws = rng.beta(a[:, None], b[:, None], size=(len(s), n))
            wins = np.bincount(draws.argmax(axis=0), minlength=len(s)) / n
            assert np.abs(p - wins).max() < near
            assert np.abs(lower - np.quantile(draws, 0.05, axis=1)).max() < near
            assert np.abs(upper - np.quantile(draws, 0.95, axis=1)).max() < near
        assert abs(p.sum() - 1) < 1e-9 and (lower <= upper).all() and (p >= 0).all()


def test_equal_posteriors_are_equally_good(spark):
    (_, _, two), (_, _, five), (_, _, one) = summaries(spark, [SETS[4], SETS[6], SETS[3]])
    assert two[0] == two[1] == 0.5 and np.ptp(five) < 1e-12 and one[0] == 1


def test_summary_stays_in_the_jvm(spark):
    posts = B.posteriors(evidence(spark, {"email": obj(6, 150), "sms": obj(5, 140)}))
    assert "Python" not in plan(B.simulate(posts))


def dominated(cells, asked):
    out = {}
    for q, i, j, w in asked:
        for ci, cj, cw, channel, n in cells:
            if ci > 0 and ci >= i and cj <= j and cw <= w:
                out[q, channel] = out.get((q, channel), 0) + n
    return out


def test_dominance_counts_match_all_pairs(spark):
    rng = random.Random(4)
    for reach in (1, 2, 13, 400):
        cells = [(rng.randrange(0, 30), rng.randrange(0, reach + 3), rng.randrange(0, 366), rng.choice(["", "sms"]), rng.randrange(1, 9)) for _ in range(300)]
        asked = [(q, rng.randrange(1, 31), rng.randrange(0, reach + 1), rng.choice([1, 90, 365])) for q in range(40)]
        got = N.dominance_counts(spark.createDataFrame(cells, "i int, j int, w int, channel string, n long"),
                                 spark.createDataFrame(asked, "request_id long, i int, j int, w int"), ("n",), ("", "sms")).collect()
        assert {(r.request_id, r.channel): r.n for r in got if r.n} == dominated(cells, asked)


def test_places_match_plain_counts(spark):
    floors = [-S.MAX_DOUBLE, 0.0, 0.5, 0.5, 1.0, 1.0000001, 7.5, 7.6, 990.0, 1e12]
    scores = [-5.0, 0.0, 0.4999, 0.5, 0.75, 1.0, 1.00000005, 7.55, 7.6, 989.9, 1e12, 1e300]
    ranges = N.score_ranges(spark.createDataFrame([(f,) for f in floors], "floor double"))
    rows = N.placed(spark.createDataFrame([(s,) for s in scores], "score double"), ranges, "score", "i").collect()
    assert {r.score: r.i for r in rows} == {s: sum(f <= s for f in set(floors)) for s in scores}
    assert ranges.agg(F.max(F.size("floors"))).first()[0] <= 2


def test_many_audiences_cost_rows_plus_requests(spark):
    """2,000 audiences with 2,000 different floors: rows grow with members and requests, not with their product."""
    members, n = 3000, 2000
    aud = spark.range(n).select(F.col("id").alias("request_id"), S.raw_min_score(F.col("id") / (n + 1)).alias("floor"),
                                (F.col("id") % 40 + 1).cast("int").alias("j"), (F.col("id") % 300 + 1).cast("int").alias("w"))
    ranges = N.score_ranges(aud)
    asked = N.placed(aud, ranges, "floor", "i")
    rows = spark.range(members).select((F.col("id") % 997 / 9).alias("score"), (F.col("id") % 60).cast("int").alias("j"),
                                       (F.col("id") % 366).cast("int").alias("w"), F.lit("sms").alias("channel"), F.lit(1).cast("long").alias("n"))
    cells = N.placed(rows, ranges, "score", "i")
    assert asked.count() == n and cells.count() == members
    sums, wanted = N.crossings(cells.select("i", "j", "w", "channel", "n"), asked, ("n",))
    bits = (40).bit_length() * (300).bit_length()
    assert sums.count() <= members * bits / 2 and wanted.count() <= n * bits / 2
    got = {r.request_id: r.n for r in N.dominance_counts(cells, asked, ("n",), ("sms",)).collect()}
    asks, held = asked.select("request_id", "floor", "j", "w").collect(), rows.collect()
    for r in asks[::97]:
        assert got.get(r.request_id, 0) == sum(m.score >= r.floor and m.j <= r.j and m.w <= r.w for m in held)
    assert "sequence(" not in plan(sums)


def test_batches_integrate_as_columns_do(spark):
    rng = random.Random(11)
    rows = [(n, [10 ** rng.uniform(-1, 5) for _ in range(5)], [10 ** rng.uniform(-1, 5) for _ in range(5)]) for n in range(250)]
    rows += [(250, [3.0] * 5, [40.0] * 5), (251, [3.0, 3.0, 9.0, 9.0, 1.0], [40.0, 40.0, 90.0, 90.0, 30.0])]
    df = spark.createDataFrame(rows, "i long, a array<double>, b array<double>")
    tables = df.withColumn("t", F.zip_with("a", "b", lambda a, b: beta_table(a, b, *V.INTERVAL)))
    got = tables.select("i", best_probabilities(F.col("t")).alias("p"), best_probabilities_in_batches(F.col("t")).alias("q")).collect()
    assert max(abs(p - q) for r in got for p, q in zip(r.p, r.q)) < 1e-9
    same = {r.i: r.q for r in got}
    assert len(set(same[250])) == 1 and same[251][0] == same[251][1] and same[251][2] == same[251][3]


def test_summaries_of_parameters_are_those_of_tables(spark):
    rng = random.Random(12)
    rows = [(n, [10 ** rng.uniform(-1, 5) for _ in range(5)], [10 ** rng.uniform(-1, 5) for _ in range(5)]) for n in range(150)]
    df = spark.createDataFrame(rows, "i long, a array<double>, b array<double>")
    tables = df.withColumn("t", F.zip_with("a", "b", lambda a, b: beta_table(a, b, *V.INTERVAL)))
    for r in tables.select(B.summary(F.col("t")).alias("x"), summaries_in_batches(F.col("a"), F.col("b"), *V.INTERVAL).alias("y")).collect():
        for name in ("lower", "upper", "prob_best"):
            assert [x[name] for x in r.x] == pytest.approx(list(r.y[name]), abs=1e-9)


def few_and_many(spark, requests, limit, monkeypatch):
    t = Tables(spark, SF)
    monkeypatch.setattr(B, "FEW_AUDIENCES", limit)
    asked = B.normalize_prediction_requests(requests)
    return sorted(tuple(r) for r in B.audience_evidence(asked, B.target_daily(t.events, AS_OF), t.profiles, t.customers, AS_OF).collect())


def test_few_audiences_count_as_many_do(spark, monkeypatch):
    """Conditions on members and counts by dominance agree; an audience that nobody fits has zeros."""
    reqs = X.prediction_requests(spark, SF)
    nobody = reqs.where("audience IS NOT NULL").limit(1).withColumns({
        "request_id": F.lit(999).cast(reqs.schema["request_id"].dataType),
        "audience": F.struct(F.lit(99.999).alias("min_score"), F.lit(1).alias("last_active_days"))})
    reqs = reqs.unionByName(nobody)
    few = few_and_many(spark, reqs, 64, monkeypatch)
    assert few == few_and_many(spark, reqs, 0, monkeypatch) and len({r[0] for r in few}) > 2
    assert sum(r[1] for r in few) > 0


def test_no_audience_has_no_rows(spark, monkeypatch):
    none = X.prediction_requests(spark, SF).where("audience IS NULL")
    assert few_and_many(spark, none, 64, monkeypatch) == []


def test_partitioning_does_not_change_the_summary(spark):
    posts = B.posteriors(evidence(spark, {"email": obj(6, 150), "sms": obj(5, 140)}))
    got = {tuple(sorted(tuple(r) for r in B.simulate(posts.repartition(n)).collect())) for n in (1, 3)}
    assert len(got) == 1


@pytest.fixture(scope="module")
def asked(spark):
    t = Tables(spark, SF)
    return t, X.prediction_requests(spark, SF)


def test_requests_end_to_end(spark, asked):
    t, reqs = asked
    rows = B.predict_channels(reqs, t.events, t.profiles, t.customers, t.daily, t.campaigns, AS_OF).collect()
    by_request = {}
    for r in rows:
        by_request.setdefault(r.request_id, []).append(r)
    assert len(by_request) == 25
    for group in by_request.values():
        ranked = sorted(group, key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, len(group) + 1))
        assert {r.recommended_channel for r in group} == {ranked[0].channel}
        assert [r.predicted_rate for r in ranked] == sorted((r.predicted_rate for r in group), reverse=True)
        assert all(r.reasons and r.lower <= r.upper for r in group)
        assert all((r.target_delivered is None) == (r.scope == "platform") for r in group)


def test_all_customers_equal_single_requests(spark, asked):
    """The shared integrals of the batch form give what one request per customer gives."""
    t, _ = asked
    every = {(r.customer, r.objective): r for r in B.predict_all_customers(
        t.customers, t.events, t.daily, t.campaigns, AS_OF).collect()}
    assert len(every) == 5 * t.customers.count()
    reqs = t.customers.select(
        F.col("id").alias("request_id"), F.lit("engagement").alias("objective"),
        F.array().cast("array<string>").alias("channels"), F.col("external_id").alias("customer_id"),
        F.lit(None).cast("struct<min_score: double, last_active_days: int>").alias("audience"),
        F.lit(90).alias("lookback_days"))
    rows = B.predict_channels(reqs, t.events, t.profiles, t.customers, t.daily, t.campaigns, AS_OF).where("rank = 1")
    for r in rows.collect():
        e = every[(f"cust_{r.request_id:05d}", "engagement")]
        assert (e.recommended_channel, e.confidence, e.advice) == (r.recommended_channel, r.confidence, r.advice)
        assert (e.predicted_rate, e.prob_best, e.lower, e.upper) == (r.predicted_rate, r.prob_best, r.lower, r.upper)


def test_all_customers_shuffle_no_tables_and_read_events_once(spark, asked, monkeypatch):
    """No Beta table leaves its batch, the last join reads stored counts, and only frequent patterns are repeated."""
    t, _ = asked
    kept = {}

    def keep(df, name):
        kept[name] = settle(df, name)
        return kept[name]

    monkeypatch.setattr(B, "settle", keep)
    out = B.predict_all_customers(t.customers, t.events, t.daily, t.campaigns, AS_OF)
    text = plan(out)
    assert "below" not in text and "SortMergeJoin [a#" not in text
    reads = [line for line in text.splitlines() if "Scan parquet" in line or "FileScan parquet" in line]
    assert sum("events.parquet" in line for line in reads) <= 1  # the platform's rollup only
    rows = kept["patterns"].agg(F.sum("rows")).first()[0]
    assert rows == out.count() == 5 * t.customers.count()


def test_unknown_customer_has_no_rows(spark, asked):
    t, reqs = asked
    lost = reqs.limit(1).withColumns({"customer_id": F.lit("nobody"), "audience": F.lit(None).cast(
        "struct<min_score: double, last_active_days: int>"), "lookback_days": F.lit(30)})
    ev = B.channel_evidence(B.normalize_prediction_requests(lost), t.events, t.profiles, t.customers, t.daily,
                            t.campaigns, AS_OF)
    assert ev.count() == 0
