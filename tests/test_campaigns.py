import pytest

from pulsegrid.operators import campaigns as K

DAILY = "campaign_id long, channel string, event_type string, day date, count long"


def daily(spark, rows):
    df = spark.createDataFrame(rows, DAILY.replace("date", "string"))
    return df.withColumn("day", df.day.cast("date"))


def camps(spark, rows=((1, "active"), (2, "paused"))):
    return spark.createDataFrame([(i, f"camp_{i:03d}", s) for i, s in rows], "id long, external_id string, status string")


PIVOT = [
    ("email", "sent", 100), ("email", "delivered", 95), ("email", "opened", 40), ("email", "clicked", 10),
    ("email", "converted", 4), ("email", "bounced", 5), ("email", "unsubscribed", 2), ("email", "complained", 1),
    ("sms", "sent", 50), ("sms", "delivered", 50), ("sms", "opened", 20), ("sms", "converted", 3),
]


def test_pivot_and_rates(spark):
    d = daily(spark, [(1, c, t, "2024-01-01", n) for c, t, n in PIVOT])
    m = K.campaign_metrics(camps(spark), d).orderBy("campaign_id").collect()
    assert m[0][1:8] == (150, 145, 60, 10, 7, 5, 2) and abs(m[0].open_rate - 60 / 145) < 1e-12
    assert m[1].sends == 0 and m[1].open_rate == 0.0
    ch = {r.channel: r for r in K.campaign_channel_metrics(d).collect()}
    assert ch["email"].complained == 1 and ch["sms"].open_rate == 0.4
    nested = K.by_channel(K.campaign_channel_metrics(d)).first().by_channel
    assert nested["email"].sends == 100 and set(nested) == {"email", "sms"}


def test_baseline(spark):
    rows = [("sent", 1000), ("delivered", 900), ("opened", 225), ("clicked", 45), ("converted", 9)]
    d = daily(spark, [(1, "email", t, "2024-01-01", n) for t, n in rows])
    assert tuple(K.platform_baseline(d).first()) == (0.25, 0.05, 0.01)
    assert tuple(K.platform_baseline(d.where("false")).first()) == (0, 0, 0)


def metrics(spark, delivered=0, open_rate=0.0, bounces=0, sends=0):
    return spark.createDataFrame([(1, sends, delivered, bounces, open_rate)],
                                 "campaign_id long, sends long, delivered long, bounces long, open_rate double")


@pytest.mark.parametrize("own, base, delivered, want", [
    (0.11, 0.24, 100, "open_rate 11% vs platform avg 24% (-54%)"), (0.15, 0.30, 100, None), (0.0, 0.3, 0, None),
    (0.1, 0.0, 100, None)])
def test_open_rate_rule(spark, own, base, delivered, want):
    b = spark.createDataFrame([(base,)], "open_rate double")
    assert K.anomaly_open_rate(metrics(spark, delivered, own), b).first().anomaly == want


@pytest.mark.parametrize("bounces, want", [
    (60, "bounce_rate 6.0% exceeds 5% threshold (60 bounces / 1000 sends)"), (50, None)])
def test_bounce_rule(spark, bounces, want):
    assert K.anomaly_bounce_rate(metrics(spark, bounces=bounces, sends=1000)).first().anomaly == want


@pytest.mark.parametrize("days, want", [
    ([5, 5, 5, 5, 50], "conversions spiked: 50 on 2026-09-20 vs mean 5.0/day (σ=0.0, >3σ)"), ([1, 100], None),
    ([5, 5, 5], None)])
def test_spike_rule(spark, days, want):
    first = 21 - len(days)
    df = daily(spark, [(1, "email", "converted", f"2026-09-{first + i}", n) for i, n in enumerate(days)])
    assert K.anomaly_conversion_spike(K.daily_conversions(df)).first().anomaly == want


@pytest.mark.parametrize("prior", [[1, 2, 1, 1, 1, 2, 1, 1, 2, 2, 2, 2], [1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 1], [2, 2, 2, 3, 2, 3, 3, 3]])
def test_spike_on_the_limit_does_not_depend_on_row_order(spark, prior):
    """Mean + 3 deviations is 3 (or 4) exactly; summed in doubles, the deviation falls short in some orders."""
    limit = max(prior) + 1
    for last in (limit, limit + 1):
        df = daily(spark, [(1, "email", "converted", f"2026-09-{i + 1:02d}", n) for i, n in enumerate([*prior, last])]).coalesce(1)
        days = df.select("campaign_id", "day", df["count"].alias("n"))
        text = K.anomaly_conversion_spike(days).first().anomaly
        assert (text is not None) == (last > limit)
        found = K.campaign_analytics(camps(spark), df, "2026-09-30").where("campaign_id = 1").first().anomalies
        assert any(a.startswith("conversions spiked") for a in found) == (last > limit)


def test_all_anomalies_in_rule_order(spark):
    rows = [(1, "email", "sent", "2024-01-01", 1000), (1, "email", "delivered", "2024-01-01", 900),
            (1, "email", "opened", "2024-01-01", 90), (1, "email", "bounced", "2024-01-01", 80),
            (2, "sms", "delivered", "2024-01-01", 900), (2, "sms", "opened", "2024-01-01", 450)]
    out = K.campaign_analytics(camps(spark), daily(spark, rows), "2024-01-31").orderBy("campaign_id").collect()
    assert [a.split()[0] for a in out[0].anomalies] == ["open_rate", "bounce_rate", "zero"]
    assert out[1].anomalies == []


def test_list_filters(spark):
    c = spark.createDataFrame([(i, f"camp_{i}", f"n{i}", "conversion", "email", "active" if i % 2 else "paused")
                               for i in range(1, 8)],
                              "id long, external_id string, name string, objective string, channel string, status string"
                              ).selectExpr("*", "CAST(NULL AS timestamp) AS started_at")
    d = daily(spark, [(1, "email", "sent", "2024-01-01", 3)])
    page = K.list_campaigns(c, d, status="active", limit=2).orderBy("id").collect()
    assert [(r.id, r.sends, r.has_more) for r in page] == [(1, 3, True), (3, 0, True)]
    assert [r.id for r in K.list_campaigns(c, d, status="active", after=3, limit=2).orderBy("id").collect()] == [5, 7]
    with pytest.raises(ValueError):
        K.list_campaigns(c, d, status="lost")
    with pytest.raises(ValueError):
        K.list_campaigns(c, d, channel="fax")
