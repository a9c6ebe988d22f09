import json

import pytest
from pyspark.sql import functions as F

from pulsegrid import vocab as V
from pulsegrid.operators import campaigns as K
from pulsegrid.operators import narrative as N
from tests.helpers import column

HEALTHY = dict(sent=1000, delivered=950, opened=300, clicked=60, converted=12, bounced=20, unsubscribed=4)
CASES = {
    "healthy": HEALTHY,
    "zero": {},
    "tiny": dict(sent=10, delivered=9, opened=4, clicked=1),
    "bouncing": dict(sent=1000, delivered=800, opened=100, clicked=5, converted=1, bounced=200, unsubscribed=40),
    "odd_clicks": dict(sent=100, delivered=90, opened=5, clicked=30, converted=2),
    "undelivered": dict(sent=50),
}


def facts(spark, counts=HEALTHY, objective="conversion"):
    camp = spark.createDataFrame([(7, "camp_007", objective)], "id long, external_id string, objective string")
    rows = [(7, "email", t, "2024-01-02", n) for t, n in counts.items()]
    daily = spark.createDataFrame(rows, "campaign_id long, channel string, event_type string, d string, count long")
    daily = daily.withColumn("day", F.col("d").cast("date")).drop("d")
    return N.campaign_facts(camp, K.campaign_metrics(camp, daily), K.campaign_channel_metrics(daily))


def test_facts(spark):
    f = facts(spark)
    r = f.first()
    assert (r.open_rate_pct, r.click_rate_pct, r.conversion_rate_pct, r.bounce_rate_pct, r.unsub_rate_pct) == (
        31.6, 6.3, 1.3, 2.0, 0.4)
    assert r.open_rate == 0.3158 and r.data_sufficient and r.by_channel["email"].open_rate_pct == 31.6
    doc = json.loads(f.select(N.facts_json(f).alias("j")).first().j)
    assert doc["campaign_id"] == "camp_007" and doc["by_channel"]["email"]["sends"] == 1000
    assert doc["benchmarks"]["unsub_rate_pct_bad"] == 0.5 and doc["first_event_at"] == "2024-01-02T00:00:00Z"


def collect_numbers(v, out):
    """Brute force over the parsed document."""
    import re
    if isinstance(v, bool) or v is None:
        return
    if isinstance(v, (int, float)):
        out.add(float(v))
    elif isinstance(v, str):
        out.update(float(m) for m in re.findall(r"\d+(?:\.\d+)?", v))
    else:
        for e in (v.values() if isinstance(v, dict) else v):
            collect_numbers(e, out)


@pytest.mark.parametrize("doc", [
    {"a1": 2, "b": [3.5, {"c9": "x 4 and 5.25", "d": -6}], "e": None, "f": True, "g": 1e-7, "k\"8": "q\"7: 9"},
    {"s": 'tail: 3"', "n": {"10": "ten"}}, [], 5])
def test_fact_numbers_at_any_depth(spark, doc):
    want = set()
    collect_numbers(doc, want)
    assert set(column(spark, [json.dumps(doc)], N.fact_numbers, "string")[0]) == want


def test_fact_numbers_of_broken_json(spark):
    assert column(spark, ['{"a": 1'], N.fact_numbers, "string") == [[]]


def test_numbers(spark):
    assert column(spark, ["-3.5% of 1,200 and 7."], N.numbers_in_text, "string") == [[3.5, 1.0, 200.0, 7.0]]
    allowed = F.array(F.lit(0.215), F.lit(40.0))
    got = column(spark, ["21.5% of 40, not 41 nor 0.4"], lambda t: N.unsupported_numbers(t, allowed), "string")
    assert got == [[41.0]]


def check(spark, raw, task="analyze"):
    f = facts(spark)
    rows = f.select(F.lit(raw if isinstance(raw, str) else json.dumps(raw)).alias("raw"), N.facts_json(f).alias("facts"))
    fn = N.validate_analyses if task == "analyze" else N.validate_recommendations
    return fn(rows).first().error


GOOD = {"summary": "1000 sends, 31.6% opened.", "strengths": ["Open rate beats 20%."], "weaknesses": [],
        "anomalies": [], "confidence": 0.8}


@pytest.mark.parametrize("raw, error", [
    (GOOD, None),
    ("```json\n" + json.dumps(GOOD) + "\n```", None),
    ("Sure! " + json.dumps(GOOD) + " Bye.", None),
    ({**GOOD, "summary": "0.316 of them"}, None),
    ("{broken", "ai: malformed analysis JSON"), ("[1]", "ai: malformed analysis JSON"),
    ({**GOOD, "summary": 5}, "ai: malformed analysis JSON"),
    ({**GOOD, "strengths": [1]}, "ai: malformed analysis JSON"),
    ({**GOOD, "summary": "  "}, "ai: analysis missing summary"), ("null", "ai: analysis missing summary"),
    ({k: v for k, v in GOOD.items() if k != "anomalies"}, "ai: analysis missing strengths/weaknesses/anomalies arrays"),
    ({**GOOD, "confidence": 1.5}, "ai: confidence 1.5 out of [0,1]"),
    ({**GOOD, "confidence": -0.1}, "ai: confidence -0.1 out of [0,1]"),
    ({**GOOD, "summary": "999999 sends"}, "ai: cited number 999999 not present in facts"),
    ({**GOOD, "weaknesses": ["Only 47 opens"]}, "ai: cited number 47 not present in facts"),
])
def test_validate_analyses(spark, raw, error):
    assert check(spark, raw) == error


REC = {"area": "timing", "suggestion": "Send later.", "reasoning": "Opens are at 31.6%.", "confidence": 0.5}


@pytest.mark.parametrize("recs, error", [
    ([REC], None), ([], "ai: empty recommendations"), (None, "ai: empty recommendations"),
    ([{**REC, "area": "creative"}], 'ai: recommendation 0 has invalid area "creative"'),
    ([REC, {**REC, "suggestion": " "}], "ai: recommendation 1 missing suggestion/reasoning"),
    ([{**REC, "confidence": 2}], "ai: recommendation 0 confidence 2 out of [0,1]"),
    ([{**REC, "reasoning": "777 clicks"}], "ai: cited number 777 not present in facts"),
    ([{**REC, "area": 4}], "ai: malformed recommendations JSON"), ("x", "ai: malformed recommendations JSON"),
    ([7], "ai: malformed recommendations JSON"),
])
def test_validate_recommendations(spark, recs, error):
    assert check(spark, {"recommendations": recs}, "recommend") == error


@pytest.mark.parametrize("name", CASES)
def test_rule_output_passes_its_own_check(spark, name):
    f = facts(spark, CASES[name])
    doc = N.facts_json(f).alias("facts")
    a = f.select("campaign_id", doc).join(N.rule_analysis(f), "campaign_id").select("facts", F.to_json(F.struct(
        "summary", "strengths", "weaknesses", "anomalies", "confidence")).alias("raw"))
    r = f.select("campaign_id", doc).join(N.rule_recommendations(f), "campaign_id").select(
        "facts", F.to_json(F.struct("recommendations")).alias("raw"))
    assert N.validate_analyses(a).first().error is None
    assert N.validate_recommendations(r).first().error is None


def analysis(spark, name):
    return N.rule_analysis(facts(spark, CASES[name])).first()


def test_rule_analysis(spark):
    zero = analysis(spark, "zero")
    assert zero.summary == "The campaign has no recorded events yet." and zero.confidence == 0.1
    assert analysis(spark, "healthy").confidence == 0.75 and not analysis(spark, "healthy").weaknesses
    tiny = analysis(spark, "tiny")
    assert tiny.confidence == 0.3 and "10 sends is below the 30 minimum" in tiny.weaknesses[-1]
    odd = analysis(spark, "odd_clicks")
    assert odd.anomalies == ["30 clicks exceed 5 opens, indicating inconsistent tracking."]
    assert round(odd.confidence, 9) == 0.65
    assert analysis(spark, "undelivered").anomalies[0] == "50 sends produced 0 deliveries."


def recs(spark, name, objective):
    return N.rule_recommendations(facts(spark, CASES[name], objective)).first().recommendations


def test_rule_recommendations(spark):
    assert [r.area for r in recs(spark, "healthy", "awareness")] == ["channel", "audience"]
    assert [r.area for r in recs(spark, "healthy", "conversion")] == ["audience", "channel"]
    assert [r.area for r in recs(spark, "zero", "conversion")] == ["strategy"]
    tiny = recs(spark, "tiny", "conversion")
    assert tiny[0].area == "segmentation" and tiny[-1].confidence == 0.3 and max(r.confidence for r in tiny) <= 0.35
    areas = [r.area for r in recs(spark, "bouncing", "engagement")]
    assert areas == ["timing", "risk", "risk", "segmentation"]


def test_output_quality(spark):
    df = spark.createDataFrame([("m", None), ("m", "bad"), (V.RULE_PROVIDER, None), (V.RULE_PROVIDER, None)],
                               "provider string, error string")
    got = {r.provider: r for r in N.output_quality(df).collect()}
    assert got["m"].invalid_rate == 0.5 and abs(got[V.RULE_PROVIDER].served_share - 2 / 3) < 1e-9
    assert got[V.RULE_PROVIDER].is_fallback


def test_digits_of_escapes_are_no_facts(spark):
    facts = r'{"name": "a \u0026 b \\ 5 \"7\"", "k": "\n31", "n": 7}'
    got = spark.range(1).select(N.fact_numbers(F.lit(facts)).alias("x")).first().x
    assert sorted(got) == [5.0, 7.0, 31.0]
    bad = spark.range(1).select(N.unsupported_numbers(F.lit("26 and 2600 of 31"), N.fact_numbers(F.lit(facts))).alias("x")).first().x
    assert bad == [26.0, 2600.0]
