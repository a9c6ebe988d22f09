"""Queries and oracles: facts, rule narratives and fact checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import vocab as V
from pulsegrid.functions import scalars as S
from pulsegrid.operators import campaigns as K
from pulsegrid.operators import narrative as N
from pulsegrid.plans.base import EVD, Tables, flat, sql
from pulsegrid.plans.campaign_plans import _COUNTS, METRICS
from pulsegrid.session import spread
from pulsegrid.sources import fixture as X


def _facts(spark, sf):
    t = Tables(spark, sf)
    return N.campaign_facts(t.campaigns, K.campaign_metrics(t.campaigns, t.daily), K.campaign_channel_metrics(t.daily))


def n1_campaign_facts(spark, sf):
    return flat(_facts(spark, sf).drop("by_channel", "benchmarks"))


def n2_rule_analysis(spark, sf):
    return flat(N.rule_analysis(_facts(spark, sf)))


def n3_rule_recommendations(spark, sf):
    out = N.rule_recommendations(_facts(spark, sf))
    rows = out.select("campaign", F.posexplode("recommendations").alias("pos", "r")).select("campaign", "pos", "r.*")
    return flat(rows)


def _texts(spark, sf):
    """Every document text of the corpus."""
    return X.raw(spark, sf, "documents").select("doc_id", "text")


def n4_numbers_in_text(spark, sf):
    d = _texts(spark, sf).withColumn("n", N.numbers_in_text(F.col("text")))
    return flat(d.select(
        "doc_id", F.size("n").alias("numbers"),
        F.aggregate("n", F.lit(0.0), lambda a, x: F.greatest(a, x)).alias("largest")))


def n5_fact_numbers(spark, sf):
    f = _facts(spark, sf)
    nums = f.select("campaign", F.explode(N.fact_numbers(N.facts_json(f))).alias("n"))
    return flat(nums)


def n6_unsupported_numbers(spark, sf):
    """Document numbers that are no page size, percentage of it or hundredfold of it."""
    allowed = F.array(*[F.lit(float(x)) for x in (1, 2, 3, 5, 10, 24, 30, 50, 100, 2024)])
    bad = N.unsupported_numbers(F.col("text"), allowed)
    return flat(_texts(spark, sf).select("doc_id", F.size(bad).alias("unsupported")))


def s15_truncate_text(spark, sf):
    return flat(_texts(spark, sf).select("doc_id", S.truncate_text(F.col("text"), 120).alias("cut")))


def _outputs(spark, sf, analysis: bool):
    """One model output per event: the rule narrative of a campaign, edited in eight ways."""
    f = _facts(spark, sf)
    facts = f.select("campaign_id", N.facts_json(f).alias("facts"))
    facts = facts.withColumn("fact_numbers", N.fact_numbers(F.col("facts")))
    if analysis:
        body = N.rule_analysis(f)
    else:
        body = N.rule_recommendations(f)
    e = spread(X.raw(spark, sf, "events")).select(
        F.col("event_id").alias("output_id"), (F.col("event_id") % 20).alias("campaign_id"),
        (F.col("event_id") % 8).alias("edit"),
        X.pick(["model-a", "model-b", V.RULE_PROVIDER], F.col("event_id")).alias("provider"),
    )
    j = e.join(body.drop("campaign"), "campaign_id").join(facts, "campaign_id")
    edit = F.col("edit")
    if analysis:
        summary = F.when(edit == 4, " ").when(edit == 7, F.concat("summary", F.lit(" 999999 sends"))).otherwise(
            F.col("summary"))
        doc = F.to_json(F.struct(
            summary.alias("summary"), F.when(edit != 5, F.col("strengths")).alias("strengths"), "weaknesses",
            "anomalies", F.when(edit == 6, F.lit(1.5)).otherwise(F.col("confidence")).alias("confidence")))
    else:
        def changed(r, i):
            first = i == 0
            return F.struct(
                F.when(first & (edit == 4), "creative").otherwise(r["area"]).alias("area"),
                F.when(first & (edit == 5), " ").otherwise(r["suggestion"]).alias("suggestion"),
                F.when(first & (edit == 7), "777777 clicks").otherwise(r["reasoning"]).alias("reasoning"),
                F.when(first & (edit == 6), F.lit(2.0)).otherwise(r["confidence"]).alias("confidence"))

        doc = F.to_json(F.struct(F.transform("recommendations", changed).alias("recommendations")))
    raw = (
        F.when(edit == 1, F.concat(F.lit("```json\n"), doc, F.lit("\n```")))
        .when(edit == 2, F.concat(F.lit("Here it is: "), doc, F.lit(" Done.")))
        .when(edit == 3, "no JSON at all").otherwise(doc)
    )
    return j.select("output_id", "provider", raw.alias("raw"), "facts", "fact_numbers")


def n7_validate_analyses(spark, sf):
    return flat(N.validate_analyses(_outputs(spark, sf, True)), "output_id", "error")


def n8_validate_recommendations(spark, sf):
    return flat(N.validate_recommendations(_outputs(spark, sf, False)), "output_id", "error")


def n9_output_quality(spark, sf):
    return flat(N.output_quality(N.validate_analyses(_outputs(spark, sf, True))))


QUERIES = {
    f.__name__: f
    for f in (
        n1_campaign_facts, n2_rule_analysis, n3_rule_recommendations, n4_numbers_in_text, n5_fact_numbers,
        n6_unsupported_numbers, s15_truncate_text, n7_validate_analyses, n8_validate_recommendations, n9_output_quality,
    )
}

FACTS = METRICS + """,
fc AS (
  SELECT campaign_id AS id, ca.ext AS campaign, objective, sends, delivered, opens, clicks, conversions, bounces,
    unsubscribes, open_rate AS r1, click_rate AS r2, conversion_rate AS r3,
    floor(open_rate * 1000 + 0.5) / 10 AS op, floor(click_rate * 1000 + 0.5) / 10 AS cp,
    floor(conversion_rate * 1000 + 0.5) / 10 AS vp,
    floor(CASE WHEN sends > 0 THEN bounces::DOUBLE / sends ELSE 0 END * 1000 + 0.5) / 10 AS bp,
    floor(CASE WHEN delivered > 0 THEN unsubscribes::DOUBLE / delivered ELSE 0 END * 1000 + 0.5) / 10 AS up,
    first_day, last_day
  FROM met JOIN ca ON ca.id = campaign_id)"""


def _s(x: str) -> str:
    return f"regexp_replace({x}::VARCHAR, '\\.0$', '')"


_ANOMALIES = f"""list_filter([
  CASE WHEN delivered = 0 THEN sends || ' sends produced ' || delivered || ' deliveries.' END,
  CASE WHEN clicks > opens THEN clicks || ' clicks exceed ' || opens || ' opens, indicating inconsistent tracking.' END,
  CASE WHEN bp > 5 THEN 'Bounce rate ' || {_s('bp')} || '% exceeds the 5% threshold, suggesting list-quality issues.' END
  ], lambda x: x IS NOT NULL)"""

_JUDGED = (("Open rate", "op", 20), ("Click rate", "cp", 3), ("Conversion rate", "vp", 1))
_STRONG = ",".join(
    f"CASE WHEN {c} >= {b} THEN '{n} ' || {_s(c)} || '% meets or beats the {b}% benchmark.' END" for n, c, b in _JUDGED)
_WEAK = ",".join(
    f"CASE WHEN {c} < {b} THEN '{n} ' || {_s(c)} || '% is below the {b}% benchmark.' END" for n, c, b in _JUDGED)

RECS = f"""
rec AS (
  SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY
      CASE WHEN area = CASE objective WHEN 'conversion' THEN 'segmentation' WHEN 'engagement' THEN 'timing'
        WHEN 'retention' THEN 'risk' WHEN 'reactivation' THEN 'audience' WHEN 'awareness' THEN 'channel' END
      THEN 0 ELSE 1 END, ord) - 1 AS pos
  FROM (
    SELECT campaign, objective, sends, ord, area, suggestion, reasoning,
      CASE WHEN sends < 30 AND ord < 9 THEN least(conf, 0.35) ELSE conf END AS confidence
    FROM (
      SELECT campaign, objective, sends, 1 AS ord, 'risk' AS area,
        'Suppress hard-bouncing addresses and re-verify the acquisition source before the next send.' AS suggestion,
        'Bounce rate ' || {_s('bp')} || '% exceeds the 5% threshold.' AS reasoning, 0.8 AS conf FROM fc WHERE bp > 5
      UNION ALL SELECT campaign, objective, sends, 2, 'risk',
        'Reduce send frequency and add a preference check to the target segment.',
        'Unsubscribe rate ' || {_s('up')} || '% exceeds the 0.5% threshold.', 0.7 FROM fc WHERE up > 0.5
      UNION ALL SELECT campaign, objective, sends, 3, 'timing',
        'Split-test subject lines and send-time windows on a holdout slice.',
        'Open rate ' || {_s('op')} || '% is below the 20% benchmark.', 0.6 FROM fc WHERE op < 20
      UNION ALL SELECT campaign, objective, sends, 4, 'strategy',
        'Strengthen the primary call-to-action and tighten message-to-audience relevance.',
        'Open rate ' || {_s('op')} || '% is healthy but click rate ' || {_s('cp')} || '% trails the 3% benchmark.', 0.6
        FROM fc WHERE op >= 20 AND cp < 3
      UNION ALL SELECT campaign, objective, sends, 5, 'segmentation',
        'Narrow targeting to recently engaged, high-score customers.',
        'Conversion rate ' || {_s('vp')} || '% is below the 1% benchmark.', 0.55 FROM fc WHERE vp < 1
      UNION ALL SELECT campaign, objective, sends, 6, 'audience',
        'Expand reach with a lookalike audience built from converted customers.',
        'All rates are at or above benchmark: open ' || {_s('op')} || '%, click ' || {_s('cp')} || '%, conversion '
          || {_s('vp')} || '%.', 0.5 FROM fc WHERE bp <= 5 AND up <= 0.5 AND op >= 20 AND cp >= 3 AND vp >= 1
      UNION ALL SELECT campaign, objective, sends, 7, 'channel',
        'Test one adjacent channel against the current best performer.',
        'Performance is healthy, so incremental channel testing can lift total conversions.', 0.4
        FROM fc WHERE bp <= 5 AND up <= 0.5 AND op >= 20 AND cp >= 3 AND vp >= 1
      UNION ALL SELECT campaign, objective, sends, 9, 'strategy',
        'Collect more campaign events before committing additional budget.',
        'Only ' || sends || ' sends observed; the minimum reliable sample is 30.', 0.3 FROM fc WHERE sends < 30)))"""

_NUMS = r"""list_transform(regexp_extract_all(text, '\d+(?:\.\d+)?'), lambda x: x::DOUBLE)"""

_BAD7 = """CASE i % 8 WHEN 3 THEN 'ai: malformed analysis JSON' WHEN 4 THEN 'ai: analysis missing summary'
  WHEN 5 THEN 'ai: analysis missing strengths/weaknesses/anomalies arrays'
  WHEN 6 THEN 'ai: confidence 1.5 out of [0,1]' WHEN 7 THEN 'ai: cited number 999999 not present in facts' ELSE '' END"""

ORACLES = {
    "n1_campaign_facts": sql(
        """SELECT id AS campaign_id, campaign, objective, sends, delivered, opens, clicks, conversions, bounces,
          unsubscribes, floor(r1 * 10000 + 0.5) / 10000 AS open_rate, floor(r2 * 10000 + 0.5) / 10000 AS click_rate,
          floor(r3 * 10000 + 0.5) / 10000 AS conversion_rate, op AS open_rate_pct, cp AS click_rate_pct,
          vp AS conversion_rate_pct, bp AS bounce_rate_pct, up AS unsub_rate_pct, 30::BIGINT AS min_sample_sends,
          (sends >= 30)::BIGINT AS data_sufficient, coalesce(first_day::VARCHAR || 'T00:00:00Z', '') AS first_event_at,
          coalesce(last_day::VARCHAR || 'T00:00:00Z', '') AS last_event_at
        FROM fc""", *EVD, FACTS),
    "n2_rule_analysis": sql(
        f"""SELECT id AS campaign_id, campaign,
          'The campaign recorded ' || sends || ' sends and ' || delivered || ' deliveries, with ' || {_s('op')}
            || '% open, ' || {_s('cp')} || '% click and ' || {_s('vp')} || '% conversion rates.' AS summary,
          concat_ws(' | ', {_STRONG}) AS strengths,
          concat_ws(' | ', {_WEAK},
            CASE WHEN up > 0.5 THEN 'Unsubscribe rate ' || {_s('up')} || '% exceeds the 0.5% threshold.' END,
            CASE WHEN sends < 30 THEN 'Insufficient data: ' || sends
              || ' sends is below the 30 minimum sample, so rates are directional only.' END) AS weaknesses,
          array_to_string({_ANOMALIES}, ' | ') AS anomalies,
          round(greatest(CASE WHEN sends < 30 THEN 0.3 ELSE 0.75 END - 0.1 * len({_ANOMALIES}), 0.05)::DOUBLE, 6)
            AS confidence
        FROM fc WHERE sends > 0
        UNION ALL SELECT id, campaign, 'The campaign has no recorded events yet.', '',
          'Insufficient data: 0 sends recorded; at least 30 are required for meaningful analysis.', '', 0.1
        FROM fc WHERE sends = 0""", *EVD, FACTS),
    "n3_rule_recommendations": sql(
        "SELECT campaign, pos, area, suggestion, reasoning, confidence::DOUBLE AS confidence FROM rec", *EVD, FACTS, RECS),
    "n4_numbers_in_text": f"""SELECT doc_id, len({_NUMS}) AS numbers,
      round(coalesce(list_max({_NUMS}), 0), 6) AS largest FROM documents""",
    "n5_fact_numbers": sql(
        """SELECT DISTINCT campaign, round(unnest([sends, delivered, opens, clicks, conversions, bounces, unsubscribes,
          floor(r1 * 10000 + 0.5) / 10000, floor(r2 * 10000 + 0.5) / 10000, floor(r3 * 10000 + 0.5) / 10000,
          op, cp, vp, bp, up, 30, 20, 3, 1, 5, 0.5, id::DOUBLE, 0, year(first_day), month(first_day), day(first_day),
          year(last_day), month(last_day), day(last_day)]::DOUBLE[]), 6) + 0.0 AS n FROM fc
        UNION SELECT ca.ext, round(unnest([sends, delivered, opens, clicks, conversions, bounces, unsubscribes,
          floor(coalesce(opens::DOUBLE / nullif(delivered, 0), 0) * 1000 + 0.5) / 10,
          floor(coalesce(clicks::DOUBLE / nullif(delivered, 0), 0) * 1000 + 0.5) / 10,
          floor(coalesce(conversions::DOUBLE / nullif(delivered, 0), 0) * 1000 + 0.5) / 10]::DOUBLE[]), 6) + 0.0
        FROM (""" + f"SELECT campaign_id, channel, {_COUNTS} FROM daily GROUP BY 1, 2" + ") x JOIN ca ON ca.id = campaign_id",
        *EVD, FACTS),
    "n6_unsupported_numbers": f"""SELECT doc_id, len(list_filter({_NUMS}, lambda n:
        NOT list_contains(ok, n) AND NOT list_contains(ok, n / 100) AND NOT list_contains(ok, n * 100))) AS unsupported
      FROM documents, (SELECT [1, 2, 3, 5, 10, 24, 30, 50, 100, 2024]::DOUBLE[] AS ok)""",
    "s15_truncate_text": r"""
      WITH t AS (SELECT doc_id, regexp_replace(text, '^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$', '', 'g') AS s
        FROM documents)
      SELECT doc_id, CASE WHEN strlen(s) <= 120 THEN s ELSE left(s, list_max(list_filter(range(0, 121),
        lambda k: strlen(left(s, k)) <= 120))) || '…' END AS cut FROM t""",
    "n7_validate_analyses": f"SELECT i AS output_id, {_BAD7} AS error FROM (SELECT event_id AS i FROM events)",
    "n8_validate_recommendations": """SELECT event_id AS output_id, CASE event_id % 8
        WHEN 3 THEN 'ai: malformed recommendations JSON'
        WHEN 4 THEN 'ai: recommendation 0 has invalid area "creative"'
        WHEN 5 THEN 'ai: recommendation 0 missing suggestion/reasoning'
        WHEN 6 THEN 'ai: recommendation 0 confidence 2 out of [0,1]'
        WHEN 7 THEN 'ai: cited number 777777 not present in facts' ELSE '' END AS error
      FROM events""",
    "n9_output_quality": f"""SELECT provider, count(*) AS outputs, count(*) FILTER (bad) AS invalid,
        round(count(*) FILTER (bad)::DOUBLE / count(*), 6) AS invalid_rate,
        round(count(*) FILTER (NOT bad)::DOUBLE / (SELECT count(*) FILTER (event_id % 8 < 3) FROM events), 6) AS served_share,
        (provider = 'rule-based-fallback')::BIGINT AS is_fallback
      FROM (SELECT event_id % 8 >= 3 AS bad, ['model-a', 'model-b', 'rule-based-fallback'][event_id % 3 + 1] AS provider
            FROM events) GROUP BY provider""",
}
