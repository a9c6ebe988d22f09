"""Campaign facts, rule-based narratives and the check of any narrative against the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import vocab as V
from pulsegrid.functions import scalars as S

COUNTS = ("sends", "delivered", "opens", "clicks", "conversions", "bounces", "unsubscribes")
CHANNEL_PCTS = {"open_rate_pct": "opens", "click_rate_pct": "clicks", "conversion_rate_pct": "conversions"}
NUMBER = r"\d+(?:\.\d+)?"
# A JSON string with the colon that marks it as a key, or a JSON number.
JSON_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?'


def _zero() -> Column:
    return F.lit(0.0)


def channel_facts(channel_metrics: DataFrame) -> DataFrame:
    """Channel facts nested as one map per campaign; at most five entries."""
    pcts = [
        S.pct1(S.derived_rate(F.col(n), F.col("delivered"), F.col(name.removesuffix("_pct")))).alias(name)
        for name, n in CHANNEL_PCTS.items()
    ]
    entry = F.struct("channel", F.struct(*COUNTS, *pcts).alias("facts"))
    return channel_metrics.groupBy("campaign_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("by_channel")
    )


def campaign_facts(campaigns: DataFrame, metrics: DataFrame, channel_metrics: DataFrame) -> DataFrame:
    """One row of facts per campaign: counts, rounded rates, percentages, benchmarks."""
    dims = campaigns.select(F.col("id").alias("campaign_id"), F.col("external_id").alias("campaign"), "objective")
    m = dims.join(metrics, "campaign_id").join(channel_facts(channel_metrics), "campaign_id", "left")
    rate = {n: S.derived_rate(F.col(c), F.col("delivered"), F.col(n))
            for n, c in (("open_rate", "opens"), ("click_rate", "clicks"), ("conversion_rate", "conversions"))}
    bounce = S.derived_rate(F.col("bounces"), F.col("sends"), _zero())
    unsub = S.derived_rate(F.col("unsubscribes"), F.col("delivered"), _zero())

    def moment(day: str) -> Column:
        return F.concat(F.col(day).cast("string"), F.lit("T00:00:00Z"))

    return m.select(
        "campaign_id", "campaign", "objective", *COUNTS,
        *[S.round4(r).alias(n) for n, r in rate.items()],
        *[S.pct1(r).alias(f"{n}_pct") for n, r in rate.items()],
        S.pct1(bounce).alias("bounce_rate_pct"), S.pct1(unsub).alias("unsub_rate_pct"),
        F.lit(V.MIN_SAMPLE_SENDS).alias("min_sample_sends"),
        (F.col("sends") >= V.MIN_SAMPLE_SENDS).alias("data_sufficient"),
        "by_channel",
        moment("first_event_day").alias("first_event_at"), moment("last_event_day").alias("last_event_at"),
        F.struct(*[F.lit(v).alias(k) for k, v in V.BENCHMARKS.items()]).alias("benchmarks"),
    )


def facts_json(facts: DataFrame) -> Column:
    """The facts as the JSON document narratives are checked against."""
    names = [c for c in facts.columns if c not in ("campaign_id", "campaign")]
    return F.to_json(F.struct(F.col("campaign").alias("campaign_id"), *names))


def _text(template: str, *parts: Column) -> Column:
    """Template with {} filled by string columns."""
    pieces = template.split("{}")
    out = [F.lit(pieces[0])]
    for part, piece in zip(parts, pieces[1:]):
        out += [part, F.lit(piece)]
    return F.concat(*out)


def _f(name: str) -> Column:
    return S.fnum(F.col(name))


def _i(name: str) -> Column:
    return F.col(name).cast("string")


def _bench(name: str) -> Column:
    return F.lit(V.BENCHMARKS[name])


def _strings(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def rule_analysis(facts: DataFrame) -> DataFrame:
    """Summary, strengths, weaknesses, anomalies and confidence from threshold rules."""
    empty = F.array().cast("array<string>")
    none = F.col("sends") == 0
    judged = (
        ("Open rate", "open_rate_pct"), ("Click rate", "click_rate_pct"), ("Conversion rate", "conversion_rate_pct"),
    )

    def judge(label: str, name: str, good: bool) -> Column:
        bench = _bench(f"{name}_good")
        words = "meets or beats" if good else "is below"
        text = _text(f"{label} {{}}% {words} the {{}}% benchmark.", _f(name), S.fnum(bench))
        return F.when(F.col(name) >= bench if good else F.col(name) < bench, text)

    bad_bounce, bad_unsub = _bench("bounce_rate_pct_bad"), _bench("unsub_rate_pct_bad")
    anomalies = _strings(
        F.when(F.col("delivered") == 0, _text("{} sends produced {} deliveries.", _i("sends"), _i("delivered"))),
        F.when(F.col("clicks") > F.col("opens"), _text(
            "{} clicks exceed {} opens, indicating inconsistent tracking.", _i("clicks"), _i("opens"))),
        F.when(F.col("bounce_rate_pct") > bad_bounce, _text(
            "Bounce rate {}% exceeds the {}% threshold, suggesting list-quality issues.",
            _f("bounce_rate_pct"), S.fnum(bad_bounce))),
    )
    weaknesses = _strings(
        *[judge(label, name, False) for label, name in judged],
        F.when(F.col("unsub_rate_pct") > bad_unsub, _text(
            "Unsubscribe rate {}% exceeds the {}% threshold.", _f("unsub_rate_pct"), S.fnum(bad_unsub))),
        F.when(~F.col("data_sufficient"), _text(
            "Insufficient data: {} sends is below the {} minimum sample, so rates are directional only.",
            _i("sends"), _i("min_sample_sends"))),
    )
    too_few = _text("Insufficient data: {} sends recorded; at least {} are required for meaningful analysis.",
                    _i("sends"), _i("min_sample_sends"))
    summary = _text(
        "The campaign recorded {} sends and {} deliveries, with {}% open, {}% click and {}% conversion rates.",
        _i("sends"), _i("delivered"), _f("open_rate_pct"), _f("click_rate_pct"), _f("conversion_rate_pct"))
    start = F.when(F.col("data_sufficient"), F.lit(0.75)).otherwise(F.lit(0.3))
    return facts.withColumn("_anomalies", anomalies).select(
        "campaign_id", "campaign",
        F.when(none, "The campaign has no recorded events yet.").otherwise(summary).alias("summary"),
        F.when(none, empty).otherwise(_strings(*[judge(label, name, True) for label, name in judged])).alias("strengths"),
        F.when(none, F.array(too_few)).otherwise(weaknesses).alias("weaknesses"),
        F.when(none, empty).otherwise(F.col("_anomalies")).alias("anomalies"),
        F.when(none, F.lit(0.1)).otherwise(
            F.greatest(start - F.lit(0.1) * F.size("_anomalies"), F.lit(0.05))
        ).alias("confidence"),
    )


def _rec(area: str, suggestion: str, reasoning: Column, confidence: float) -> Column:
    return F.struct(
        F.lit(area).alias("area"), F.lit(suggestion).alias("suggestion"), reasoning.alias("reasoning"),
        F.lit(confidence).alias("confidence"),
    )


def rule_recommendations(facts: DataFrame) -> DataFrame:
    """Ordered recommendations per campaign; the objective's own area comes first."""
    bench = {n: _bench(n) for n in V.BENCHMARKS}
    shown = {n: S.fnum(c) for n, c in bench.items()}
    opens, clicks, conv = F.col("open_rate_pct"), F.col("click_rate_pct"), F.col("conversion_rate_pct")
    good_open = opens >= bench["open_rate_pct_good"]
    rules = [
        (F.col("bounce_rate_pct") > bench["bounce_rate_pct_bad"], _rec(
            "risk", "Suppress hard-bouncing addresses and re-verify the acquisition source before the next send.",
            _text("Bounce rate {}% exceeds the {}% threshold.", _f("bounce_rate_pct"), shown["bounce_rate_pct_bad"]),
            0.8)),
        (F.col("unsub_rate_pct") > bench["unsub_rate_pct_bad"], _rec(
            "risk", "Reduce send frequency and add a preference check to the target segment.",
            _text("Unsubscribe rate {}% exceeds the {}% threshold.", _f("unsub_rate_pct"), shown["unsub_rate_pct_bad"]),
            0.7)),
        (~good_open, _rec(
            "timing", "Split-test subject lines and send-time windows on a holdout slice.",
            _text("Open rate {}% is below the {}% benchmark.", _f("open_rate_pct"), shown["open_rate_pct_good"]), 0.6)),
        (good_open & (clicks < bench["click_rate_pct_good"]), _rec(
            "strategy", "Strengthen the primary call-to-action and tighten message-to-audience relevance.",
            _text("Open rate {}% is healthy but click rate {}% trails the {}% benchmark.",
                  _f("open_rate_pct"), _f("click_rate_pct"), shown["click_rate_pct_good"]), 0.6)),
        (conv < bench["conversion_rate_pct_good"], _rec(
            "segmentation", "Narrow targeting to recently engaged, high-score customers.",
            _text("Conversion rate {}% is below the {}% benchmark.",
                  _f("conversion_rate_pct"), shown["conversion_rate_pct_good"]), 0.55)),
    ]
    fired = F.array_compact(F.array(*[F.when(cond, rec) for cond, rec in rules]))
    healthy = F.array(
        _rec("audience", "Expand reach with a lookalike audience built from converted customers.",
             _text("All rates are at or above benchmark: open {}%, click {}%, conversion {}%.",
                   _f("open_rate_pct"), _f("click_rate_pct"), _f("conversion_rate_pct")), 0.5),
        _rec("channel", "Test one adjacent channel against the current best performer.",
             F.lit("Performance is healthy, so incremental channel testing can lift total conversions."), 0.4),
    )
    collect_more = _rec(
        "strategy", "Collect more campaign events before committing additional budget.",
        _text("Only {} sends observed; the minimum reliable sample is {}.", _i("sends"), _i("min_sample_sends")), 0.3)
    pilot = _rec(
        "strategy", "Run a small pilot send to a seed segment before scaling spend.",
        _text("The campaign has {} sends; at least {} are needed before performance-based recommendations are meaningful.",
              _i("sends"), _i("min_sample_sends")), 0.2)

    def unsure(r: Column) -> Column:
        return F.struct(r["area"].alias("area"), r["suggestion"].alias("suggestion"), r["reasoning"].alias("reasoning"),
                        F.least(r["confidence"], F.lit(0.35)).alias("confidence"))

    area = S.lookup(F.col("objective"), V.OBJECTIVE_AREA, F.lit(""))
    return (
        facts.withColumn("_r", fired)
        .withColumn("_r", F.when(F.size("_r") > 0, F.col("_r")).otherwise(healthy))
        .withColumn("_r", F.when(F.col("data_sufficient"), F.col("_r")).otherwise(
            F.concat(F.transform("_r", unsure), F.array(collect_more))))
        .withColumn("_r", F.when(F.col("sends") == 0, F.array(pilot)).otherwise(F.col("_r")))
        .withColumn("_area", area)
        .select("campaign_id", "campaign", F.concat(
            F.filter("_r", lambda r: r["area"] == F.col("_area")),
            F.filter("_r", lambda r: r["area"] != F.col("_area"))).alias("recommendations"))
    )


def number_literals(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), 0)


def _doubles(literals: Column) -> Column:
    return F.transform(literals, lambda x: x.try_cast("double"))


def numbers_in_text(text: Column) -> Column:
    """Every number written in a text, as doubles; signs are not part of a number."""
    return _doubles(number_literals(text))


def fact_numbers(facts: Column) -> Column:
    """Every number of a JSON document at any depth, and the digits inside its string values.

    One pass over the tokens: strings followed by a colon are keys and do not count. A string with
    escapes is read first, as the digits of an escape are no digits of the value.
    """
    tokens = F.regexp_extract_all(facts, F.lit(JSON_TOKEN), 0)
    text = F.filter(tokens, lambda t: t.startswith('"') & t.endswith('"'))
    text = F.transform(text, lambda t: F.when(
        t.contains("\\"), F.coalesce(F.try_variant_get(F.try_parse_json(t), "$", "string"), t)).otherwise(t))
    plain = F.filter(tokens, lambda t: ~t.startswith('"'))
    found = F.concat(_doubles(F.flatten(F.transform(text, number_literals))), _doubles(plain))
    nothing = F.array().cast("array<double>")
    return F.when(F.try_parse_json(facts).isNull(), nothing).otherwise(F.array_distinct(found))


def unsupported_literals(texts: Column, numbers: Column) -> Column:
    """Cited numbers that are neither in the facts nor there as a percentage or fraction."""
    def known(literal: Column, allowed: Column) -> Column:
        n = literal.try_cast("double")
        return F.array_contains(allowed, n) | F.array_contains(allowed, n / 100) | F.array_contains(allowed, n * 100)

    cited = F.flatten(F.transform(texts, number_literals))
    return S.let(numbers, lambda allowed: F.filter(cited, lambda lit: ~known(lit, allowed)))


def unsupported_numbers(text: Column, numbers: Column) -> Column:
    return _doubles(unsupported_literals(F.array(text), numbers))


def strip_to_json(raw: Column) -> Column:
    """Drops a code fence and surrounding prose, leaving the widest {...}."""
    s = S.trim_space(raw)
    s = F.when(s.startswith("```") & s.contains("\n"), F.regexp_replace(s, r"(?s)\A[^\n]*\n", "")).otherwise(s)
    wide = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.when(wide != "", wide).otherwise(s)


def _kind(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))


def _is_text(kind: Column) -> Column:
    return kind.isin("STRING", "VOID")


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT", "VOID") | kind.startswith("DECIMAL")


def _is_texts(kind: Column) -> Column:
    return kind.isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID")


def _blank(text: Column) -> Column:
    return S.trim_space(F.coalesce(text, F.lit(""))) == ""


def _cited(bad: Column) -> Column:
    return F.concat(F.lit("ai: cited number "), F.get(bad, F.lit(0)), F.lit(" not present in facts"))


def _known_numbers(outputs: DataFrame) -> Column:
    """Stored with the facts when many outputs share a document, else collected here."""
    return F.col("fact_numbers") if "fact_numbers" in outputs.columns else fact_numbers(F.col("facts"))


def validate_analyses(outputs: DataFrame) -> DataFrame:
    """Adds ``error`` to rows of (raw, facts): the first broken rule, NULL when valid."""
    v = F.col("_v")
    lists = ("strengths", "weaknesses", "anomalies")
    whole = F.schema_of_variant(v)
    shape = (
        (whole.startswith("OBJECT") | (whole == "VOID")) & _is_text(_kind(v, "$.summary"))
        & _is_number(_kind(v, "$.confidence"))
    )
    for name in lists:
        shape = shape & _is_texts(_kind(v, f"$.{name}"))
    missing = F.lit(False)
    for name in lists:
        missing = missing | (_kind(v, f"$.{name}") == "VOID")
    summary = F.coalesce(F.try_variant_get(v, "$.summary", "string"), F.lit(""))
    confidence = F.coalesce(F.try_variant_get(v, "$.confidence", "double"), _zero())
    texts = F.concat(F.array(summary), *[
        F.transform(F.coalesce(F.try_variant_get(v, f"$.{n}", "array<string>"), F.array().cast("array<string>")),
                    lambda t: F.coalesce(t, F.lit(""))) for n in lists
    ])
    return (
        outputs.withColumn("_v", F.try_parse_json(strip_to_json(F.col("raw"))))
        .withColumn("_bad", unsupported_literals(texts, _known_numbers(outputs)))
        .withColumn("error", F.when(v.isNull() | ~shape, "ai: malformed analysis JSON")
                    .when(_blank(summary), "ai: analysis missing summary")
                    .when(missing, "ai: analysis missing strengths/weaknesses/anomalies arrays")
                    .when(~confidence.between(0, 1), F.concat(
                        F.lit("ai: confidence "), S.fnum(confidence), F.lit(" out of [0,1]")))
                    .when(F.size("_bad") > 0, _cited(F.col("_bad"))))
        .drop("_v", "_bad")
    )


def validate_recommendations(outputs: DataFrame) -> DataFrame:
    """The same for recommendation documents: the first broken entry gives the error."""
    v = F.col("_v")
    whole = F.schema_of_variant(v)
    listed = _kind(v, "$.recommendations")
    entries = F.coalesce(F.try_variant_get(v, "$.recommendations", "array<variant>"), F.array().cast("array<variant>"))

    def well_formed(e: Column) -> Column:
        kind = F.coalesce(F.schema_of_variant(e), F.lit("VOID"))
        ok = kind.startswith("OBJECT") | (kind == "VOID")
        for name in ("area", "suggestion", "reasoning"):
            ok = ok & _is_text(_kind(e, f"$.{name}"))
        return ok & _is_number(_kind(e, "$.confidence"))

    def text(e: Column, name: str) -> Column:
        return F.coalesce(F.try_variant_get(e, f"$.{name}", "string"), F.lit(""))

    def problem(e: Column, i: Column) -> Column:
        where = F.concat(F.lit("ai: recommendation "), i.cast("string"))
        area, suggestion, reasoning = (text(e, n) for n in ("area", "suggestion", "reasoning"))
        confidence = F.coalesce(F.try_variant_get(e, "$.confidence", "double"), _zero())
        bad = unsupported_literals(F.array(F.concat(suggestion, F.lit(" "), reasoning)), F.col("_nums"))
        return (
            F.when(~area.isin(*V.AREAS), F.concat(where, F.lit(' has invalid area "'), area, F.lit('"')))
            .when(_blank(suggestion) | _blank(reasoning), F.concat(where, F.lit(" missing suggestion/reasoning")))
            .when(~confidence.between(0, 1), F.concat(
                where, F.lit(" confidence "), S.fnum(confidence), F.lit(" out of [0,1]")))
            .when(F.size(bad) > 0, _cited(bad))
        )

    shape = (whole.startswith("OBJECT") | (whole == "VOID")) & (listed.startswith("ARRAY") | (listed == "VOID"))
    return (
        outputs.withColumn("_v", F.try_parse_json(strip_to_json(F.col("raw"))))
        .withColumn("_nums", _known_numbers(outputs))
        .withColumn("_e", entries)
        .withColumn("_p", F.array_compact(F.transform("_e", problem)))
        .withColumn("error", F.when(v.isNull() | ~shape | ~F.forall("_e", well_formed),
                                    "ai: malformed recommendations JSON")
                    .when(F.size("_e") == 0, "ai: empty recommendations")
                    .when(F.size("_p") > 0, F.get("_p", F.lit(0))))
        .drop("_v", "_nums", "_e", "_p")
    )


def output_quality(validations: DataFrame) -> DataFrame:
    """Per provider: outputs, share of invalid ones, and its share of everything served.

    The served share of the rule provider is the fallback rate.
    """
    per = validations.groupBy("provider").agg(
        F.count("*").alias("outputs"), F.count("error").alias("invalid"),
    ).withColumn("served", F.col("outputs") - F.col("invalid"))
    total = per.agg(F.sum("served").alias("n")).scalar()
    return per.withColumn("_n", total).select(
        "provider", "outputs", "invalid", S.rate(F.col("invalid"), F.col("outputs")).alias("invalid_rate"),
        S.rate(F.col("served"), F.col("_n")).alias("served_share"),
        (F.col("provider") == V.RULE_PROVIDER).alias("is_fallback"),
    )
