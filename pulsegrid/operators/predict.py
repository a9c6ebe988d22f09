"""Channel prediction with a hierarchical Beta-Binomial model.

Evidence for any number of requests comes from two rollups made in one pass each: platform
counts per (objective, channel, age in days), at most a few thousand rows, and target counts
per (customer, channel, age in days). Windows, audiences and customers are then sums over
them. Intervals and probabilities of being best are integrals of the posteriors (``functions.beta``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import vocab as V
from pulsegrid.functions import scalars as S
from pulsegrid.functions.beta import best_probabilities, beta_table, summaries_in_batches
from pulsegrid.operators.dominance import dominance_counts, placed, score_ranges
from pulsegrid.session import settle
from pulsegrid.sources.tables import from_day

SALTS = 16
# A pattern that holds more than one row in so many is salted.
FREQUENT = 1000
FEW_AUDIENCES = 64
PATTERNS_PER_TASK = 2000
KEY = ["objective", "lookback_days"]
SUCCESS_TYPES = ("opened", "clicked", "converted")
EVIDENCE = (
    "objective_successes", "objective_delivered", "other_successes", "other_delivered",
    "target_successes", "target_delivered", "sent", "bounced", "opt_outs", "delivered_all",
)


def normalize_prediction_requests(requests: DataFrame) -> DataFrame:
    """Defaults, deduplicated channels, scope and ``errors`` (field: message, by field)."""
    asked = F.coalesce("channels", F.array().cast("array<string>"))
    aud = F.col("audience")
    days = F.coalesce("lookback_days", F.lit(0))
    customer = F.coalesce("customer_id", F.lit(""))
    bad = F.exists(asked, lambda c: ~c.isin(*V.CHANNELS))
    min_score = F.coalesce(aud["min_score"], F.lit(0.0))
    active = F.coalesce(aud["last_active_days"], F.lit(0))
    errors = F.array_compact(F.array(
        F.when(aud.isNotNull() & (active < 0), "audience.last_active_days: must be >= 0"),
        F.when(aud.isNotNull() & ((min_score < 0) | (min_score >= 1)), "audience.min_score: must be in [0, 1)"),
        F.when(bad, "channels: each channel must be one of email, sms, whatsapp, push, web"),
        F.when((customer != "") & aud.isNotNull(),
               "customer_id: customer_id and audience are mutually exclusive"),
        F.when((days != 0) & ~days.between(1, V.MAX_LOOKBACK_DAYS),
               f"lookback_days: must be between 1 and {V.MAX_LOOKBACK_DAYS}"),
        F.when(~F.coalesce("objective", F.lit("")).isin(*V.OBJECTIVES),
               "objective: must be one of conversion, engagement, retention, reactivation, awareness"),
    ))
    return requests.select(
        "request_id", "objective",
        F.when(F.size(asked) == 0, F.array(*[F.lit(c) for c in V.CHANNELS])).otherwise(F.array_distinct(asked)).alias(
            "channels"
        ),
        customer.alias("customer_id"), min_score.alias("min_score"), active.alias("last_active_days"),
        F.when(days == 0, V.DEFAULT_LOOKBACK_DAYS).otherwise(days).alias("lookback_days"),
        F.when(customer != "", "customer").when(aud.isNotNull(), "audience").otherwise("platform").alias("scope"),
        S.success_event(F.col("objective")).alias("success_event"),
        errors.alias("errors"),
    )


def _valid(requests: DataFrame) -> DataFrame:
    return requests.where(F.size("errors") == 0)


def _success(objective_event: Column) -> Column:
    return reduce(
        lambda acc, t: F.when(objective_event == t, F.col(t)).otherwise(acc), SUCCESS_TYPES, F.lit(0).cast("long")
    )


def platform_cells(daily: DataFrame, campaigns: DataFrame, as_of) -> DataFrame:
    """Counts per (objective, channel, age in calendar days): at most 5 x 5 x 366 rows."""
    age = F.date_diff(F.to_date(S.as_ts(as_of)), F.col("day"))
    goal = campaigns.select(F.col("id").alias("campaign_id"), "objective")
    # Reduced per campaign first, so that the join sees one row per campaign, channel and day.
    per_day = (
        daily.where((age >= 0) & (age <= V.MAX_LOOKBACK_DAYS)).withColumn("age", age)
        .groupBy("campaign_id", "channel", "age")
        .agg(*[F.sum(F.when(F.col("event_type") == t, F.col("count")).otherwise(0)).alias(t) for t in V.EVENT_TYPES])
    )
    return (
        per_day.join(goal, "campaign_id")
        .groupBy(F.col("objective").alias("of"), "channel", "age").agg(*[F.sum(t).alias(t) for t in V.EVENT_TYPES])
    )


def platform_evidence(wanted: DataFrame, daily: DataFrame, campaigns: DataFrame, as_of) -> DataFrame:
    """Evidence per distinct (objective, lookback) and channel; the vocabulary bounds it."""
    asked = wanted.select(*KEY).distinct()
    windows = asked.agg(F.collect_set("lookback_days").alias("w")).scalar()
    within = (
        platform_cells(daily, campaigns, as_of).withColumn("_w", windows)
        .withColumn("lookback_days", F.explode(F.filter("_w", lambda n: n >= F.col("age"))))
        .groupBy("of", "channel", "lookback_days").agg(*[F.sum(t).alias(t) for t in V.EVENT_TYPES])
    )
    spine = (
        asked.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in V.CHANNELS])))
        .withColumn("_s", S.success_event(F.col("objective")))
    )
    own = F.col("of") == F.col("objective")
    success = _success(F.col("_s"))

    def total(value: Column, cond: Column | None = None) -> Column:
        return F.coalesce(F.sum(value if cond is None else F.when(cond, value)), F.lit(0).cast("long"))

    # One row per objective on the other side: five per (channel, window).
    return spine.join(within, ["channel", "lookback_days"], "left").groupBy(*KEY, "channel").agg(
        total(success, own).alias("objective_successes"), total(F.col("delivered"), own).alias("objective_delivered"),
        total(success, ~own).alias("other_successes"), total(F.col("delivered"), ~own).alias("other_delivered"),
        total(F.col("sent")).alias("sent"), total(F.col("bounced")).alias("bounced"),
        total(F.col("unsubscribed") + F.col("complained")).alias("opt_outs"),
        total(F.col("delivered")).alias("delivered_all"),
    )


def target_daily(events: DataFrame, as_of) -> DataFrame:
    """Campaign-attributed responses per (customer, channel, age); any status counts.

    The age is rounded up to whole days, so "within n days" is exactly ``age <= n``.
    """
    now = S.as_ts(as_of)
    seconds = S.seconds_between(now, F.col("occurred_at"))
    typ = F.col("type")
    since = now - F.expr(f"INTERVAL '{V.MAX_LOOKBACK_DAYS}' DAY")
    return (
        from_day(events, since).where((F.col("occurred_at") <= now) & F.col("campaign_id").isNotNull())
        .where(typ.isin("delivered", *SUCCESS_TYPES))
        .where(F.col("occurred_at") >= since)
        .groupBy("customer_id", "channel", F.ceil(seconds / 86400).cast("int").alias("age"))
        .agg(*[F.count_if(typ == t).alias(t) for t in ("delivered", *SUCCESS_TYPES)])
    )


def check_lookback(days: int) -> None:
    """The rollup of responses reaches back a fixed time; a longer window is an error, not cut in silence."""
    if not 0 < days <= V.MAX_LOOKBACK_DAYS:
        raise ValueError(f"lookback_days must be between 1 and {V.MAX_LOOKBACK_DAYS}")


def customer_evidence(rollup: DataFrame, lookback_days: int) -> DataFrame:
    """Responses per customer and channel within the window, for all customers at once."""
    check_lookback(lookback_days)
    return (
        rollup.where(F.col("age") <= lookback_days)
        .groupBy("customer_id", "channel").agg(*[F.sum(t).alias(t) for t in ("delivered", *SUCCESS_TYPES)])
    )


def resolve_requests(requests: DataFrame, customers: DataFrame) -> DataFrame:
    """Valid requests with the internal id of their customer; an unknown customer drops out."""
    ids = customers.select(F.col("external_id").alias("customer_id"), F.col("id").alias("target_id"))
    return _valid(requests).join(ids, "customer_id", "left").where(
        (F.col("scope") != "customer") | F.col("target_id").isNotNull()
    )


def _customer_targets(resolved: DataFrame, rollup: DataFrame) -> DataFrame:
    asked = resolved.where(F.col("scope") == "customer").select(
        "request_id", F.col("target_id").alias("customer_id"), "lookback_days", "success_event"
    )
    return (
        asked.join(rollup, "customer_id").where(F.col("age") <= F.col("lookback_days"))
        .groupBy("request_id", "channel")
        .agg(F.sum(_success(F.col("success_event"))).alias("target_successes"),
             F.sum("delivered").alias("target_delivered"))
    )


def audience_evidence(requests: DataFrame, rollup: DataFrame, profiles: DataFrame, customers: DataFrame,
                      as_of) -> DataFrame:
    """Responses per (request, channel) of each audience, with the audience's size.

    Up to 64 audiences are conditions tested on each member. Of more, score floors, activity limits and windows are
    thresholds. A customer is placed once among the floors of all requests; days are their own places. Counts
    are kept per place, and ``dominance_counts`` answers every request from them. Either way the data is read
    once however many audiences are asked for, and no request meets all places.
    """
    now = S.as_ts(as_of)
    aud = requests.where(F.col("scope") == "audience").select(
        "request_id", "success_event", F.col("lookback_days").cast("int").alias("w"),
        S.raw_min_score(F.col("min_score")).alias("floor"), F.col("last_active_days").cast("int").alias("days"),
    )
    idle = F.greatest(F.ceil(S.seconds_between(now, F.col("last_event_at")) / 86400), F.lit(0))
    members = customers.where(F.col("is_active")).select(F.col("id").alias("customer_id")).join(
        profiles.select("customer_id", "engagement_score", "last_event_at"), "customer_id").withColumn("idle", idle)
    few = aud.limit(FEW_AUDIENCES + 1).collect()
    if len(few) <= FEW_AUDIENCES:
        aud = customers.sparkSession.createDataFrame(few, aud.schema)
        return _by_request(aud, _few_audiences(few, rollup, members))
    return _by_request(*_many_audiences(aud, rollup, members))


def _by_request(aud: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts per (request, channel, or '' for the size) as rows of evidence, zeros where there are none."""
    def total(channel: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("channel") == channel, value)), F.lit(0).cast("long"))

    wide = aud.select("request_id", "success_event").join(counts, "request_id", "left").groupBy("request_id").agg(
        total("", F.col("delivered")).alias("audience_size"),
        *[F.struct(F.lit(c).alias("channel"), total(c, _success(F.col("success_event"))).alias("target_successes"),
                   total(c, F.col("delivered")).alias("target_delivered")).alias(f"_{c}") for c in V.CHANNELS],
    )
    return wide.select("request_id", "audience_size", F.explode(F.array(*[f"_{c}" for c in V.CHANNELS])).alias("_c")).select(
        "request_id", "audience_size", "_c.*"
    )


def _counted(members: DataFrame, rollup: DataFrame, *places: str) -> DataFrame:
    """Responses of the members, and a row per member that stands for the size: channel '' and no window."""
    zeros = [F.lit(0).cast("long").alias(t) for t in SUCCESS_TYPES]
    sizes = members.select(*places, F.lit(0).alias("w"), F.lit("").alias("channel"), F.lit(1).cast("long").alias("delivered"), *zeros)
    return sizes.unionByName(members.join(rollup, "customer_id").select(
        *places, F.greatest("age", F.lit(0)).alias("w"), "channel", "delivered", *SUCCESS_TYPES))


def _few_audiences(few: list, rollup: DataFrame, members: DataFrame) -> DataFrame:
    """Each member carries the numbers of the requests that it fits; sums are made before the shuffle."""
    fits = F.array_compact(F.array(*[
        F.when((F.col("engagement_score") >= r.floor) & (F.lit(r.days <= 0) | (F.col("idle") <= r.days)), F.lit(n))
        for n, r in enumerate(few)]).cast("array<int>"))
    members = members.select("customer_id", fits.alias("fits")).where(F.size("fits") > 0)
    windows = F.array(*[F.lit(r.w) for r in few]).cast("array<int>")
    rows = _counted(members, rollup, "fits").withColumn("n", F.explode(F.filter("fits", lambda n: F.col("w") <= F.get(windows, n))))
    sums = rows.groupBy("n", "channel").agg(*[F.sum(t).alias(t) for t in ("delivered", *SUCCESS_TYPES)])
    return sums.withColumn("request_id", F.get(F.array(*[F.lit(r.request_id) for r in few]), F.col("n")))


def _many_audiences(aud: DataFrame, rollup: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, written once, and their counts by dominance)."""
    # No limit is one day beyond the longest limit asked for, and so is a customer idle for longer or never seen.
    beyond = F.coalesce(aud.agg(F.max("days") + 1).scalar(), F.lit(1))
    beyond = F.greatest(beyond, F.lit(1))
    ranges = score_ranges(aud)
    # Written once: the placed requests are met in several places.
    aud = settle(placed(aud.withColumn("beyond", beyond), ranges, "floor", "i").withColumn(
        "j", F.when(F.col("days") > 0, F.col("days")).otherwise(F.col("beyond")).cast("int")), "audiences")
    beyond = F.coalesce(aud.agg(F.max("beyond")).scalar(), F.lit(1))
    members = members.withColumn("j", F.least(F.coalesce("idle", beyond), beyond).cast("int"))
    members = placed(members, ranges, "engagement_score", "i").where("i > 0").select("customer_id", "i", "j")
    measures = ("delivered", *SUCCESS_TYPES)
    cells = _counted(members, rollup, "i", "j").groupBy("i", "j", "w", "channel").agg(*[F.sum(t).alias(t) for t in measures])
    return aud, dominance_counts(cells, aud.select("request_id", "i", "j", "w"), measures, ("", *V.CHANNELS))


def channel_evidence(requests: DataFrame, events: DataFrame, profiles: DataFrame, customers: DataFrame,
                     daily: DataFrame, campaigns: DataFrame, as_of, rollup: DataFrame | None = None) -> DataFrame:
    """One row per valid request and channel. A request for an unknown customer has none.

    ``rollup`` is a stored ``target_daily``; without one it is made from the events.
    """
    resolved = resolve_requests(requests, customers)
    rollup = target_daily(events, as_of) if rollup is None else rollup
    rows = resolved.select(
        "request_id", "objective", "scope", "success_event", "lookback_days",
        F.posexplode("channels").alias("pos", "channel"),
    )
    audience = audience_evidence(_valid(requests), rollup, profiles, customers, as_of)
    target = _customer_targets(resolved, rollup).unionByName(audience, allowMissingColumns=True)
    return (
        rows.join(platform_evidence(_valid(requests), daily, campaigns, as_of), [*KEY, "channel"], "left")
        .join(target, ["request_id", "channel"], "left")
        .fillna(0, list(EVIDENCE))
    )


def clamp_counts(successes: Column, delivered: Column) -> tuple[Column, Column]:
    """Successes at least 0, deliveries at least as many as successes."""
    s = F.greatest(successes, F.lit(0).cast("long"))
    return s, F.greatest(delivered, s)


def clamped(evidence: DataFrame) -> DataFrame:
    out = {}
    for part in ("objective", "other", "target"):
        s, n = clamp_counts(F.col(f"{part}_successes"), F.col(f"{part}_delivered"))
        out[f"{part}_successes"], out[f"{part}_delivered"] = s, n
    return evidence.withColumns(out)


def _mean(successes: Column, delivered: Column, success: Column) -> Column:
    default = S.lookup(success, V.DEFAULT_RATES, F.lit(0.02))
    kept = F.least(F.greatest(successes.cast("double") / F.when(delivered > 0, delivered), F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.when(delivered > 0, kept).otherwise(default)


def platform_mean(evidence: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Pooled rate of a request's channels, kept strictly between 0 and 1."""
    w = Window.partitionBy(*(key or ["request_id"]))
    s = F.sum(F.col("objective_successes") + F.col("other_successes")).over(w)
    n = F.sum(F.col("objective_delivered") + F.col("other_delivered")).over(w)
    return clamped(evidence).withColumns({"_s": s, "_n": n}).withColumn(
        "platform_mean", _mean(F.col("_s"), F.col("_n"), F.col("success_event"))
    ).drop("_s", "_n")


def _objective_layer(df: DataFrame) -> DataFrame:
    mc = (F.col("other_successes") + V.PRIOR_CHANNEL * F.col("platform_mean")) / (
        F.col("other_delivered") + V.PRIOR_CHANNEL
    )
    return df.withColumn("_mc", mc).withColumns({
        "a": V.PRIOR_OBJECTIVE * F.col("_mc") + F.col("objective_successes"),
        "b": V.PRIOR_OBJECTIVE * (1 - F.col("_mc")) + F.col("objective_delivered") - F.col("objective_successes"),
    }).drop("_mc")


def _capped(df: DataFrame, strength: Column) -> DataFrame:
    k = F.least(F.col("a") + F.col("b"), strength)
    mean = F.col("a") / (F.col("a") + F.col("b"))
    return df.withColumns({"a": k * mean, "b": k * (1 - mean)})


def posteriors(evidence: DataFrame) -> DataFrame:
    """Beta(a, b) per request and channel after the three layers, with its mean."""
    layered = _objective_layer(platform_mean(evidence))
    scope = F.col("scope")
    strength = F.when(scope == "customer", V.CUSTOMER_STRENGTH).otherwise(V.AUDIENCE_STRENGTH)
    pa, pb = F.col("a"), F.col("b")
    k, mean = F.least(pa + pb, strength), pa / (pa + pb)
    targeted = scope != "platform"
    return layered.withColumns({
        "a": F.when(targeted, k * mean + F.col("target_successes")).otherwise(pa),
        "b": F.when(targeted, k * (1 - mean) + F.col("target_delivered") - F.col("target_successes")).otherwise(pb),
    }).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def _packed(rows: DataFrame) -> DataFrame:
    """One row per request with its channels (five at most) as an array in input order, and ``_sim``, their summary."""
    rows = rows.withColumn("_t", beta_table(F.col("a"), F.col("b"), *V.INTERVAL))
    cols = [F.col("pos"), *[F.col(c) for c in rows.columns if c not in ("request_id", "pos", "_t")]]
    both = F.struct(F.struct(*cols).alias("v"), F.col("_t").alias("t"))
    packed = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(both)).alias("_p"))
    return packed.select("request_id", F.col("_p.v").alias("_v"), summary(F.col("_p.t")).alias("_sim"))


def summary(tables: Column) -> Column:
    """Interval and probability of being best of each of several Beta tables, as an array of structs."""
    return F.zip_with(tables, best_probabilities(tables), lambda t, p: F.struct(
        t["lower"].alias("lower"), t["upper"].alias("upper"), p.alias("prob_best")))


def simulate(posts: DataFrame) -> DataFrame:
    """Interval and probability of being best, per request and channel, by numeric integration."""
    done = _packed(posts.select("request_id", "pos", "channel", "a", "b"))
    one = F.zip_with("_v", "_sim", lambda e, sim: F.struct(e["channel"].alias("channel"), sim["lower"].alias("lower"),
                                                           sim["upper"].alias("upper"), sim["prob_best"].alias("prob_best")))
    return done.select("request_id", F.explode(one).alias("_z")).select("request_id", "_z.*")


def risk_rates(evidence: DataFrame) -> DataFrame:
    """Opt-out and bounce rate of a channel and of all the others of its request together."""
    w = Window.partitionBy("request_id")

    def others(num: str, den: str) -> Column:
        return S.rate(F.sum(num).over(w) - F.col(num), F.sum(den).over(w) - F.col(den))

    return evidence.withColumns({
        "opt_out_rate": S.round4(S.rate(F.col("opt_outs"), F.col("delivered_all"))),
        "bounce_rate": S.round4(S.rate(F.col("bounced"), F.col("sent"))),
        "others_opt_out": others("opt_outs", "delivered_all"),
        "others_bounce": others("bounced", "sent"),
    })


def rank_channels(predictions: DataFrame) -> DataFrame:
    """By rounded rate, then rounded probability of being best, then input order."""
    order = Window.partitionBy("request_id").orderBy(
        F.col("predicted_rate").desc(), F.col("prob_best").desc(), F.col("pos").asc()
    )
    return predictions.withColumn("rank", F.row_number().over(order))


def low_data(objective_delivered: Column, target_delivered: Column) -> Column:
    return objective_delivered + target_delivered < V.LOW_DATA_BELOW


def prediction_reasons(rows: DataFrame) -> DataFrame:
    """Adds the reasons to clamped evidence rows that carry their risk rates."""
    o_s, o_n = F.col("objective_successes"), F.col("objective_delivered")
    x_s, x_n = F.col("other_successes"), F.col("other_delivered")
    t_s, t_n = F.col("target_successes"), F.col("target_delivered")
    scope = F.col("scope")
    evidence = (
        F.when(o_n > 0, F.concat(
            S.pct(S.rate(o_s, o_n)), F.lit(" "), F.col("success_event"), F.lit(" rate over "), S.thousands(o_n),
            F.lit(" deliveries in "), F.col("objective"), F.lit(" campaigns (last "),
            F.col("lookback_days").cast("string"), F.lit("d)")))
        .when(x_n > 0, F.concat(
            F.lit("no "), F.col("objective"), F.lit("-campaign history; estimate borrows "), S.pct(S.rate(x_s, x_n)),
            F.lit(" from "), S.thousands(x_n), F.lit(" deliveries on other objectives")))
        .otherwise("no history on this channel; estimate is the platform average")
    )
    target = F.when(scope != "platform", F.when(t_n > 0, F.concat(
        scope, F.lit(" history: "), S.thousands(t_s), F.lit(" "), F.col("success_event"), F.lit(" over "),
        S.thousands(t_n), F.lit(" deliveries"))).otherwise(
        F.concat(scope, F.lit(" has never been reached on this channel"))))
    opt, bounce = F.col("opt_out_rate"), F.col("bounce_rate")
    o_opt, o_bounce = F.col("others_opt_out"), F.col("others_bounce")
    opt_risk = (F.col("delivered_all") >= V.RISK_MIN_VOLUME) & (o_opt > 0) & (opt > 2 * o_opt)
    bounce_risk = (F.col("sent") >= V.RISK_MIN_VOLUME) & (o_bounce > 0) & (bounce > 2 * o_bounce)
    return rows.withColumn("reasons", F.array_compact(F.array(
        evidence,
        target,
        F.when(low_data(o_n, t_n), "low data: treat as a directional estimate"),
        F.when(opt_risk, F.concat(
            F.lit("high opt-out risk: "), S.pct(opt), F.lit(" unsubscribes/complaints vs "), S.pct(o_opt),
            F.lit(" on the other channels"))),
        F.when(bounce_risk, F.concat(
            F.lit("high bounce rate: "), S.pct(bounce), F.lit(" vs "), S.pct(o_bounce),
            F.lit(" on the other channels"))),
    )))


def advice_columns(ranked: Column, scope: Column, success: Column) -> dict[str, Column]:
    """Recommended channel, confidence and advice from an array ordered by rank.

    Elements hold ``channel`` and ``prob_best``. The challenger is the other channel most
    likely to be the best one, often not the second in rank.
    """
    best = F.get(ranked, F.lit(0))
    # Ascending on (-probability, position) puts the challenger first.
    others = F.array_sort(F.transform(
        F.slice(ranked, 2, 5), lambda e, i: F.struct((-e["prob_best"]).alias("p"), i.alias("i"), e["channel"].alias("c"))
    ))
    rival = F.get(others, F.lit(0))
    p, q = S.pct(best["prob_best"]), S.pct(-rival["p"])
    label = F.when(F.size(ranked) == 1, "high").otherwise(S.confidence_label(best["prob_best"]))
    text = (
        F.when(F.size(ranked) == 1, F.concat(F.lit("Only "), best["channel"], F.lit(" was evaluated.")))
        .when(label == "high", F.concat(
            F.lit("Send on "), best["channel"], F.lit(": it has a "), p, F.lit(" chance of the highest "), success,
            F.lit(" rate.")))
        .when(label == "medium", F.concat(
            best["channel"], F.lit(" is the likely winner ("), p, F.lit(" chance best); "), rival["c"],
            F.lit(" is the main challenger.")))
        .when(scope == "customer", F.concat(
            F.lit("Not enough history to separate channels for this customer; "), best["channel"],
            F.lit(" is the best guess ("), p,
            F.lit(" chance best). Their response will sharpen the next prediction.")))
        .otherwise(F.concat(
            F.lit("No clear winner between "), best["channel"], F.lit(" and "), rival["c"], F.lit(" ("), p,
            F.lit(" vs "), q,
            F.lit(" chance best). Run an A/B split on a slice of the audience before committing the rest.")))
    )
    return {"recommended_channel": best["channel"], "confidence": label, "advice": text}


def prediction_advice(ranked: DataFrame) -> DataFrame:
    """One row per request: recommended channel, confidence and advice."""
    packed = ranked.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "channel", "prob_best"))).alias("_r"),
        F.first("scope").alias("_scope"), F.first("success_event").alias("_success"),
    )
    cols = advice_columns(F.col("_r"), F.col("_scope"), F.col("_success"))
    return packed.select("request_id", *[c.alias(n) for n, c in cols.items()])


def predictions(evidence: DataFrame) -> DataFrame:
    """Evidence to ranked channels with reasons and the request's advice, in one pass."""
    rows = risk_rates(posteriors(evidence))

    def finish(e: Column, sim: Column) -> Column:
        rate, prob = S.round4(e["mean"]), S.round4(sim["prob_best"])
        return F.struct(
            (-rate).alias("o1"), (-prob).alias("o2"), e["pos"].alias("o3"), e["channel"].alias("channel"),
            prob.alias("prob_best"), rate.alias("predicted_rate"), S.round4(sim["lower"]).alias("lower"),
            S.round4(sim["upper"]).alias("upper"), e.alias("e"),
        )

    # Element by element: a summary looked up by index inside the function would be integrated anew for each channel.
    ranked = _packed(rows).withColumn("_r", F.array_sort(F.zip_with("_v", "_sim", finish)))
    first = F.get(F.col("_v"), F.lit(0))
    answer = advice_columns(F.col("_r"), first["scope"], first["success_event"])
    kept = [c for c in rows.columns if c not in ("request_id", "channel")]
    flat = (
        ranked.withColumns(answer).select("request_id", *answer, F.posexplode("_r").alias("_p", "_z"))
        .select(
            "request_id", *answer, (F.col("_p") + 1).alias("rank"), "_z.channel", "_z.prob_best", "_z.predicted_rate",
            "_z.lower", "_z.upper", *[f"_z.e.{c}" for c in kept],
        )
    )
    return prediction_reasons(flat).withColumn(
        "low_data", low_data(F.col("objective_delivered"), F.col("target_delivered"))
    )


def predict_channels(requests: DataFrame, events: DataFrame, profiles: DataFrame, customers: DataFrame,
                     daily: DataFrame, campaigns: DataFrame, as_of) -> DataFrame:
    """All valid requests of a raw request table, one row per request and channel."""
    # Written once: five steps read the requests.
    asked = settle(normalize_prediction_requests(requests), "prediction-requests")
    out = predictions(channel_evidence(asked, events, profiles, customers, daily, campaigns, as_of))
    return out.select(
        "request_id", "objective", "scope", "success_event", "recommended_channel", "confidence", "advice", "rank",
        "channel", "predicted_rate", "lower", "upper", "prob_best", "low_data", "opt_out_rate", "bounce_rate",
        "objective_delivered", "objective_successes", "other_delivered", "other_successes",
        F.when(F.col("scope") != "platform", F.col("target_delivered")).alias("target_delivered"),
        F.when(F.col("scope") != "platform", F.col("target_successes")).alias("target_successes"),
        "reasons", "lookback_days", "audience_size", F.lit(V.MODEL_NAME).alias("model"),
        F.lit(V.SAMPLES).alias("samples"),
    )


def _by_channel(name: str) -> Column:
    return F.array(*[
        F.coalesce(F.sum(F.when(F.col("channel") == c, F.col(name))), F.lit(0).cast("long")) for c in V.CHANNELS
    ])


def customer_priors(daily: DataFrame, campaigns: DataFrame, wanted: DataFrame, as_of) -> DataFrame:
    """Capped layer-two Beta parameters as arrays over the channels, one row per objective."""
    ev = platform_evidence(wanted, daily, campaigns, as_of).withColumns({
        "success_event": S.success_event(F.col("objective")),
        "target_successes": F.lit(0).cast("long"), "target_delivered": F.lit(0).cast("long"),
    })
    layered = _capped(_objective_layer(platform_mean(ev, KEY)), F.lit(V.CUSTOMER_STRENGTH))
    at = S.lookup(F.col("channel"), {c: i for i, c in enumerate(V.CHANNELS)}, F.lit(-1))
    return layered.groupBy("objective").agg(
        F.array_sort(F.collect_list(F.struct(at.alias("at"), "a", "b"))).alias("_v")
    ).select("objective", F.col("_v.a").alias("pa"), F.col("_v.b").alias("pb"))


def predict_all_customers(customers: DataFrame, events: DataFrame, daily: DataFrame, campaigns: DataFrame, as_of,
                          lookback_days: int = V.DEFAULT_LOOKBACK_DAYS,
                          objectives: tuple[str, ...] = V.OBJECTIVES) -> DataFrame:
    """Best channel of every customer for every objective.

    Customers with the same responses have the same posterior, so the integrals run once per distinct
    (objective, responses). The answers go back to the customers over a join that is salted for frequent
    patterns, as one of them, above all "no history", can hold most of the customers.
    """
    check_lookback(lookback_days)
    spark = customers.sparkSession
    asked = spark.createDataFrame([(o, lookback_days) for o in objectives], "objective string, lookback_days int")
    priors = customer_priors(daily, campaigns, asked, as_of)
    recent = target_daily(events, as_of).where(F.col("age") <= lookback_days)
    # Written once: the patterns and the answers both read it, and the events cost far more.
    seen = settle(recent.groupBy("customer_id").agg(
        *[_by_channel(t).alias(t) for t in ("delivered", *SUCCESS_TYPES)]
    ), "seen")
    zeros = F.array(*[F.lit(0).cast("long") for _ in V.CHANNELS])
    success = S.success_event(F.col("objective"))
    keyed = (
        customers.select(F.col("id").alias("customer_id"), F.col("external_id").alias("customer"))
        .join(seen, "customer_id", "left")
        .withColumns({t: F.coalesce(t, zeros) for t in ("delivered", *SUCCESS_TYPES)})
        .withColumn("objective", F.explode(F.array(*[F.lit(o) for o in objectives])))
        .select(
            "customer_id", "customer", "objective",
            F.when(success == "converted", F.col("converted")).when(success == "clicked", F.col("clicked"))
            .otherwise(F.col("opened")).alias("s"),
            F.col("delivered").alias("n"),
        )
        .withColumn("n", F.zip_with("s", "n", lambda s, n: F.greatest(s, n)))
    )
    key = ["objective", "s", "n"]
    patterns = settle(keyed.groupBy(*key).agg(F.count("*").alias("rows")), "patterns")
    size = patterns.agg(F.count("*").alias("patterns"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    patterns = patterns.select(*key, F.when(F.col("rows") * FREQUENT > size.rows, SALTS).otherwise(1).alias("salts"))
    # One row per objective, so at most five. Few bytes but much work per row: partitions by the number of
    # patterns, which Spark does not merge.
    vectors = patterns.repartition(size.patterns // PATTERNS_PER_TASK + 1, *key).join(F.broadcast(priors), "objective").select(
        *key, "salts",
        F.zip_with("pa", "s", lambda p, s: p + s).alias("a"),
        F.zip_with("pb", F.zip_with("n", "s", lambda n, s: n - s), lambda p, f: p + f).alias("b"),
    )
    vectors = vectors.withColumn("_z", summaries_in_batches(F.col("a"), F.col("b"), *V.INTERVAL)).select(
        *key, "salts", "a", "b", "_z.*")
    names = F.array(*[F.lit(c) for c in V.CHANNELS])

    def finish(p: Column, i: Column) -> Column:
        a, b, prob = F.get(F.col("a"), i), F.get(F.col("b"), i), S.round4(p)
        return F.struct(
            (-S.round4(a / (a + b))).alias("o1"), (-prob).alias("o2"), i.alias("o3"), F.get(names, i).alias("channel"),
            prob.alias("prob_best"), S.round4(F.get(F.col("lower"), i)).alias("lower"),
            S.round4(F.get(F.col("upper"), i)).alias("upper"),
        )

    ranked = vectors.withColumn("_r", F.array_sort(F.transform("prob_best", finish))).select(*key, "salts", "_r")
    answer = advice_columns(F.col("_r"), F.lit("customer"), S.success_event(F.col("objective")))
    best = F.get(F.col("_r"), F.lit(0))
    answers = ranked.select(
        *key, *[c.alias(k) for k, c in answer.items()],
        (-best["o1"]).alias("predicted_rate"), best["prob_best"].alias("prob_best"),
        best["lower"].alias("lower"), best["upper"].alias("upper"),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("_salt"),
    )
    # Fewer than FREQUENT rows.
    frequent = patterns.where(F.col("salts") > 1)
    salted = keyed.join(F.broadcast(frequent), key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64("customer_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    return salted.join(answers, [*key, "_salt"]).drop("_salt", "salts", "s", "n")
