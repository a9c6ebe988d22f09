"""Audience recommendation for any number of requests in one job.

By default every match is weighted, customers over their cap leave before the cut, and a request
gets its true best. The named option ``exact=False`` re-ranks a bounded pool instead, the best
10 x size by stored score, of which 2 x size rows are checked for the cap. Requests meet customers
map-side, and either cut is made inside each task before anything is shuffled.

Many requests share ranked lists: a customer's weight depends on the objective alone, so customers are
scored once per objective and walked in bands of falling weight. Requests with the same conditions are
one walk; a walk that has its ``size`` survivors meets no further band, as every weight below is lower.
How many customers match a walk at all is counted by dominance, without meeting them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import vocab as V
from pulsegrid.functions import scalars as S
from pulsegrid.operators.dominance import dominance_counts, placed, score_range, score_ranges
from pulsegrid.operators.profiles import reanchor
from pulsegrid.session import settle
from pulsegrid.sources.tables import from_day

# Requests of one pass are broadcast; more of them are answered in several passes.
REQUESTS_PER_PASS = 2000
# Fan-in of the pool cut: tasks -> buckets -> request.
POOL_BUCKETS = 64
# More requests than this share ranked lists; fewer meet all customers of their channels in one pass.
DIRECT_REQUESTS = 64
# Customers of an objective in the first band at least; every further one is so many times as large.
FIRST_BAND = 10_000
BAND_GROWTH = 8


def validate_audience_requests(requests: DataFrame) -> DataFrame:
    """Adds ``error`` (the first broken rule, else NULL) and the defaulted cap flag."""
    bad_channel = F.filter("channels", lambda c: ~c.isin(*V.CHANNELS))
    error = (
        F.when(~F.coalesce("objective", F.lit("")).isin(*V.OBJECTIVES),
               "objective must be one of conversion|engagement|retention|reactivation|awareness")
        .when(~F.coalesce("channel", F.lit("")).isin(*V.CHANNELS), "channel must be one of email|sms|whatsapp|push|web")
        .when(~F.coalesce("size", F.lit(0)).between(1, V.MAX_AUDIENCE_SIZE), "size must be between 1 and 100000")
        .when(F.col("min_score") < 0, "conditions.min_score must be >= 0")
        .when(F.col("last_active_days") < 0, "conditions.last_active_days must be >= 0")
        .when(F.size(bad_channel) > 0, F.concat(
            F.lit('conditions.channels contains invalid channel "'), F.get(bad_channel, F.lit(0)), F.lit('"')))
    )
    return requests.withColumns({
        "error": error, "respect_cap": F.coalesce("respect_frequency_cap", F.lit(True)),
    })


def pool_limit(size: Column) -> Column:
    return F.least(size * V.POOL_MULTIPLIER, F.lit(V.POOL_CEILING))


def _dormancy_days(last: Column, now: Column) -> Column:
    return S.seconds_between(now, last) / 86400


def objective_score(objective: Column, raw: Column, conversions: Column, positives: Column, last: Column,
                    as_of: Column) -> Column:
    """Raw score plus log-scaled boosts; an unknown objective adds nothing."""
    def weight(i: int) -> Column:
        return S.lookup(objective, {o: w[i] for o, w in V.OBJECTIVE_BOOSTS.items()}, F.lit(0.0))

    days = F.greatest(F.coalesce(_dormancy_days(last, as_of), F.lit(0.0)), F.lit(0.0))
    return (
        raw + weight(0) * F.log1p(conversions.cast("double")) + weight(1) * F.log1p(positives.cast("double"))
        + weight(2) * F.log1p(days)
    )


def top_k(df: DataFrame, k: int, score: str = "score", id_: str = "id") -> DataFrame:
    """Best ``k`` rows by score, then id; a bounded heap in each task, merged."""
    if k <= 0:
        return df.limit(0)
    return df.orderBy(F.col(score).desc(), F.col(id_).asc()).limit(k)


def top_k_per(df: DataFrame, per: list[str], k: Column | int, score: str = "score", id_: str = "id",
              rank: str = "rank") -> DataFrame:
    """Best ``k`` rows of every group with their rank, for groups of bounded size."""
    order = Window.partitionBy(*per).orderBy(F.col(score).desc(), F.col(id_).asc())
    ranked = df.withColumn(rank, F.row_number().over(order))
    return ranked.where(F.col(rank) <= k)


def dedup_candidates(ranked: DataFrame, rank: str = "rank") -> DataFrame:
    """First (best) occurrence of each customer within a request."""
    seen = Window.partitionBy("request_id", "customer_id").orderBy(rank)
    return ranked.withColumn("_seen", F.row_number().over(seen)).where(F.col("_seen") == 1).drop("_seen")


def cap_contexts(campaigns: DataFrame) -> DataFrame:
    """Cap per (channel, objective): the newest campaign, an active one if there is any."""
    best = F.struct(
        (F.col("status") == "active").alias("a"), F.col("created_at").alias("c"), (-F.col("id")).alias("i")
    )
    return campaigns.groupBy("channel", "objective").agg(
        F.max_by("frequency_cap", best).cast("long").alias("cap"),
        F.max_by("frequency_window_hours", best).cast("long").alias("window_hours"),
    )


def cap_context(requests: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Requests with cap and window; the defaults apply where no campaign matches."""
    # At most one row per channel and objective of the vocabulary, so 25 rows.
    known = cap_contexts(campaigns).where(F.col("channel").isin(*V.CHANNELS) & F.col("objective").isin(*V.OBJECTIVES))
    return requests.join(F.broadcast(known), ["channel", "objective"], "left").fillna(
        {"cap": V.DEFAULT_CAP, "window_hours": V.DEFAULT_CAP_HOURS}
    )


def send_counts(sends: DataFrame, windows: DataFrame, as_of) -> DataFrame:
    """Sends per customer in the trailing window, for every distinct ``window_hours`` given.

    One pass over the sends of the longest window: each send is counted once per window it
    falls into, and counts are partial before the shuffle.
    """
    now = S.as_ts(as_of)
    hours = windows.select("window_hours").agg(F.sort_array(F.collect_set("window_hours")).alias("h"))
    age = S.seconds_between(now, F.col("sent_at")) / 3600
    # The longest window bounds the scan, and its folders.
    since = now - F.make_dt_interval(hours=windows.agg(F.max("window_hours").cast("int")).scalar())
    return (
        from_day(sends, since).where((F.col("sent_at") <= now) & (F.col("sent_at") > since))
        .withColumn("_h", hours.scalar())
        .where(age < F.array_max("_h"))
        .select("customer_id", F.explode(F.filter("_h", lambda h: h > age)).alias("window_hours"))
        .groupBy("customer_id", "window_hours").agg(F.count("*").alias("sends"))
    )


def excluded_senders(sends: DataFrame, campaigns: DataFrame, requests: DataFrame) -> DataFrame:
    """Customers with the excluded campaigns they were sent, as a set of external ids.

    Holds only campaigns some request excludes, so a set is as long as the exclusion lists.
    """
    wanted = requests.select(F.explode("exclude_campaign_ids").alias("external_id")).distinct()
    ids = campaigns.join(wanted, "external_id", "left_semi").select(F.col("id").alias("campaign_id"), "external_id")
    got = sends.select("customer_id", "campaign_id").join(ids, "campaign_id")
    return got.groupBy("customer_id").agg(F.collect_set("external_id").alias("sent_campaigns"))


def _base(customers: DataFrame, profiles: DataFrame, excluded: DataFrame) -> DataFrame:
    active = customers.where(F.col("is_active")).select(
        F.col("id").alias("customer_id"), F.col("external_id").alias("customer")
    )
    return (
        active.join(profiles, "customer_id").join(excluded, "customer_id", "left")
        .select(
            "customer_id", "customer", F.col("engagement_score").alias("raw_score"),
            F.coalesce("preferred_channel", F.lit("")).alias("preferred_channel"), "conversions", "positive_events",
            "total_events", "last_event_at", "activity_trend",
            F.coalesce("sent_campaigns", F.array().cast("array<string>")).alias("sent_campaigns"),
        )
    )


@dataclass(frozen=True)
class RequestShape:
    """How many requests there are and how large the largest is: checked, not assumed."""

    count: int
    max_size: int

    @classmethod
    def of(cls, requests: DataFrame) -> RequestShape:
        row = requests.agg(F.count("*").alias("n"), F.max("size").alias("m")).first()
        return cls(row.n, int(row.m or 1))

    @property
    def max_pool(self) -> int:
        return min(self.max_size * V.POOL_MULTIPLIER, V.POOL_CEILING)


def _passes(requests: DataFrame, count: int) -> list[DataFrame]:
    """The request table in parts small enough to broadcast."""
    if count <= REQUESTS_PER_PASS:
        return [requests]
    parts = -(-count // REQUESTS_PER_PASS) * 2
    return [requests.where(F.pmod(F.xxhash64("request_id"), F.lit(parts)) == p) for p in range(parts)]


def audience_prefilter(customers: DataFrame, profiles: DataFrame, sends: DataFrame, campaigns: DataFrame,
                       requests: DataFrame, as_of, shape: RequestShape | None = None) -> DataFrame:
    """Every (request, customer) that passes the request's conditions.

    The join is an equi-join on the preferred channel: a request lists the channels it
    takes, or all of them when it has no such filter. The score floor is inverted on the
    request side so the test on the customer side is a plain comparison.
    """
    asked = _by_channel(requests, as_of).select(
        "request_id", "objective", "channel", "size", "respect_cap", "floor", "since", "excluded", "preferred_channel")
    base = _base(customers, profiles, excluded_senders(sends, campaigns, requests))
    return _met(base, asked, (shape or RequestShape.of(requests)).count, ["preferred_channel"]).drop("sent_campaigns")


def _by_channel(requests: DataFrame, as_of) -> DataFrame:
    """Requests with their conditions as columns, one row for each preferred channel they take (six at most)."""
    now = S.as_ts(as_of)
    everything = F.array(*[F.lit(c) for c in (*V.CHANNELS, "")])
    return requests.withColumns({
        "floor": S.raw_min_score(F.coalesce("min_score", F.lit(0.0))),
        "since": F.when(F.col("last_active_days") > 0, now - F.make_dt_interval(days=F.col("last_active_days"))),
        "excluded": F.coalesce("exclude_campaign_ids", F.array().cast("array<string>")),
        "preferred_channel": F.explode(F.when(F.size("channels") > 0, F.array_distinct("channels")).otherwise(everything)),
    })


def _met(base: DataFrame, asked: DataFrame, count: int, on: list[str]) -> DataFrame:
    """Customers and the requests they pass the conditions of; ``asked`` is of ``count`` requests."""
    keep = (
        (F.col("raw_score") >= F.col("floor"))
        & (F.col("since").isNull() | (F.col("last_event_at") >= F.col("since")))
        & ~F.arrays_overlap("sent_campaigns", "excluded")
    )
    found = [base.join(F.broadcast(part), on).where(keep) for part in _passes(asked, count)]
    return reduce(DataFrame.unionByName, found).drop("floor", "since", "excluded")


def _cut(df: DataFrame, score: str, limit: Column, bound: int, rank: str) -> DataFrame:
    """Best ``limit`` rows per request with their rank; no request's limit exceeds ``bound``.

    ``bound`` is a literal, which lets Spark cut groups before a shuffle. Three fan-ins: each task cuts its own rows, then each (request, bucket of customers) is
    cut, then the request. The last task sorts at most 64 x ``bound`` rows however many match.
    """
    order = [F.col(score).desc(), F.col("customer_id").asc()]
    local = Window.partitionBy("request_id", "_bucket").orderBy(*order)
    whole = Window.partitionBy("request_id").orderBy(*order)
    first = (
        df.withColumn("_bucket", F.pmod(F.xxhash64("customer_id"), F.lit(POOL_BUCKETS)))
        .withColumn(rank, F.row_number().over(local)).where(F.col(rank) <= bound).where(F.col(rank) <= limit)
        .drop(rank, "_bucket")
    )
    ranked = first.withColumn(rank, F.row_number().over(whole))
    return ranked.where(F.col(rank) <= bound).where(F.col(rank) <= limit)


def candidate_pool(candidates: DataFrame, shape: RequestShape) -> DataFrame:
    """Best ``10 x size`` by stored score per request, with the number considered."""
    limit = pool_limit(F.col("size"))
    pooled = _cut(candidates, "raw_score", limit, shape.max_pool, "_pos").drop("_pos")
    return pooled.withColumn("considered", F.count("*").over(Window.partitionBy("request_id"))).withColumn(
        "truncated", F.col("considered") == limit
    )


def apply_frequency_cap(ranked: DataFrame, counts: DataFrame) -> DataFrame:
    """Drop customers at or over the cap and backfill in rank order up to the size.

    Only the best 2 x size rows are checked (size when the cap is off).
    """
    reserve = F.when(F.col("respect_cap"), F.col("size") * 2).otherwise(F.col("size"))
    checked = dedup_candidates(ranked.where(F.col("rank") <= reserve)).join(
        counts, ["customer_id", "window_hours"], "left"
    )
    open_ = checked.where(~F.col("respect_cap") | (F.coalesce("sends", F.lit(0).cast("long")) < F.col("cap")))
    order = Window.partitionBy("request_id").orderBy("rank")
    return (
        open_.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("size"))
        .drop("rank", "sends").withColumnRenamed("_rank", "rank")
    )


def audience_reasons(candidates: DataFrame, as_of) -> DataFrame:
    """Adds two to four reasons per candidate, backed by its numbers."""
    now = S.as_ts(as_of)
    score = S.fixed(S.display_score(F.col("weighted")), 2)
    days = S.days_since(F.col("last_event_at"), now)
    top = (F.col("considered") >= 4) & (F.col("rank") <= F.floor((F.col("considered") + 3) / 4))

    def n(name: str) -> Column:
        return F.col(name).cast("string")

    evidence = (
        F.when((F.col("objective") == "conversion") & (F.col("conversions") > 0),
               F.concat(F.lit("converted "), n("conversions"), F.lit("x")))
        .when((F.col("objective") == "engagement") & (F.col("positive_events") > 0),
              F.concat(n("positive_events"), F.lit(" positive events")))
        .when((F.col("objective") == "reactivation") & (days > 0),
              F.concat(F.lit("dormant "), days.cast("string"), F.lit("d with "), n("total_events"),
                       F.lit(" events history")))
    )
    found = F.array_compact(F.array(
        F.concat(F.lit("score="), score,
                 F.when(top, F.concat(F.lit(" top-quartile of "), n("considered"), F.lit(" considered"))).otherwise("")),
        F.when((F.col("channel") != "") & (F.col("preferred_channel") == F.col("channel")),
               F.concat(F.lit("preferred_channel="), F.col("preferred_channel"), F.lit(" matches"))),
        evidence,
        F.when(days == 0, "active today").when(
            days > 0, F.concat(F.lit("active "), days.cast("string"), F.lit("d ago"))),
        F.when(F.col("activity_trend") == "rising", "activity_trend=rising"),
    ))
    padded = F.when(F.size(found) < 2, F.array_append(found, F.lit("matches all audience filters"))).otherwise(found)
    return candidates.withColumn("reasons", F.slice(padded, 1, 4))


def _weighted(rows: DataFrame, as_of) -> DataFrame:
    return rows.withColumn("weighted", objective_score(
        F.col("objective"), F.col("raw_score"), F.col("conversions"), F.col("positive_events"),
        F.col("last_event_at"), S.as_ts(as_of)))


def eligible_top(found: DataFrame, contexts: DataFrame, counts: DataFrame, shape: RequestShape, as_of) -> DataFrame:
    """The best ``size`` matches of each request by weight, without customers at or over their cap."""
    open_ = _weighted(found, as_of).join(contexts, "request_id").join(counts, ["customer_id", "window_hours"], "left").where(
        ~F.col("respect_cap") | (F.coalesce("sends", F.lit(0).cast("long")) < F.col("cap"))).drop("sends")
    return _cut(open_, "weighted", F.col("size"), shape.max_size, "rank")


def _walks(valid: DataFrame, contexts: DataFrame) -> DataFrame:
    """Requests with their ``walk``: a text of their conditions, equal for requests that share one."""
    conditions = valid.join(contexts, "request_id").withColumns({
        "cap": F.when(F.col("respect_cap"), F.col("cap")), "window_hours": F.when(F.col("respect_cap"), F.col("window_hours")),
        "min_score": F.coalesce("min_score", F.lit(0.0)), "last_active_days": F.coalesce("last_active_days", F.lit(0)),
        "channels": F.sort_array(F.array_distinct(F.coalesce("channels", F.array().cast("array<string>")))),
        "exclude_campaign_ids": F.sort_array(F.array_distinct(F.coalesce("exclude_campaign_ids", F.array().cast("array<string>")))),
    })
    same = ("objective", "min_score", "last_active_days", "channels", "exclude_campaign_ids", "respect_cap", "cap", "window_hours")
    return conditions.withColumn("walk", F.to_json(F.struct(*same)))


def considered_counts(base: DataFrame, walks: DataFrame, as_of) -> DataFrame:
    """(request_id, considered): how many customers pass each walk's conditions, counted without meeting them.

    Customers who were sent an excluded campaign are counted once for each distinct exclusion list and taken off.
    """
    now = S.as_ts(as_of)
    beyond = F.greatest(F.coalesce(walks.agg(F.max("last_active_days") + 1).scalar(), F.lit(1)), F.lit(1))
    asked = walks.select("request_id", S.raw_min_score(F.col("min_score")).alias("floor"), "last_active_days", "channels",
                         "exclude_campaign_ids", F.lit(0).alias("w")).withColumn("beyond", beyond)
    ranges = score_ranges(asked)
    asked = settle(placed(asked, ranges, "floor", "i").withColumn(
        "j", F.when(F.col("last_active_days") > 0, F.col("last_active_days")).otherwise(F.col("beyond")).cast("int")), "asked")
    beyond = F.coalesce(asked.agg(F.max("beyond")).scalar(), F.lit(1))
    idle = F.ceil(S.seconds_between(now, F.col("last_event_at")) / 86400)
    members = base.withColumn("j", F.least(F.greatest(F.coalesce(idle, beyond), F.lit(0)), beyond).cast("int"))
    members = placed(members, ranges, "raw_score", "i").where("i > 0").select(
        "customer_id", "i", "j", F.lit(0).alias("w"), F.col("preferred_channel").alias("channel"), "sent_campaigns", F.lit(1).cast("long").alias("n"))
    channels = ("", *V.CHANNELS)

    def counted(rows: DataFrame, of: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        cells = rows.groupBy("i", "j", "w", "channel", *by).agg(F.sum("n").alias("n"))
        return dominance_counts(cells, of.select("request_id", "i", "j", "w", *by), ("n",), channels, by)

    lists = asked.where(F.size("exclude_campaign_ids") > 0)
    campaigns = lists.select("exclude_campaign_ids", F.explode("exclude_campaign_ids").alias("campaign")).distinct()
    senders = members.withColumn("campaign", F.explode("sent_campaigns")).join(campaigns, "campaign").select(
        "customer_id", "i", "j", "w", "channel", "exclude_campaign_ids", "n").distinct()
    off = counted(senders, lists, ("exclude_campaign_ids",)).withColumn("n", -F.col("n"))
    total = counted(members, asked).unionByName(off).join(asked.select("request_id", "channels"), "request_id")
    return total.where((F.size("channels") == 0) | F.array_contains("channels", F.col("channel"))).groupBy("request_id").agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("considered"))


def _bands(scored: DataFrame, first: int) -> list[dict[str, int]]:
    """For each band the lowest range of weights that it takes, by objective; every band is ``BAND_GROWTH`` times as large.

    What reaches the driver is one number a range and objective, whatever the number of customers.
    """
    held: dict[str, list[tuple[int, int]]] = {}
    for r in scored.groupBy("objective", score_range(F.col("weighted")).alias("range")).count().collect():
        held.setdefault(r.objective, []).append((r.range, r["count"]))
    bands: list[dict[str, int]] = [{}]
    for objective, ranges in held.items():
        number, limit, seen = 0, first, 0
        for at, n in sorted(ranges, reverse=True):
            if seen >= limit:
                number, limit, seen = number + 1, limit * BAND_GROWTH, 0
            if number == len(bands):
                bands.append({})
            bands[number][objective] = at
            seen += n
    return bands


def shared_top(base: DataFrame, walks: DataFrame, counts: DataFrame, shape: RequestShape, as_of,
               counted: list[int] | None = None) -> DataFrame:
    """The best ``size`` survivors of each walk by weight, with their rank, from lists ranked once per objective.

    Each round takes the next band of every objective to the walks that still lack survivors. ``counted`` collects
    the rows that customers and walks made in each round.
    """
    objectives = [r.objective for r in walks.select("objective").distinct().collect()]
    scored = base.withColumn("objective", F.explode(F.array(*[F.lit(o) for o in objectives]).cast("array<string>")))
    scored = settle(_weighted(scored, as_of).withColumn("range", score_range(F.col("weighted"))), "ranked-lists")
    bands, still, found, above = _bands(scored, max(FIRST_BAND, 2 * shape.max_size)), walks, [], {}
    for number, low in enumerate(bands):
        inside = reduce(lambda a, b: a | b, [
            (F.col("objective") == o) & (F.col("range") >= at) & (F.col("range") < above.get(o, 1 << 30)) for o, at in low.items()], F.lit(False))
        above.update(low)
        asked = _by_channel(still, as_of).select("request_id", "objective", "size", "respect_cap", "cap", "window_hours", "floor",
                                                 "since", "excluded", "preferred_channel")
        met = _met(scored.where(inside), asked, shape.count, ["objective", "preferred_channel"])
        if counted is not None:
            counted.append(met.count())
        open_ = met.join(counts, ["customer_id", "window_hours"], "left").where(
            ~F.col("respect_cap") | (F.coalesce("sends", F.lit(0).cast("long")) < F.col("cap"))).drop("sends", "sent_campaigns")
        found.append(settle(_cut(open_, "weighted", F.col("size"), shape.max_size, "rank").drop("rank"), "band"))
        if number + 1 == len(bands):
            break
        got = reduce(DataFrame.unionByName, found).groupBy("request_id").agg(F.count("*").alias("got"))
        still = settle(still.join(got, "request_id", "left").where(
            F.coalesce("got", F.lit(0).cast("long")) < F.col("size")).drop("got"), "open-walks")
        if still.isEmpty():
            break
    return _cut(reduce(DataFrame.unionByName, found), "weighted", F.col("size"), shape.max_size, "rank")


def shared_audience(valid: DataFrame, customers: DataFrame, profiles: DataFrame, sends: DataFrame, campaigns: DataFrame,
                    contexts: DataFrame, counts: DataFrame, shape: RequestShape, as_of,
                    counted: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, pool) of all requests by way of their walks."""
    asked = settle(_walks(valid, contexts), "walks")
    walks = asked.groupBy(F.col("walk").alias("request_id")).agg(F.max("size").alias("size"), *[
        F.first(c).alias(c) for c in ("objective", "min_score", "last_active_days", "channels", "exclude_campaign_ids", "respect_cap",
                                      "cap", "window_hours")])
    walks = settle(walks, "distinct-walks")
    base = settle(_base(customers, profiles, excluded_senders(sends, campaigns, walks)), "audience-base")
    matches = considered_counts(base, walks, as_of).where("considered > 0").withColumnRenamed("request_id", "walk")
    pool = asked.select("request_id", "walk").join(matches, "walk").select("request_id", "considered", F.lit(False).alias("truncated"))
    best = shared_top(base, walks, counts, shape, as_of, counted).withColumnRenamed("request_id", "walk")
    best = best.drop("objective", "size", "respect_cap", "cap", "window_hours")
    chosen = asked.select("request_id", "walk", "objective", "channel", "size").join(best, "walk").where("rank <= size").drop("walk")
    return chosen.join(pool, "request_id"), pool


def ranked_pool(found: DataFrame, shape: RequestShape, as_of) -> DataFrame:
    """The bounded pool ranked by the objective weight."""
    order = Window.partitionBy("request_id").orderBy(F.col("weighted").desc(), F.col("customer_id").asc())
    pool = _weighted(candidate_pool(found, shape), as_of)
    return pool.withColumn("rank", F.row_number().over(order))


def recommend_audience(requests: DataFrame, customers: DataFrame, profiles: DataFrame, sends: DataFrame,
                       campaigns: DataFrame, as_of, exact: bool = True, decayed: bool = False,
                       shared: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, meta) for all valid requests; invalid requests have no rows.

    ``shared`` says whether exact answers come from shared ranked lists; by default the number of requests does.

    Scores are compared as stored, each at its own anchor, unless ``decayed`` brings them to
    ``as_of`` first. ``exact=False`` is the bounded pool.
    """
    if decayed:
        profiles = reanchor(profiles, as_of)
    valid = validate_audience_requests(requests).where(F.col("error").isNull())
    shape = RequestShape.of(valid)
    contexts = cap_context(requests.select("request_id", "channel", "objective"), campaigns).select(
        "request_id", "cap", "window_hours"
    )
    counts = send_counts(sends, contexts, as_of)
    if exact and (shape.count > DIRECT_REQUESTS if shared is None else shared):
        chosen, pool = shared_audience(valid, customers, profiles, sends, campaigns, contexts, counts, shape, as_of)
    elif exact:
        found = audience_prefilter(customers, profiles, sends, campaigns, valid, as_of, shape)
        pool = found.groupBy("request_id").agg(F.count("*").alias("considered")).withColumn("truncated", F.lit(False))
        chosen = eligible_top(found, contexts, counts, shape, as_of).join(pool, "request_id")
    else:
        pool = ranked_pool(audience_prefilter(customers, profiles, sends, campaigns, valid, as_of, shape), shape, as_of)
        chosen = apply_frequency_cap(pool.join(contexts, "request_id"), counts)
    candidates = audience_reasons(chosen, as_of).select(
        "request_id", "customer_id", "customer", S.display_score(F.col("weighted")).alias("score"), "rank", "reasons",
        "considered", "truncated",
    )
    return candidates, audience_meta(requests, pool, candidates)


def audience_meta(requests: DataFrame, pool: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per valid request: pool size, considered, filtered out, truncation, shortfall."""
    valid = validate_audience_requests(requests).where(F.col("error").isNull())
    seen = pool.groupBy("request_id").agg(
        F.max("considered").alias("candidates_considered"), F.bool_or("truncated").alias("candidates_truncated")
    )
    got = candidates.groupBy("request_id").agg(F.count("*").alias("returned"))
    out = (
        valid.select("request_id", "size", "respect_cap").join(seen, "request_id", "left")
        .join(got, "request_id", "left").fillna(0, ["candidates_considered", "returned"])
        .fillna(False, ["candidates_truncated"])
    )
    short = F.col("respect_cap") & (F.col("returned") < F.col("size"))
    return out.select(
        "request_id", "candidates_considered", "returned",
        (F.col("candidates_considered") - F.col("returned")).alias("filtered_out"),
        pool_limit(F.col("size")).alias("candidate_pool_size"), "candidates_truncated",
        F.when(short, "frequency_cap_exhausted").alias("shortfall_reason"),
    )


def over_cap_customers(customers: DataFrame, profiles: DataFrame, sends: DataFrame, campaigns: DataFrame,
                       as_of) -> DataFrame:
    """Active customers at or over the cap of each (channel, objective) context.

    Contexts meet customers on the window length; counts per window are made first.
    """
    contexts = cap_contexts(campaigns).where(
        F.col("channel").isin(*V.CHANNELS) & F.col("objective").isin(*V.OBJECTIVES)
    )
    counts = send_counts(sends, contexts, as_of)
    active = customers.where(F.col("is_active")).select(
        F.col("id").alias("customer_id"), F.col("external_id").alias("customer")
    )
    scored = profiles.select("customer_id", "engagement_score")
    return (
        counts.join(F.broadcast(contexts), "window_hours").where(F.col("sends") >= F.col("cap"))
        .join(active, "customer_id").join(scored, "customer_id")
        .select("customer_id", "customer", "channel", "objective", "cap", "window_hours", "sends", "engagement_score")
    )
