"""Scalar building blocks as Column expressions (all stay in the JVM)."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid import vocab as V

MAX_DOUBLE = 1.7976931348623157e308


def as_ts(value) -> Column:
    """A timestamp literal from a string, a datetime or a Column."""
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("timestamp")


def lookup(col: Column, table: Mapping, default) -> Column:
    """Constant table lookup as one CASE expression."""
    out = None
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return out.otherwise(default)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def event_weight(event_type: Column) -> Column:
    return lookup(event_type, V.EVENT_WEIGHTS, F.lit(0.0))


def is_positive(event_type: Column) -> Column:
    return event_type.isin(*V.POSITIVE_TYPES)


def is_negative(event_type: Column) -> Column:
    return event_type.isin(*V.NEGATIVE_TYPES)


def decay_factor(seconds: Column) -> Column:
    """exp(-rate * seconds); never above 1, so a future time cannot inflate."""
    return F.exp(F.lit(-V.DECAY_RATE) * F.greatest(seconds, F.lit(0.0)))


def decay_raw(raw: Column, anchor: Column, now: Column) -> Column:
    return raw * decay_factor(seconds_between(now, anchor))


def block_end(ts: Column) -> Column:
    """The end of the 365-day block (counted from 1970) that holds a time: the anchor of partial sums."""
    span = 365 * 86400 * 1000000
    return F.timestamp_micros((F.call_function("div", F.unix_micros(ts) - F.pmod(F.unix_micros(ts), F.lit(span)), F.lit(span)) + 1)
                              * F.lit(span))


def moved_raw(raw: Column, anchor: Column, to: Column) -> Column:
    """A decayed sum moved to another anchor. Block anchors lie at most a block after the newest
    event, so the factor is never above 2^26.1, and far smaller where time has passed."""
    return raw * F.exp(F.lit(-V.DECAY_RATE) * seconds_between(to, anchor))


def merge_anchor(left: Column, right: Column) -> Column:
    return F.greatest(left, right)


def merge_raw(raw_a: Column, anchor_a: Column, raw_b: Column, anchor_b: Column) -> Column:
    """Sum of two decayed sums at the later of both anchors; a single event is (weight, time)."""
    top = merge_anchor(anchor_a, anchor_b)
    return decay_raw(raw_a, anchor_a, top) + decay_raw(raw_b, anchor_b, top)


def normalize(raw: Column) -> Column:
    """Unbounded raw score to [0, 1)."""
    return F.when(raw <= 0, F.lit(0.0)).otherwise(
        F.least(raw / (raw + F.lit(V.SCORE_K)), F.lit(math.nextafter(1.0, 0.0)))
    )


def raw_min_score(score: Column) -> Column:
    """Normalized floor to raw units, so the filter is a plain column comparison."""
    return (
        F.when(score <= 0, F.lit(-MAX_DOUBLE))
        .when(score >= 1, F.lit(MAX_DOUBLE))
        .otherwise(F.lit(V.SCORE_K) * score / (F.lit(1.0) - score))
    )


def rate(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def derived_rate(num: Column, den: Column, fallback: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(fallback)


def round4(x: Column) -> Column:
    return F.floor(x * 10000 + F.lit(0.5)) / F.lit(10000.0)


def pct1(x: Column) -> Column:
    """Fraction to a percentage with one decimal."""
    return F.floor(x * 1000 + F.lit(0.5)) / F.lit(10.0)


def fixed(x: Column, digits: int) -> Column:
    """Fixed decimals, rounded half-even on the exact binary value (unlike format_string)."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def pct(x: Column) -> Column:
    return F.concat(fixed(x * 100, 1), F.lit("%"))


def signed_pct0(x: Column) -> Column:
    return F.concat(F.when(x >= 0, F.lit("+")).otherwise(F.lit("")), fixed(x * 100, 0), F.lit("%"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def fnum(x: Column) -> Column:
    """Shortest form of a value with at most a few decimals: 20.0 -> 20, 21.5 -> 21.5."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def display_score(weighted: Column) -> Column:
    return F.when(weighted <= 0, F.lit(0.0)).otherwise(weighted / (weighted + 1))


def days_since(last: Column, now: Column) -> Column:
    """Whole days; a future time counts as 0 and no time as -1."""
    days = F.floor(seconds_between(now, last) / 86400)
    return F.when(last.isNull(), F.lit(-1).cast("long")).otherwise(F.greatest(days, F.lit(0).cast("long")))


def nullif_empty(s: Column) -> Column:
    return F.when(s != "", s)


def nullif_zero(n: Column) -> Column:
    return F.when(n != 0, n)


def trim_space(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def truncate_text(s: Column, limit: int) -> Column:
    """Trim, then cut to ``limit`` bytes and mark the cut with an ellipsis."""
    text = trim_space(s)
    raw = F.encode(text, "UTF-8")
    # A cut inside a multi-byte character is not valid UTF-8: back off to the last whole one.
    whole = [
        F.call_function("try_validate_utf8", F.substring(raw, 1, limit - back).cast("string"))
        for back in range(min(4, limit))
    ]
    return F.when(F.octet_length(text) <= limit, text).otherwise(
        F.concat(F.coalesce(*whole, F.lit("")), F.lit("…"))
    )


def success_event(objective: Column) -> Column:
    return lookup(objective, V.SUCCESS_EVENT, F.lit(None).cast("string"))


def confidence_label(prob_best: Column) -> Column:
    return F.when(prob_best >= 0.90, "high").when(prob_best >= 0.65, "medium").otherwise("low")


def access_level(status: Column) -> Column:
    return F.when(status >= 500, "error").when(status >= 400, "warn").otherwise("info")


def trend_label(current: Column, prior: Column) -> Column:
    return F.when(current > prior, "rising").when(current < prior, "declining").otherwise("stable")


def let(value: Column, body) -> Column:
    """body(value) with ``value`` evaluated once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def joined(array: Column) -> Column:
    return F.array_join(array, " | ")
