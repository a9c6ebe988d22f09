import math

from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from tests.helpers import column, one

DAY = 86400.0


def test_weights_and_polarity(spark):
    types = ["sent", "delivered", "opened", "clicked", "converted", "bounced", "unsubscribed", "complained", "other"]
    assert column(spark, types, S.event_weight, "string") == [0, 0.2, 1, 2, 5, -1, -3, -5, 0]
    assert column(spark, types, S.is_positive, "string") == [t in ("opened", "clicked", "converted") for t in types]
    assert column(spark, types, S.is_negative, "string") == [
        t in ("bounced", "unsubscribed", "complained") for t in types]


def test_decay(spark):
    got = column(spark, [14 * DAY, 28 * DAY, 0.0, -3600.0], S.decay_factor)
    assert [round(8 * g, 9) for g in got] == [4, 2, 8, 8]
    row = one(spark, raw=-4.0).select(
        S.decay_raw(F.col("raw"), S.as_ts("2024-01-01"), S.as_ts("2024-01-15")).alias("y")).first()
    assert abs(row.y + 2) < 1e-9


def test_merge_in_and_out_of_order(spark):
    anchor, later, earlier = (S.as_ts(t) for t in ("2024-01-15", "2024-01-29", "2024-01-01"))
    r = spark.range(1).select(
        S.merge_raw(F.lit(4.0), anchor, F.lit(1.0), later).alias("a"),
        S.merge_anchor(anchor, later).cast("string").alias("a_at"),
        S.merge_raw(F.lit(3.0), anchor, F.lit(2.0), earlier).alias("b"),
        S.merge_anchor(anchor, earlier).cast("string").alias("b_at"),
    ).first()
    assert abs(r.a - 3.0) < 1e-9 and r.a_at == "2024-01-29 00:00:00"
    assert abs(r.b - 4.0) < 1e-9 and r.b_at == "2024-01-15 00:00:00"


def test_normalize(spark):
    got = column(spark, [-5.0, 0.0, 10.0, 1e300, 1.0, 2.0], S.normalize)
    assert got[:3] == [0, 0, 0.5]
    assert got[3] < 1 and got[4] < got[5]


def test_raw_min_score(spark):
    got = column(spark, [-1.0, 0.0, 0.2, 0.5, 1.0], S.raw_min_score)
    assert got[0] == got[1] == -S.MAX_DOUBLE and got[4] == S.MAX_DOUBLE
    assert [round(x, 9) for x in got[2:4]] == [2.5, 10]


def test_rates(spark):
    r = spark.range(1).select(
        S.rate(F.lit(5), F.lit(0)).alias("a"), S.rate(F.lit(3), F.lit(-1)).alias("b"),
        S.rate(F.lit(1), F.lit(4)).alias("c"), S.derived_rate(F.lit(1), F.lit(0), F.lit(0.7)).alias("d"),
    ).first()
    assert tuple(r) == (0, 0, 0.25, 0.7)


def test_text_formats_round_like_binary_values(spark):
    values = [0.15, 6.25, 12.35, 0.25, 99.95, 1234.5, 0.0]
    assert column(spark, values, lambda x: S.fixed(x, 1)) == [f"{v:.1f}" for v in values]
    assert column(spark, values, lambda x: S.fixed(x, 0)) == [f"{v:.0f}" for v in values]
    assert column(spark, [0.0412], S.pct) == ["4.1%"]
    assert column(spark, [0.041249], S.round4) == [0.0412]
    assert column(spark, [1234567], S.thousands, "long") == ["1,234,567"]
    assert column(spark, [20.0, 21.5, 0.5], S.fnum) == ["20", "21.5", "0.5"]
    assert column(spark, [-0.54, 0.0], S.signed_pct0) == ["-54%", "+0%"]


def test_display_days_nulls_levels(spark):
    assert column(spark, [-1.0, 0.0, 1.0], S.display_score) == [0, 0, 0.5]
    now = S.as_ts("2024-01-31")
    got = column(spark, ["2024-01-28 23:00:00", "2024-02-03", "2024-01-30 01:00:00", None],
                 lambda x: S.days_since(x.cast("timestamp"), now), "string")
    assert got == [2, 0, 0, -1]
    assert column(spark, ["", "a"], S.nullif_empty, "string") == [None, "a"]
    assert column(spark, [0, 3], S.nullif_zero, "long") == [None, 3]
    assert column(spark, [200, 399, 400, 499, 500], S.access_level, "int") == ["info", "info", "warn", "warn", "error"]
    assert column(spark, [0.9, 0.89, 0.65, 0.64], S.confidence_label) == ["high", "medium", "medium", "low"]


def test_truncate_text(spark):
    got = column(spark, ["  abc  ", "q" * 600, "é" * 300], lambda x: S.truncate_text(x, 501), "string")
    assert got == ["abc", "q" * 501 + "…", "é" * 250 + "…"]


def test_log1p_and_exp_available(spark):
    assert math.isclose(spark.range(1).select(F.log1p(F.lit(1.0))).first()[0], math.log(2))
