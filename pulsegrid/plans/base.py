"""Domain tables of a data folder and the SQL that states the same tables for the oracle."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.profiles import build_profiles
from pulsegrid.operators.rollups import campaign_daily, derive_sends
from pulsegrid.sources import fixture as X

AS_OF = X.AS_OF


class Tables:
    """Domain tables derived lazily from one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @cached_property
    def customers(self) -> DataFrame:
        return X.customers(self.spark, self.dir)

    @cached_property
    def campaigns(self) -> DataFrame:
        return X.campaigns(self.spark)

    @cached_property
    def events(self) -> DataFrame:
        return X.events(self.spark, self.dir)

    @cached_property
    def daily(self) -> DataFrame:
        return campaign_daily(self.events, AS_OF)

    @cached_property
    def sends(self) -> DataFrame:
        return derive_sends(self.events, AS_OF)

    @cached_property
    def profiles(self) -> DataFrame:
        return build_profiles(self.events, AS_OF)


def flat(df: DataFrame, *names: str) -> DataFrame:
    """Strings, longs and doubles only, without NULL: the common ground of both engines."""
    cols = []
    for field in df.schema.fields:
        if names and field.name not in names:
            continue
        c, t = F.col(f"`{field.name}`"), field.dataType
        if isinstance(t, T.TimestampType):
            c = F.coalesce(F.unix_micros(c), F.lit(-1).cast("long"))
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            c = F.coalesce(F.round(c, 6), F.lit(-1.0)) + F.lit(0.0)
        elif isinstance(t, (T.IntegerType, T.LongType, T.BooleanType)):
            c = F.coalesce(c.cast("long"), F.lit(-1).cast("long"))
        elif isinstance(t, T.ArrayType):
            c = F.coalesce(F.array_join(c.cast("array<string>"), " | "), F.lit(""))
        else:
            c = F.coalesce(c.cast("string"), F.lit(""))
        cols.append(c.alias(field.name))
    return df.select(*cols)


def chooser(values, index: str) -> str:
    return "list_value(" + ", ".join(f"'{v}'" for v in values) + f")[({index}) % {len(values)} + 1]"


_CH = ("email", "sms", "whatsapp", "push", "web")
_OBJ = ("conversion", "engagement", "retention", "reactivation", "awareness")

CUSTOMERS = """
cu AS (
  SELECT c_custkey AS id, 'cust_' || lpad(c_custkey::VARCHAR, 5, '0') AS ext, c_custkey % 10 <> 0 AS is_active,
    CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2023-12-15 00:00:00'
         WHEN c_custkey % 7 = 0 THEN TIMESTAMP '2024-01-25 12:00:00' END AS seen,
    c_mktsegment AS segment
  FROM customer)"""

CAMPAIGNS = f"""
ca AS (
  SELECT i AS id, 'camp_' || lpad(i::VARCHAR, 3, '0') AS ext, 'Campaign ' || i AS name,
    {chooser(_OBJ, 'i')} AS objective, {chooser(_CH, 'i + i // 5')} AS channel,
    {chooser(('draft', 'active', 'paused', 'completed'), 'i')} AS status, i % 4 + 2 AS cap, 168 AS hours,
    TIMESTAMP '2023-11-01' + to_days(i::INTEGER) AS created_at
  FROM range(20) t(i))"""

EVENTS = f"""
ev0 AS (
  SELECT event_id AS id, user_id AS customer_id, ts AS occurred_at, props AS payload,
    json_extract_string(props, '$.k')::BIGINT AS k
  FROM events),
ev1 AS (
  SELECT *, CASE WHEN k < 80 AND NOT (k % 20 = 5 AND occurred_at >= TIMESTAMP '2024-01-28') THEN k % 20 END
    AS campaign_id
  FROM ev0),
ev AS (
  SELECT id, 'evt_' || lpad(id::VARCHAR, 9, '0') AS event_id, customer_id, campaign_id,
    CASE WHEN campaign_id IS NULL THEN {chooser(_CH, 'id')}
         ELSE {chooser(_CH, 'campaign_id + campaign_id // 5 + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END')} END AS channel,
    CASE WHEN campaign_id = 13 AND id % 100 BETWEEN 68 AND 79 THEN 'delivered'
         WHEN id % 100 < 35 THEN 'sent' WHEN id % 100 < 68 THEN 'delivered' WHEN id % 100 < 82 THEN 'opened'
         WHEN id % 100 < 90 THEN 'clicked' WHEN id % 100 < 94 THEN 'converted' WHEN id % 100 < 96 THEN 'bounced'
         WHEN id % 100 < 99 THEN 'unsubscribed' ELSE 'complained' END AS type,
    occurred_at,
    occurred_at + to_seconds(CASE WHEN id % 101 = 0 THEN 129600 ELSE id % 90 END) AS received_at, payload,
    CASE WHEN id % 311 = 0 THEN 'failed' ELSE 'processed' END AS status,
    CASE WHEN id % 311 = 0 THEN 5 ELSE 0 END AS attempts,
    'req-' || (id // 50) AS request_id
  FROM ev1 WHERE occurred_at <= TIMESTAMP '2024-01-31'),
pe AS (SELECT * FROM ev WHERE status = 'processed')"""

DAILY = """
daily AS (
  SELECT campaign_id, channel, type, occurred_at::DATE AS day, count(*) AS n
  FROM pe WHERE campaign_id IS NOT NULL GROUP BY ALL)"""

SENDS = """
sends AS (
  SELECT customer_id, campaign_id, channel, occurred_at AS sent_at
  FROM pe WHERE type = 'sent' AND campaign_id IS NOT NULL)"""

WEIGHT = """CASE type WHEN 'delivered' THEN 0.2 WHEN 'opened' THEN 1 WHEN 'clicked' THEN 2 WHEN 'converted' THEN 5
  WHEN 'bounced' THEN -1 WHEN 'unsubscribed' THEN -3 WHEN 'complained' THEN -5 ELSE 0 END::DOUBLE"""

POSITIVE = "type IN ('opened', 'clicked', 'converted')"
NEGATIVE = "type IN ('bounced', 'unsubscribed', 'complained')"

# Independent of the library's path: ranks, an explicit anchor and a list of argmax rows.
PROFILES = f"""
anchors AS (SELECT customer_id, max(occurred_at) AS anchor FROM pe GROUP BY 1),
lastev AS (
  SELECT customer_id, occurred_at AS last_at, type AS last_type
  FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY occurred_at DESC, id) AS rn FROM pe)
  WHERE rn = 1),
folded AS (
  SELECT customer_id, count(*) AS total, count(*) FILTER ({POSITIVE}) AS pos, count(*) FILTER ({NEGATIVE}) AS neg,
    count(*) FILTER (type = 'converted') AS conv,
    sum({WEIGHT} * exp(-ln(2) / 1209600 * (epoch_us(anchor) - epoch_us(occurred_at)) / 1e6)) AS raw
  FROM pe JOIN anchors USING (customer_id) GROUP BY 1),
pref AS (
  SELECT customer_id, channel AS preferred FROM (
    SELECT customer_id, channel, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, channel) AS rn
    FROM pe WHERE {POSITIVE} GROUP BY 1, 2) WHERE rn = 1),
trend AS (
  SELECT customer_id, count(*) FILTER (occurred_at >= TIMESTAMP '2024-01-24') AS cur,
    count(*) FILTER (occurred_at < TIMESTAMP '2024-01-24') AS prior
  FROM ev WHERE {POSITIVE} AND occurred_at >= TIMESTAMP '2024-01-17' GROUP BY 1),
prof AS (
  SELECT f.*, l.last_at, l.last_type, p.preferred,
    CASE WHEN coalesce(cur, 0) > coalesce(prior, 0) THEN 'rising'
         WHEN coalesce(cur, 0) < coalesce(prior, 0) THEN 'declining' ELSE 'stable' END AS trend
  FROM folded f JOIN lastev l USING (customer_id) LEFT JOIN pref p USING (customer_id)
  LEFT JOIN trend USING (customer_id))"""


def sql(body: str, *parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + body


EV = (CUSTOMERS, CAMPAIGNS, EVENTS)
EVD = (*EV, DAILY)
EVP = (*EV, DAILY, SENDS, PROFILES)
