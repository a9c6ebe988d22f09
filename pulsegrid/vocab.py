"""Fixed vocabularies and constants of the data model."""

from __future__ import annotations

import math

# Enumerations.
CHANNELS = ("email", "sms", "whatsapp", "push", "web")
EVENT_TYPES = (
    "sent", "delivered", "opened", "clicked",
    "converted", "bounced", "unsubscribed", "complained",
)
OBJECTIVES = ("conversion", "engagement", "retention", "reactivation", "awareness")
CAMPAIGN_STATUSES = ("draft", "active", "paused", "completed")
EVENT_STATUSES = ("pending", "processed", "failed", "duplicate")
TERMINAL_STATUSES = ("processed", "duplicate", "failed")
TRENDS = ("rising", "stable", "declining")
POSITIVE_TYPES = ("opened", "clicked", "converted")
NEGATIVE_TYPES = ("bounced", "unsubscribed", "complained")
LOG_STAGES = ("ingested", "duplicate", "processed", "retry", "dead_lettered", "replayed")
ERROR_MODE_STAGES = ("retry", "dead_lettered", "replayed")
LOG_LEVELS = ("debug", "info", "warn", "error")
LOG_MODES = ("all", "errors", "off")
AREAS = ("audience", "channel", "timing", "segmentation", "strategy", "risk")

# Score weight of each event type.
EVENT_WEIGHTS = {
    "sent": 0.0,
    "delivered": 0.2,
    "opened": 1.0,
    "clicked": 2.0,
    "converted": 5.0,
    "bounced": -1.0,
    "unsubscribed": -3.0,
    "complained": -5.0,
}

# Scoring.
HALF_LIFE_SECONDS = 14 * 86400
DECAY_RATE = math.log(2) / HALF_LIFE_SECONDS
SCORE_K = 10.0
TREND_DAYS = 7

# Audience selection.
DEFAULT_CAP = 3
DEFAULT_CAP_HOURS = 168
POOL_MULTIPLIER = 10
POOL_CEILING = 200_000
MAX_AUDIENCE_SIZE = 100_000

# Audience boosts as (conversions, positive events, dormancy).
OBJECTIVE_BOOSTS = {
    "conversion": (0.30, 0.05, 0.0),
    "engagement": (0.05, 0.25, 0.0),
    "reactivation": (0.10, 0.05, 0.30),
    "retention": (0.10, 0.10, 0.0),
    "awareness": (0.0, 0.0, 0.0),
}

# Channel prediction model.
SUCCESS_EVENT = {
    "conversion": "converted",
    "engagement": "clicked",
    "retention": "opened",
    "reactivation": "opened",
    "awareness": "opened",
}
DEFAULT_RATES = {"converted": 0.02, "clicked": 0.03, "opened": 0.20}
PRIOR_CHANNEL = 100.0
PRIOR_OBJECTIVE = 50.0
AUDIENCE_STRENGTH = 500.0
CUSTOMER_STRENGTH = 30.0
LOW_DATA_BELOW = 200
SAMPLES = 4000
INTERVAL = (0.05, 0.95)
DEFAULT_LOOKBACK_DAYS = 90
MAX_LOOKBACK_DAYS = 365
RISK_MIN_VOLUME = 100
MODEL_NAME = "beta-binomial-hierarchical-v1"

# Narrative benchmarks and sample floor.
BENCHMARKS = {
    "open_rate_pct_good": 20.0,
    "click_rate_pct_good": 3.0,
    "conversion_rate_pct_good": 1.0,
    "bounce_rate_pct_bad": 5.0,
    "unsub_rate_pct_bad": 0.5,
}
MIN_SAMPLE_SENDS = 30
RULE_PROVIDER = "rule-based-fallback"
OBJECTIVE_AREA = {
    "conversion": "segmentation",
    "engagement": "timing",
    "retention": "risk",
    "reactivation": "audience",
    "awareness": "channel",
}

# Processing and paging.
MAX_ATTEMPTS = 5
STUCK_AFTER_SECONDS = 30
DEFAULT_PAGE = 50
MAX_PAGE = 200

# Fixed values: (method, route) -> action of the activity log.
ACTIONS = {
    ("POST", "/api/v1/events"): "events.ingest",
    ("GET", "/api/v1/customers/:id"): "customer.view",
    ("GET", "/api/v1/customers/:id/timeline"): "customer.timeline",
    ("GET", "/api/v1/campaigns"): "campaign.list",
    ("GET", "/api/v1/campaigns/:id/analytics"): "campaign.analytics",
    ("POST", "/api/v1/audience/recommend"): "audience.recommend",
    ("POST", "/api/v1/campaigns/:id/analyze"): "ai.analyze",
    ("POST", "/api/v1/campaigns/:id/recommend"): "ai.recommend",
    ("POST", "/api/v1/predictions/channel"): "prediction.channel",
    ("GET", "/api/v1/system/dlq"): "dlq.list",
    ("POST", "/api/v1/system/dlq/:id/replay"): "dlq.replay",
    ("GET", "/api/v1/logs"): "logs.events",
    ("GET", "/api/v1/activity"): "logs.activity",
    ("GET", "/api/v1/system/health"): "system.health",
}
UNRECORDED_ACTIONS = ("system.health", "logs.events", "logs.activity")
MAX_QUERY_BYTES = 500
MAX_AGENT_BYTES = 200
