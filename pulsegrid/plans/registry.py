"""All registered queries and their oracles."""

from __future__ import annotations

from pulsegrid.plans import (
    audience_plans,
    campaign_plans,
    ingest_plans,
    log_plans,
    narrative_plans,
    predict_plans,
    profile_plans,
    stream_plans,
)

MODULES = (
    ingest_plans, profile_plans, campaign_plans, audience_plans, predict_plans, narrative_plans, log_plans,
    stream_plans,
)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict:
    return {name: text for module in MODULES for name, text in module.ORACLES.items()}
