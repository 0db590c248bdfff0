"""Streams must end where the batch queries do."""

from __future__ import annotations

from oracle.rollups import monthly_trend
from oracle.workflow import ORACLES as WORKFLOW

ORACLES = {
    "stream_alerts": WORKFLOW["alert_generation"],
    "stream_alert_state": WORKFLOW["alert_state"],
    "stream_action_state": WORKFLOW["action_state"],
    "stream_monthly_trend": monthly_trend,
}
