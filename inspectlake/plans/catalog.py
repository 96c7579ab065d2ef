"""Importing this module registers every query."""

from inspectlake.plans.registry import QUERIES  # noqa: F401
from inspectlake.plans import q_anomaly, q_datasets, q_events, q_fusion, q_health, q_jobs, q_pixels, q_quality  # noqa: F401
