"""Registered queries and their oracles."""

from rasterloom.plans import aggregates, assessment, models, scalars, spatial, storage, streams, terrain, timeseries  # noqa: F401
from rasterloom.plans.registry import ORACLES, QUERIES  # noqa: F401
