"""All registered queries."""

from fleetlens.plans import (  # noqa: F401
    configuration,
    journal,
    permissions,
    replicas,
    storage,
    telemetry,
)
from fleetlens.plans.registry import QUERIES

__all__ = ["QUERIES"]
