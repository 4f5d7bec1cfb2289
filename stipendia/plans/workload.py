"""All registered queries."""

from stipendia.plans import agreement, casework, dashboards, exchange, questions, streams, texts  # noqa: F401
from stipendia.plans.registry import REGISTRY  # noqa: F401
