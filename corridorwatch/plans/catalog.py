"""All named queries; importing the modules registers them."""

from corridorwatch.plans import (  # noqa: F401
    queries_build,
    queries_dispatch,
    queries_metrics,
    queries_models,
    queries_review,
)
from corridorwatch.plans.registry import ORACLE, QUERIES  # noqa: F401
