"""All registered queries."""

from panelcast.registry import (  # noqa: F401
    dataset_queries,
    evaluation_queries,
    feature_queries,
    readiness_queries,
    report_queries,
    store_queries,
)
from panelcast.registry.base import REGISTRY  # noqa: F401
