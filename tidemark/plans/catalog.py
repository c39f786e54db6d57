"""Imports every query module so that the registry is complete."""

from tidemark.plans import (  # noqa: F401
    queries_features,
    queries_live,
    queries_meta,
    queries_models,
    queries_quality,
    queries_streaming,
)
from tidemark.plans.registry import REGISTRY  # noqa: F401
