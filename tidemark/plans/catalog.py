"""All registered queries."""

from __future__ import annotations

from tidemark.plans import (  # noqa: F401
    q_assemblies,
    q_history,
    q_incremental,
    q_models,
    q_scalars,
    q_sources,
    q_state,
    q_tables,
    q_text,
    q_views,
)
from tidemark.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
