"""Connected components of an edge table."""

from __future__ import annotations

from stagekit.functions.components import connected_components

__all__ = ["connected_components"]
