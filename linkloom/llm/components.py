"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import components


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is its least node."""
    return components.connected_components(edges, "a", "b")
