"""Settings of each area, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ExtractConfig:
    """How pages become links. domain: a part that the target's host must contain, None for any."""

    max_links: int | None = None
    domain: str | None = None
    exact_host: bool = False
    parser: str = "regex"

    def __post_init__(self):
        if self.parser not in ("regex", "html"):
            raise ValueError(f"unknown parser {self.parser!r}")


@dataclass(frozen=True)
class RankConfig:
    """PageRank: damping, most iterations, and the bound of the change under which it stops (None: never)."""

    damping: float = 0.85
    max_iterations: int = 100
    threshold: float | None = 1e-6
    norm: str = "l1"
    #: Iterations between looks at the change; the result does not depend on it.
    block: int = 5

    def __post_init__(self):
        if self.norm not in ("l1", "linf"):
            raise ValueError(f"unknown norm {self.norm!r}")
        if not 0 <= self.damping <= 1 or self.max_iterations < 0 or self.block < 1:
            raise ValueError("damping lies in [0, 1], max_iterations is not negative, block is positive")


@dataclass(frozen=True)
class GrowthConfig:
    """Shares of the pages, by id, that versions 0, 1, ... hold."""

    shares: tuple[float, ...] = (0.6, 0.75, 0.875, 1.0)


@dataclass(frozen=True)
class GeneratorConfig:
    """A clustered preferential-attachment graph."""

    communities: int = 64
    edges_per_node: int = 4
    cross_share: float = 0.1
    dangling_share: float = 0.05
    seed: int = 42
