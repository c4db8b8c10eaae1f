"""Settings: resolutions, blur, chunk planning, checks of parameters."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

#: Pixels of a block by resolution; blur by smoothness at the finest of them: kernel and iterations (fixed values).
RESOLUTIONS = {"low": 16, "medium": 8, "high": 4}
DEFAULT_RESOLUTION = "high"
BLURS = {0: (5, 1), 1: (11, 1), 2: (21, 2)}
#: Chunk planning: share of free memory, its floor, and the least and greatest chunk side (fixed values).
MEMORY_SHARE, LEAST_BUDGET, LEAST_SIDE, MOST_SIDE = 0.01, 64 << 20, 128, 512


@dataclass(frozen=True)
class BlurConfig:
    kernel_size: int
    iterations: int


def blur_config(level: int | None = 1, resolution: str | None = None, enabled: bool = True) -> BlurConfig | None:
    """The label blur for a smoothness level, its kernel in proportion to the block side and odd; None where disabled."""
    if not enabled:
        return None
    kernel, iterations = BLURS[min(2, max(0, 1 if level is None else level))]
    scaled = round(kernel * RESOLUTIONS.get(resolution or DEFAULT_RESOLUTION, RESOLUTIONS[DEFAULT_RESOLUTION]) / RESOLUTIONS[DEFAULT_RESOLUTION])
    return BlurConfig(max(3, scaled | 1), iterations)


def checked_segments(value: object) -> int:
    """The number of segments: a whole number from 1 to 256, since labels are bytes."""
    text = str(value).strip() if value is not None else ""
    if not text:
        raise ValueError("the number of segments is missing")
    try:
        k = int(text)
    except ValueError:
        raise ValueError("the number of segments must be a whole number") from None
    if not 1 <= k <= 256:
        raise ValueError("the number of segments must be from 1 to 256")
    return k


def block_side(resolution: str | None) -> int:
    """Pixels of a block; an unknown resolution is the default."""
    return RESOLUTIONS.get((resolution or DEFAULT_RESOLUTION).lower(), RESOLUTIONS[DEFAULT_RESOLUTION])


@dataclass(frozen=True)
class ChunkPlan:
    chunk_size: int
    overlap: int = 0
    budget_bytes: int = LEAST_BUDGET
    ratio: float = MEMORY_SHARE
    prefetch_depth: int = 2

    def __post_init__(self) -> None:
        if self.overlap >= self.chunk_size:
            raise ValueError("chunks must be longer than their overlap")

    @property
    def stride(self) -> int:
        return max(1, self.chunk_size - self.overlap)

    def should_chunk(self, height: int, width: int) -> bool:
        return max(height, width) > self.chunk_size


@dataclass(frozen=True)
class AdaptiveSettings:
    safety_factor: int = 8
    prefetch_depth: int = 2


@dataclass
class AdaptiveConfig:
    """Settings by tier, with options by free memory: the highest threshold reached, else the lowest."""

    tiers: dict[str, AdaptiveSettings] = field(default_factory=lambda: {"default": AdaptiveSettings()})
    options: dict[str, list[tuple[int, AdaptiveSettings]]] = field(default_factory=dict)
    default_tier: str = "default"

    def __post_init__(self) -> None:
        self.options = {t: sorted(((max(0, int(at)), s) for at, s in found), key=lambda o: o[0]) for t, found in self.options.items()}
        if self.default_tier not in self.tiers:
            self.default_tier = next(iter(self.tiers))

    def settings(self, memory: int | None = None, tier: str | None = None) -> AdaptiveSettings:
        found = self.options.get(tier or self.default_tier, [])
        if memory is not None and found:
            return next((s for at, s in reversed(found) if memory >= at), found[0][1])
        return self.tiers.get(tier or self.default_tier) or self.tiers.get(self.default_tier) or AdaptiveSettings()

    def plan(self, bands: int, free_memory: int, tier: str | None = None) -> ChunkPlan:
        """The chunk whose float bands, times a safety factor, fit the budget."""
        budget = max(int(free_memory * MEMORY_SHARE), LEAST_BUDGET)
        chosen = self.settings(free_memory, tier)
        side = math.isqrt(max(1, budget // (bands * 4 * chosen.safety_factor)))
        return ChunkPlan(max(LEAST_SIDE, min(MOST_SIDE, side)), 0, budget, MEMORY_SHARE, chosen.prefetch_depth)
