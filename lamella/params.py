"""Named thresholds. One frozen object, so that a run's settings are a value."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Params:
    """Fixed values of the layer analysis."""

    min_confidence: float = 0.35
    sure_confidence: float = 0.85
    tall_ratio: float = 2.4
    touch_pixels: int = 20
    touch_reach: int = 2
    overlap_pixels: int = 100
    duplicate_pixels: int = 200
    duplicate_iou: float = 0.6
    containment: float = 0.5
    logo_share: float = 0.5
    margin: float = 0.15
    ambiguous_budget: int = 12
    min_hole: int = 30
    black_level: int = 8
    max_black: float = 0.02
    min_std: float = 6.0
    max_delta: float = 90.0
    min_request_pixels: int = 3_686_400
    max_request_side: int = 2800

    def snapshot(self) -> dict:
        return asdict(self)


DEFAULT = Params()
