"""Settings of a segmentation, checked once."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np

VARIANTS = ("slic", "real", "l2", "noq", "lsc")


@dataclass(frozen=True)
class SlicConfig:
    """Immutable, so that a copy keeps every setting, the variant included."""

    num_components: int = 400
    compactness: float = 10.0
    min_size_factor: float = 0.25
    subsample_stride: int = 3
    convert_to_lab: bool = True
    preemptive: bool = False
    preemptive_thres: float = 0.05
    manhattan_spatial_dist: bool = True
    debug_mode: bool = False
    variant: str = "slic"

    def __post_init__(self) -> None:
        if not 0 < self.num_components < 65534:
            raise ValueError("num_components must be within 1 and 65533")
        if self.subsample_stride < 1:
            raise ValueError("subsample_stride must be 1 or more")
        if self.variant not in VARIANTS:
            raise ValueError(f"variant must be one of {VARIANTS}")

    def copy(self, **changes) -> SlicConfig:
        return replace(self, **changes)

    def spacing(self, h: int, w: int) -> int:
        s = math.isqrt(h * w // self.num_components)
        if s < 1:
            raise ValueError("more components than pixels")
        return s

    def spatial_coefficient(self, s: int) -> float:
        """Single precision, as whole-number distances are cut off after multiplying with it."""
        shift = 2 if self.convert_to_lab else 1
        return float(np.float32(np.float32(1) / (np.float32(s) / np.float32(self.compactness)) * np.float32(shift)))

    def spatial_table(self, s: int) -> list[int]:
        """The whole-number spatial distance for each |dy| + |dx|."""
        c = np.float32(self.spatial_coefficient(s))
        return [int(np.float32(c * np.float32(d))) for d in range(2 * s + 1)]

    def min_size(self, s: int) -> int:
        return int(np.floor(np.float32(s * s) * np.float32(self.min_size_factor) + np.float32(0.5)))
