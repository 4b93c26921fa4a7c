"""Defaults and parameter clamps of the annotation model.

Tables are plain DataFrames keyed by ``v`` (volume) and ``z`` (slice):

* ``slices(v, z, h, w, pixels)``: one row a slice, pixels row-major;
* ``gray(v, z, h, w, gray)``: the same in 0..255;
* ``runs(v, z, seq, y, x0, x1)``: masks as horizontal runs, ends inclusive;
* ``overlays(v, z, seq, points, label, color, layer, status)``: polygons with metadata;
* ``volumes(v, z_count, h, w)``: one row a volume.
"""

from __future__ import annotations

from dataclasses import dataclass

# Defaults of the annotation model.
DEFAULT_LABEL, DEFAULT_COLOR, DEFAULT_LAYER = "Default", "#ff0000", "Layer 1"
PREVIEW_RGB = (0, 255, 255)
ALL_LAYERS = "All"
OPACITY = 0.2


@dataclass(frozen=True)
class Watershed:
    """Marker parameters, forced into their ranges."""

    fg_ratio: float = 0.35
    open_iterations: int = 1
    bg_dilate: int = 2
    min_area: int = 20

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        put("fg_ratio", min(max(float(self.fg_ratio), 0.01), 0.95))
        put("open_iterations", min(max(int(self.open_iterations), 0), 20))
        put("bg_dilate", min(max(int(self.bg_dilate), 1), 30))
        put("min_area", max(int(self.min_area), 1))


@dataclass(frozen=True)
class LevelSet:
    """Iteration parameters, forced into their ranges; kernels are odd."""

    iterations: int = 20
    kernel: int = 3
    min_area: int = 20

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        put("iterations", max(int(self.iterations), 1))
        kernel = max(int(self.kernel), 1)
        put("kernel", kernel + 1 - kernel % 2)
        put("min_area", max(int(self.min_area), 1))
