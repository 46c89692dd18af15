"""Parameters of the background model and of the mask operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """The model's published defaults."""

    modes: int = 5
    channels: int = 3
    history: int = 250
    background_threshold: float = 16.0
    generation_threshold: float = 9.0
    background_ratio: float = 0.9
    var_init: float = 15.0
    var_min: float = 4.0
    var_max: float = 75.0
    complexity: float = 0.05
    shadow_ratio: float = 0.5
    detect_shadows: bool = False
    adaptive: bool = False
    propagate: bool = False
    confidence: float = 0.5


#: The blur's 15 taps for sigma 5 in 1/256.
BLUR_TAPS = (9, 11, 15, 17, 19, 22, 23, 24, 23, 22, 19, 17, 15, 11, 9)

#: One background pixel in so many passes its first mode on; the steps (y, x) to its neighbours.
PROPAGATION = 16
#: The factors of a pixel's row and column in the number that picks it.
PLACE_HASH = (1000003, 999983)
NEIGHBOURS = ((0, -1), (0, 1), (-1, 0), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1))
