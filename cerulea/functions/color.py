"""Colour, shape and confidence as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WaterThresholds:
    """Fixed values of the water signature."""

    min_alpha: int = 200
    hue_low: float = 148
    hue_high: float = 215
    min_value: float = 0.24
    min_saturation: float = 0.34
    pale_saturation: float = 0.2
    pale_value: float = 0.5
    blue_over_red: int = 10
    green_over_red: int = -8
    blue_over_green_low: int = -12
    blue_over_green_high: int = 70
    strict_low: float = 168
    strict_high: float = 205


def hsv(r, g, b) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value of 0-255 channels. On ties red goes before green before blue; grey has hue 0."""
    r, g, b = (c.cast("double") / 255 for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    safe = F.when(d == 0, 1.0).otherwise(d)
    hue = F.when(d == 0, 0.0).when(top == r, ((g - b) / safe) % 6).when(top == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4) * 60
    return F.when(hue < 0, hue + 360).otherwise(hue), F.when(top == 0, 0.0).otherwise(d / F.when(top == 0, 1.0).otherwise(top)), top


def is_water(r, g, b, a, h, s, v, t: WaterThresholds = WaterThresholds()) -> Column:
    colour = (h >= t.hue_low) & (h <= t.hue_high) & (v >= t.min_value) & ((s >= t.min_saturation) | ((s >= t.pale_saturation) & (v >= t.pale_value)))
    return (a >= t.min_alpha) & colour & (b - r >= t.blue_over_red) & (g - r >= t.green_over_red) & (b - g).between(t.blue_over_green_low, t.blue_over_green_high)


def is_strict(h, s, t: WaterThresholds = WaterThresholds()) -> Column:
    """The narrow band of pool water, on stored single-precision values."""
    return (h >= t.strict_low) & (h <= t.strict_high) & (s >= F.lit(t.min_saturation))


def unit(x) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def confidence(strict, hue, saturation, texture, fill, area, truncated) -> Column:
    """0 to 1 in thousandths: a weighted sum of six criteria, lowered for cut-off and for rough sparse shapes."""
    # fixed values: the weights, and where each criterion begins and ends
    parts = (
        (0.30, strict),
        (0.18, F.exp(-(hue - 189) * (hue - 189) / (2 * 26 * 26))),
        (0.14, unit((saturation - 0.15) / 0.45)),
        (0.15, unit((0.1 - texture) / 0.08)),
        (0.12, unit((fill - 0.28) / 0.45)),
        (0.11, F.when(area < 10, unit(area / 10)).when(area <= 150, 1.0).otherwise(F.greatest(F.lit(0.25), 1 - (area - 150) / 2500))),
    )
    c = F.lit(0.0)
    for weight, part in parts:
        c = c + weight * part
    c = F.when(truncated, c * 0.9).otherwise(c)
    c = F.when((texture > 0.1) & (fill < 0.5), c * 0.78).otherwise(c)
    return F.floor(unit(c) * 1000 + 0.5) / 1000
