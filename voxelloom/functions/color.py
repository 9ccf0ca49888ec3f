"""Colours: hex codes, the region palette and the built-in transfer functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The ten region colours, used cyclically.
ROI_COLORS = (
    "#ff4d4f", "#ff9f1a", "#ffd60a", "#52c41a", "#16c79a",
    "#36cfc9", "#40a9ff", "#597ef7", "#9254de", "#eb2f96",
)

# Colour stops (position, red, green, blue, alpha) of the transfer functions.
TRANSFER_STOPS = {
    "CT Bone": [
        (0.0, 0, 0, 0, 0), (0.3, 0, 0, 0, 0), (0.45, 180, 60, 30, 20),
        (0.65, 255, 200, 150, 120), (0.85, 255, 240, 220, 200), (1.0, 255, 255, 255, 255),
    ],
    "CT Soft Tissue": [
        (0.0, 0, 0, 0, 0), (0.15, 0, 0, 0, 0), (0.3, 180, 50, 50, 40),
        (0.5, 220, 130, 100, 100), (0.7, 255, 200, 170, 60), (1.0, 255, 255, 255, 30),
    ],
    "Hot Metal": [
        (0.0, 0, 0, 0, 0), (0.2, 30, 0, 0, 10), (0.4, 180, 30, 0, 60),
        (0.6, 255, 130, 0, 120), (0.8, 255, 220, 80, 180), (1.0, 255, 255, 200, 255),
    ],
    "Cool-Warm": [
        (0.0, 60, 60, 200, 0), (0.2, 60, 100, 220, 30), (0.4, 100, 180, 220, 80),
        (0.5, 200, 200, 200, 40), (0.6, 220, 160, 100, 80), (0.8, 220, 80, 60, 30), (1.0, 200, 40, 40, 0),
    ],
    "Grayscale": [
        (0.0, 0, 0, 0, 0), (0.1, 25, 25, 25, 10), (0.5, 128, 128, 128, 128), (1.0, 255, 255, 255, 255),
    ],
}


def roi_color(index: Column) -> Column:
    """Palette colour of a zero-based index; negative indices count as zero."""
    palette = F.array(*[F.lit(c) for c in ROI_COLORS])
    i = F.greatest(F.lit(0), F.floor(index).cast("int"))
    return F.element_at(palette, (i % F.lit(len(ROI_COLORS)) + 1).cast("int"))


def normalize_hex(text: Column) -> Column:
    """``#rrggbb`` in lower case, or null when the text is no six-digit hex colour."""
    digits = F.regexp_extract(F.trim(text), r"^#?([0-9a-fA-F]{6})$", 1)
    return F.when(digits != "", F.concat(F.lit("#"), F.lower(digits)))


def hex_to_rgb(text: Column) -> Column:
    """Struct r, g, b in 0..1; red when the text is no hex colour."""
    digits = F.trim(F.regexp_replace(text, r"^([^#]*)#", "$1"))
    ok = digits.rlike("^[0-9a-fA-F]{6}$")

    def channel(start: int, fallback: float) -> Column:
        value = F.conv(F.substring(digits, start, 2), 16, 10).cast("double") / F.lit(255.0)
        return F.when(ok, value).otherwise(F.lit(fallback))

    return F.struct(channel(1, 1.0).alias("r"), channel(3, 0.0).alias("g"), channel(5, 0.0).alias("b"))
