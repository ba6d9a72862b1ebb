"""Colour arithmetic and colour names as Column expressions.

The ranges below are fixed values: they decide which pixels belong to which named colour.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hue intervals (inclusive), saturation and value bounds per colour name.
NAMED = {
    "red": dict(hues=[(0, 10), (170, 180)], s_min=50, v_min=50),
    "orange": dict(hues=[(10, 25)], s_min=50, v_min=50),
    "yellow": dict(hues=[(25, 35)], s_min=50, v_min=50),
    "green": dict(hues=[(35, 85)], s_min=50, v_min=50),
    "cyan": dict(hues=[(85, 100)], s_min=50, v_min=50),
    "blue": dict(hues=[(100, 130)], s_min=50, v_min=50),
    "purple": dict(hues=[(130, 150)], s_min=50, v_min=50),
    "magenta": dict(hues=[(150, 170)], s_min=50, v_min=50),
    "black": dict(hues=[(0, 180)], s_max=50, v_min=10, v_max=80),
    "gray": dict(hues=[(0, 180)], s_max=50, v_min=60, v_max=180),
    "white": dict(hues=[(0, 180)], s_max=30, v_min=200),
}
# The finer classes of the classification pass.
CLASSES = {
    "cyan": dict(hues=[(80, 100)], s_min=40, v_min=50),
    "teal": dict(hues=[(100, 110)], s_min=40, v_min=50),
    "green": dict(hues=[(35, 80)], s_min=50, v_min=50),
    "blue": dict(hues=[(110, 130)], s_min=50, v_min=50),
    "purple": dict(hues=[(130, 155)], s_min=30, v_min=50),
    "magenta": dict(hues=[(155, 175)], s_min=30, v_min=50),
    "red": dict(hues=[(0, 10)], s_min=50, v_min=50),
    "red2": dict(hues=[(175, 180)], s_min=50, v_min=50),
    "orange": dict(hues=[(10, 25)], s_min=50, v_min=50),
    "yellow": dict(hues=[(25, 35)], s_min=50, v_min=50),
    "gray": dict(hues=[(0, 180)], s_max=50, v_min=80, v_max=180),
    "black": dict(hues=[(0, 180)], s_max=50, v_max=80),
}
# Upper ends (exclusive) of the hue bands; hues below the first or from the last on are red.
HUE_BANDS = [(8, "red"), (25, "orange"), (35, "yellow"), (85, "green"), (100, "cyan"), (130, "blue"), (150, "purple"), (165, "magenta")]


def hsv(b: Column, g: Column, r: Column) -> dict[str, Column]:
    """8-bit HSV (h in 0..180) and gray of 8-bit BGR, with the rounding of the usual fixed-point tables."""
    v, low = F.greatest(b, g, r), F.least(b, g, r)
    d = v - low
    s_div = F.rint(F.lit(255 * 4096) / F.greatest(v, F.lit(1))).cast("int")
    h_div = F.rint(F.lit(180 * 4096) / (6 * F.greatest(d, F.lit(1)))).cast("int")
    s = F.when(v == 0, 0).otherwise(F.shiftright(d * s_div + 2048, 12))
    turn = F.when(v == r, g - b).when(v == g, b - r + 2 * d).otherwise(r - g + 4 * d)
    h = F.shiftright(F.when(d == 0, 0).otherwise(turn * h_div) + 2048, 12)
    h = F.when(h < 0, h + 180).otherwise(h)
    gray = F.shiftright(b * 3735 + g * 19235 + r * 9798 + 16384, 15)
    return {"h": h.cast("int"), "s": s.cast("int"), "v": v.cast("int"), "gray": gray.cast("int")}


def in_range(spec: dict, h="h", s="s", v="v") -> Column:
    """Inclusive HSV box with one or two hue intervals."""
    hue = reduce(lambda a, c: a | c, [F.col(h).between(lo, hi) for lo, hi in spec["hues"]])
    return (hue & F.col(s).between(spec.get("s_min", 0), spec.get("s_max", 255))
            & F.col(v).between(spec.get("v_min", 0), spec.get("v_max", 255)))


def hue_name(h: Column) -> Column:
    name = F.when(h >= HUE_BANDS[-1][0], "red")
    for end, label in HUE_BANDS:
        name = name.when(h < end, label)
    return name


def isolated(color: str) -> Column | None:
    """The strict ranges used when one colour is cut out or removed; None for names without a range."""
    h, s, v = F.col("h"), F.col("s"), F.col("v")
    strong = (s > 50) & (v > 50)
    return {
        "black": (s < 50) & (v > 10) & (v < 120),
        "gray": (s < 50) & (v >= 80) & (v < 180),
        "red": ((h < 10) | (h > 170)) & strong,
        "green": h.between(35, 85) & strong,
        "blue": h.between(100, 130) & strong,
        "cyan": h.between(85, 100) & strong,
    }.get(color)
