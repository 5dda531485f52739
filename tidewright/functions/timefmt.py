"""Times, durations and colors as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subtitle_time(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm with milliseconds rounded half to even and carried."""
    ms = F.bround(seconds * 1000).cast("long")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3600000).cast("long"), (F.floor(ms / 60000) % 60).cast("long"), (F.floor(ms / 1000) % 60).cast("long"), (ms % 1000).cast("long"))


def chapter_time(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("long")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), (F.floor(s / 60) % 60).cast("long"), s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60))


def parse_clock(text: Column) -> Column:
    """Seconds of H:M:S, M:S or a number; 0 for anything else."""
    p = F.split(F.trim(text), ":")
    n = F.transform(p, lambda x: F.when(x.rlike(r"^\d+(\.\d+)?$"), x.cast("double")))
    total = F.aggregate(n, F.lit(0.0), lambda s, x: s * 60 + x)
    return F.coalesce(F.when(F.size(p) <= 3, total), F.lit(0.0))


def parse_rate(text: Column) -> Column:
    """Frames a second of 'num/den'; null if unreadable or divided by zero."""
    p = F.split(text, "/")
    return F.try_divide(F.get(p, F.lit(0)).try_cast("double"), F.coalesce(F.get(p, F.lit(1)).try_cast("double"), F.lit(1.0)))


def gain(db: Column, limit: float = 30.0) -> Column:
    return F.pow(F.lit(10.0), F.greatest(F.lit(-limit), F.least(F.lit(limit), db)) / 20)


def channel(hex_color: Column, at: int) -> Column:
    return F.conv(F.substring(hex_color, at, 2), 16, 10).cast("double") / 255


def luminance(hex_color: Column) -> Column:
    """Relative luminance of #rrggbb."""
    lin = lambda c: F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))
    return 0.2126 * lin(channel(hex_color, 2)) + 0.7152 * lin(channel(hex_color, 4)) + 0.0722 * lin(channel(hex_color, 6))


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two colors, from 1 to 21."""
    return (F.greatest(luminance(a), luminance(b)) + 0.05) / (F.least(luminance(a), luminance(b)) + 0.05)


def ticks(x: Column) -> Column:
    """Seconds of ticks, ten million a second."""
    return x / F.lit(10_000_000.0)


def half_even(x: Column, digits: int) -> Column:
    """Rounded in decimals, halves to the even neighbour."""
    return F.bround(x.cast("decimal(30,10)"), digits).cast("double")


def step_seconds(kind: Column, letters: Column, pause: Column, fps: int = 30) -> Column:
    """How far a step moves the clock, in whole frames and a hold: typing, output, pause; overlays don't."""
    typed = F.ceil(letters * F.lit(0.035) * fps) / fps + 0.3
    shown = F.greatest(F.lit(2), F.ceil(F.lit(0.08) * fps)) / fps + 0.15
    return F.when(kind == "cmd", typed).when(kind == "out", shown).when(kind == "pause", pause).otherwise(F.lit(0.0))


def xfade_offset(seconds: Column, fade: float) -> Column:
    return F.round(F.greatest(F.lit(0.0), seconds - fade), 3)


def hsl(hex_color: Column) -> Column:
    """``h`` in degrees, ``s`` and ``l`` from 0 to 1 of #rrggbb, to six digits."""
    r, g, b = (channel(hex_color, i) for i in (2, 4, 6))
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    d, l = most - least, (most + least) / 2
    turn = F.when(most == r, (g - b) / d).when(most == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    hue = F.when(d == 0, F.lit(0.0)).otherwise(F.when(turn < 0, turn + 6).otherwise(turn) * 60)
    sat = F.when(d == 0, F.lit(0.0)).otherwise(d / (1 - F.abs(2 * l - 1)))
    return F.struct(F.round(hue, 6).alias("h"), F.round(sat, 6).alias("s"), F.round(l, 6).alias("l"))


def hsl_hex(h: Column, s: Column, l: Column) -> Column:
    """#RRGGBB of a hue in degrees, saturation and lightness."""

    def part(n: int) -> Column:
        k = (h / 30 + n) % 12
        c = l - s * F.least(l, 1 - l) * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return F.bround(c * 255).cast("int")

    return F.format_string("#%02X%02X%02X", part(0), part(8), part(4))


def composite(front: Column, back: Column) -> Column:
    """#RRGGBB of #rrggbbaa before an opaque #rrggbb."""
    alpha = channel(front, 8)
    part = lambda i: F.bround((alpha * channel(front, i) + (1 - alpha) * channel(back, i)) * 255).cast("int")
    return F.format_string("#%02X%02X%02X", part(2), part(4), part(6))


# Turns of hue of a harmony, ratios of type scales, hues in degrees that some eyes don't tell apart.
HARMONIES = {"complementary": [0, 180], "analogous": [-30, 0, 30], "triadic": [0, 120, 240], "split-complementary": [0, 150, 210]}
SCALES = {"minor_second": 1.067, "major_second": 1.125, "minor_third": 1.2, "major_third": 1.25, "perfect_fourth": 1.333, "golden": 1.618}
CONFUSED = [
    ("deuteranopia", 0, 30, 90, 150),
    ("deuteranopia", 30, 60, 90, 130),
    ("deuteranopia", 330, 360, 90, 150),
    ("protanopia", 0, 40, 80, 140),
    ("protanopia", 340, 360, 80, 140),
    ("protanopia", 0, 20, 170, 200),
    ("tritanopia", 200, 270, 50, 100),
    ("tritanopia", 220, 260, 40, 80),
    ("tritanopia", 170, 210, 300, 340),
]


def harmony(hex_color: Column, kind: str) -> Column:
    """The colors of a harmony around a color."""
    c = hsl(hex_color)
    return F.array(*(hsl_hex((c["h"] + n + 360) % 360, c["s"], c["l"]) for n in HARMONIES[kind]))


def type_scale(base: Column, ratio: float) -> Column:
    """Sizes from caption to display: the base divided by the ratio, and times its powers, halves to even."""
    return F.struct(*(F.bround(base * F.lit(float(ratio**n))).cast("int").alias(a) for a, n in (("caption", -1), ("body", 0), ("subheading", 1), ("heading", 2), ("display", 3))))
