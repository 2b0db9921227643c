"""Column expressions: calibration, colour, text numbers, units, keys. All run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, lo), hi)


# ------------------------------------------------------------ calibration


def calibrate_time(x: Column, width: Column, x_lo: Column, x_hi: Column) -> Column:
    return x_lo + x / width * (x_hi - x_lo)


def calibrate_survival(y: Column, height: Column, y_lo: Column, y_hi: Column, bounded: bool = True) -> Column:
    """Pixel rows grow downward, survival upward."""
    s = y_hi - y / height * (y_hi - y_lo)
    return clip(s, y_lo, y_hi) if bounded else s


def linear_survival(y: Column, slope: Column, intercept: Column) -> Column:
    return clip(slope * y + intercept, F.lit(0.0), F.lit(1.0))


def loose_survival(s: Column) -> Column:
    """Survival read off a vector figure, allowed a little outside [0, 1]."""
    return clip(s, F.lit(-0.05), F.lit(1.05))


def normalize_percent(value: Column, unit: Column) -> Column:
    return F.when(unit == "percentage", value / 100.0).otherwise(value)


# ------------------------------------------------------------ colour


def rgb_to_hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue 0-360, saturation and lightness 0-1; where channels tie for the maximum, blue decides over green over red."""
    r, g, b = (c / 255.0 for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    light = (top + low) / 2.0
    sat = F.when(span == 0, F.lit(0.0)).when(light < 0.5, span / (top + low)).otherwise(span / (2.0 - top - low))
    safe = F.when(span == 0, F.lit(1.0)).otherwise(span)
    sector = (
        F.when(span == 0, F.lit(0.0))
        .when(b == top, (r - g) / safe + 4.0)
        .when(g == top, (b - r) / safe + 2.0)
        .otherwise((g - b) / safe + F.when(g < b, F.lit(6.0)).otherwise(F.lit(0.0)))
    )
    return sector * 60.0, sat, light


def is_curve_pixel(light: Column, threshold: float = 0.85) -> Column:
    return (light > 0.1) & (light < threshold)


def is_interior(x: Column, y: Column, width: Column | int, height: Column | int, margin: int = 30) -> Column:
    w, h = (v if isinstance(v, Column) else F.lit(v) for v in (width, height))
    return (x >= margin) & (x < w - margin) & (y >= margin) & (y < h - margin)


def is_dark(r: Column, g: Column, b: Column, threshold: float = 0.5) -> Column:
    return (r + g + b) / 3.0 / 255.0 < threshold


#: Upper end of the hue of each name.
HUES = ((15, "red"), (45, "orange"), (75, "yellow"), (165, "green"), (255, "blue"), (285, "purple"), (345, "pink"), (361, "red"))


def color_name(h: Column, s: Column, l: Column) -> Column:  # noqa: E741
    out = F.when(l < 0.2, "black").when(l > 0.9, "white").when(s < 0.1, "gray")
    for end, name in HUES:
        out = out.when(h < end, name)
    return out


def hex_color(r: Column, g: Column, b: Column) -> Column:
    two = lambda c: F.lpad(F.lower(F.hex(c.cast("int"))), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


# ------------------------------------------------------------ text


def style_key(stroke: Column, dash: Column, width: Column) -> Column:
    """``stroke|dash|width``; a line without a dash pattern is solid."""
    plain = dash.isNull() | dash.isin("", "none")
    pattern = F.when(plain, F.lit("solid")).otherwise(F.regexp_replace(dash, "[^0-9.]+", "-"))
    thick = F.coalesce(F.regexp_replace(width.cast("string"), r"\.0$", ""), F.lit("NA"))
    return F.concat_ws("|", F.lower(F.coalesce(F.nullif(stroke, F.lit("")), F.lit("none"))), pattern, thick)


#: A number that touches no letter or digit; in a range like 0-60 both ends are.
_NUMBER = r"(?U)(?<!\w)[0-9]+\.?[0-9]*(?!\w)"
_PLAIN = r"(?<![0-9.A-Za-z-])[0-9]+(?:\.[0-9]+)?(?![0-9.A-Za-z%])"
_PERCENT = r"([0-9]+(?:\.[0-9]+)?)\s*%"
_SCIENTIFIC = r"([0-9]+\.?[0-9]*[eE][-+]?[0-9]+)"


def extract_numbers(text: Column, axis: str, x_top: float = 400.0) -> Column:
    """Distinct sorted numbers of an axis text: plain ones, ranges, scientific ones, and on y percents divided by 100."""
    find = lambda p, i: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(i)), lambda x: x.try_cast("double"))
    low, high = (0.0, 1.1) if axis == "y" else (0.0, x_top)
    every = F.concat(find(_NUMBER, 0), find(_SCIENTIFIC, 1))
    if axis == "y":
        every = F.concat(every, F.transform(find(_PERCENT, 1), lambda x: x / 100.0))
    return F.array_sort(F.array_distinct(F.filter(every, lambda v: v.isNotNull() & v.between(low, high))))


def extract_numbers_patterns(text: Column, axis: str) -> Column:
    """As above with number-unit pairs and ranges; percents always divided, y values divided when the largest is over 10."""
    find = lambda p, i: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(i)), lambda x: x.try_cast("double"))
    plain = find(_PLAIN, 0)
    united = find(r"([0-9]+(?:\.[0-9]+)?)\s*(?:months?|years?|days?|weeks?|mo|yr)\b", 1)
    left, right = find(r"([0-9]+(?:\.[0-9]+)?)\s*-\s*[0-9]", 1), find(r"[0-9]\s*-\s*([0-9]+(?:\.[0-9]+)?)", 1)
    percent = F.transform(find(_PERCENT, 1), lambda x: x / 100.0)
    every = F.filter(F.concat(plain, united, left, right, percent), lambda v: v.isNotNull())
    if axis == "y":
        every = F.transform(every, lambda v: F.when(F.array_max(every) > 10, F.when(v > 1, v / 100.0).otherwise(v)).otherwise(v))
    return F.array_sort(F.array_distinct(every))


def word_number(text: Column) -> Column:
    """A word as a number: percent sign off, else its first signed number."""
    bare = F.regexp_replace(F.trim(text), "%", "")
    return F.coalesce(bare.try_cast("double"), F.regexp_extract(bare, r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"))


def parse_number(text: Column) -> Column:
    """First number in free text; commas may group thousands."""
    return F.regexp_replace(F.regexp_extract(text, r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").try_cast("double")


def is_number(text: Column) -> Column:
    return text.try_cast("double").isNotNull()


#: What each variant looks for, in order; the last entry is the default.
UNIT_WORDS = {
    ("text", "x"): [("year", "years"), ("month", "months"), ("week", "weeks"), ("day", "days"), ("", "months")],
    ("text", "y"): [("%", "percent"), ("percent", "percent"), ("proportion", "proportion"), ("risk", "risk"), ("", "probability")],
    ("ocr", "x"): [("month", "months"), ("year", "years"), ("day", "days"), ("week", "weeks"), ("", "months")],
    ("ocr", "y"): [("%", "percentage"), ("percent", "percentage"), ("", "probability")],
    ("ocr2", "x"): [("year", "years"), ("yr", "years"), ("month", "months"), (" m", "months"), ("day", "days"), (" d", "days"), ("", "months")],
    ("ocr2", "y"): [("%", "percentage"), ("percent", "percentage"), ("", "probability")],
}


def detect_unit(text: Column, axis: str, variant: str = "text") -> Column:
    """Unit named in an axis text; variants differ in the words and their order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for word, unit in reversed(UNIT_WORDS[variant, axis]):
        out = F.lit(unit) if out is None else F.when(F.contains(low, F.lit(word)), unit).otherwise(out)
    return out


def text_confidence(text: Column, odd_share: float | None = 0.5) -> Column:
    """0.5, more for digits, units of time and marks of a scale, less for very short texts; 0 to 1.

    Less too where more than ``odd_share`` of the characters are neither letters,
    digits nor blanks; None asks for no such deduction.
    """
    filled = F.coalesce(text, F.lit(""))
    odd = F.char_length(F.regexp_replace(filled, r"[\p{L}\p{N} ]", "")) / F.greatest(F.char_length(filled), F.lit(1))
    add = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0.0))
    score = (
        F.lit(0.5)
        + add(filled.rlike("[0-9]"), 0.2)
        + add(F.lower(filled).rlike("month|year|day|week|time"), 0.15)
        + add(filled.rlike(r"%|0\.|1\.0"), 0.15)
        + add(F.char_length(filled) < 3, -0.2)
        + (F.lit(0.0) if odd_share is None else add(odd > odd_share, -0.2))
    )
    return F.when(filled == "", F.lit(0.0)).otherwise(clip(score, F.lit(0.0), F.lit(1.0)))


def sanitize_basename(name: Column) -> Column:
    base = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[A-Za-z0-9]{1,5}$", "")
    return F.regexp_replace(base, "[^A-Za-z0-9_-]+", "_")


def squish(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def first_filled(*texts: Column) -> Column:
    """The first text that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(t), F.lit("")) for t in texts])


def parse_transform(matrix: Column) -> list[Column]:
    """a..f of ``matrix(a b c d e f)``; the identity if it cannot be read."""
    n = F.regexp_extract_all(F.coalesce(F.regexp_extract(matrix, r"matrix\(([^)]*)\)", 1), F.lit("")), F.lit(r"(-?[0-9.]+(?:e-?[0-9]+)?)"), F.lit(1))
    unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    return [F.when(F.size(n) == 6, F.get(n, F.lit(i)).try_cast("double")).otherwise(F.lit(v)) for i, v in enumerate(unit)]


def affine_transform(x: Column, y: Column, matrix: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = parse_transform(matrix)
    return a * x + c * y + e, b * x + d * y + f


def line_length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def line_midpoint(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2.0, (y1 + y2) / 2.0


def calibration_method(reason: Column) -> Column:
    low = F.lower(reason)
    return F.when(low.contains("hough"), "hough_v2").when(low.contains("fallback"), "fallback").otherwise("other")


#: Terms that mark a paper on survival.
SURVIVAL_TERMS = ("kaplan-meier", "kaplan meier", "survival", "oncology", "cancer", "tumor", "tumour", "prognosis", "time-to-event")


def keyword_filter(title: Column, abstract: Column, terms: tuple[str, ...] = SURVIVAL_TERMS) -> Column:
    text = F.lower(F.concat_ws(" ", title, abstract))
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def figure_type(text: Column, direction: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.contains("cumulative incidence"), "CIF")
        .when(low.rlike("restricted mean|rmst"), "RMST")
        .when(low.contains("hazard ratio"), "HR")
        .when(direction == "increasing", "CIF")
        .otherwise("KM")
    )
