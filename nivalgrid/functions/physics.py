"""Snow and energy expressions on single rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class boundaries and labels.
FULL_COVER_TOLERANCE = 1.0e-6
COVER_BIN_LABELS = ("cover = 1", "0.9 <= cover < 1", "0.5 <= cover < 0.9",
                    "0.1 <= cover < 0.5", "0 < cover < 0.1")
ELEVATION_BANDS = {"Lower": (None, 2896.0), "Middle": (2896.0, 3353.0),
                   "Upper": (3353.0, None), "All": (None, None)}


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def finite(value) -> Column:
    """NaN and infinities become NULL."""
    v = _c(value).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None).cast("double")).otherwise(v)


def safe_ratio(num, den) -> Column:
    return F.try_divide(_c(num), _c(den))


def wind_speed(u, v) -> Column:
    return F.hypot(_c(u), _c(v))


def effective_albedo(incoming, absorbed, minimum_incoming: float = 0.05) -> Column:
    """``1 - absorbed/incoming`` where the incoming energy exceeds the minimum."""
    e, a = _c(incoming), _c(absorbed)
    return F.when(e > F.lit(float(minimum_incoming)), 1.0 - F.try_divide(a, e))


def bulk_density(swe_mm, depth_mm, minimum_swe: float | None = None,
                 minimum_depth: float | None = None) -> Column:
    """kg/m3; valid for positive depth and, when given, above the minimum SWE / depth."""
    swe, depth = _c(swe_mm), _c(depth_mm)
    valid = depth > 0
    if minimum_swe is not None:
        valid = valid & (swe >= F.lit(float(minimum_swe)))
    if minimum_depth is not None:
        valid = valid & (depth >= F.lit(float(minimum_depth)))
    return F.when(valid, 1000.0 * F.try_divide(swe, depth))


def clip01(value) -> Column:
    v = _c(value)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def outside_unit_range(value, tolerance: float = FULL_COVER_TOLERANCE) -> Column:
    v = _c(value)
    return (v < F.lit(-tolerance)) | (v > F.lit(1.0 + tolerance))


def unit_range_qc(value, tolerance: float = FULL_COVER_TOLERANCE, strict: bool = False) -> Column:
    """Clip round-off to [0, 1]; larger excursions are masked, or an error when strict."""
    v = _c(value)
    bad = outside_unit_range(v, tolerance)
    if strict:
        wrong = F.raise_error(F.concat(F.lit("value outside [0, 1]: "), v.cast("string"))).cast("double")
    else:
        wrong = F.lit(None).cast("double")
    return F.when(bad, wrong).when(v.isNotNull(), clip01(v))


def cover_bin5(cover) -> Column:
    """Five cover classes, 0 = full ... 4 = below 0.1; snow-free and missing give NULL."""
    v = _c(cover)
    return (F.when(F.abs(v - 1.0) <= FULL_COVER_TOLERANCE, 0)
            .when((v >= 0.9) & (v < 1.0), 1)
            .when((v >= 0.5) & (v < 0.9), 2)
            .when((v >= 0.1) & (v < 0.5), 3)
            .when((v > 0.0) & (v < 0.1), 4))


def cover_bin5_label(code) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in COVER_BIN_LABELS]), _c(code) + 1)


def cover_bin10(cover) -> Column:
    """Ten equal bins of [0, 1]; 0 falls in the first bin and 1 in the last."""
    v = clip01(cover)
    return F.when(_c(cover).isNotNull(),
                  F.when(v >= 1.0 - FULL_COVER_TOLERANCE, 9)
                  .otherwise(F.least(F.floor(v * 10.0).cast("int"), F.lit(9))))


def swe_state_classes(swe_mm) -> dict[str, Column]:
    """Mutually exclusive SWE states."""
    v = _c(swe_mm)
    return {"snowfree_le_1mm": v <= 1.0,
            "marginal_1_10mm": (v > 1.0) & (v <= 10.0),
            "shallow_10_25mm": (v > 10.0) & (v <= 25.0),
            "substantial_gt_25mm": v > 25.0}


def cover_state_classes(cover, tolerance: float = FULL_COVER_TOLERANCE) -> dict[str, Column]:
    """Cover states; ``any_partial_gt0_lt1`` overlaps the three partial ones."""
    v = _c(cover)
    lo, hi = F.lit(tolerance), F.lit(1.0 - tolerance)
    return {"snowfree_0": v <= lo,
            "very_low_gt0_0p1": (v > lo) & (v < 0.1),
            "partial_0p1_0p9": (v >= 0.1) & (v < 0.9),
            "nearly_full_0p9_lt1": (v >= 0.9) & (v < hi),
            "full_1": v >= hi,
            "any_partial_gt0_lt1": (v > lo) & (v < hi)}


def band_names(elevation, bands: dict | None = None) -> Column:
    """Array of every band an elevation belongs to (bands may overlap)."""
    z = _c(elevation)
    names = []
    for name, (lo, hi) in (bands or ELEVATION_BANDS).items():
        inside = z.isNotNull()
        if lo is not None:
            inside = inside & (z >= F.lit(float(lo)))
        if hi is not None:
            inside = inside & (z < F.lit(float(hi)))
        names.append(F.when(inside, F.lit(name)))
    return F.array_compact(F.array(*names))


#: Class edges as shares of the rounded maximum.
BREAK_SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)


def nice_breaks(robust_maximum, difference: bool = False) -> Column:
    """Class edges for a map: shares of the maximum after rounding it up to half its leading decimal.

    Maxima below one (or missing) count as one. Differences get the same edges on
    both sides of zero, taken as the sorted distinct signed shares.
    """
    shares = sorted({sign * s for s in BREAK_SHARES for sign in ((1, -1) if difference else (1,))})
    largest = F.greatest(F.coalesce(_c(robust_maximum).cast("double"), F.lit(1.0)), F.lit(1.0))
    half = F.pow(F.lit(10.0), F.floor(F.log10(largest)).cast("double")) / 2.0
    return F.transform(F.array(*[F.lit(s + 0.0) for s in shares]), lambda s: s * (F.ceil(largest / half).cast("double") * half))


def class_code(value, breaks) -> Column:
    """0-based class of a value between increasing breaks, clipped to the outer classes."""
    v, b = _c(value), _c(breaks)
    below = F.size(F.filter(b, lambda edge: edge <= v)) - 1
    return F.when(v.isNotNull(), F.greatest(F.lit(0), F.least(below, F.size(b) - 2)))


def check_breaks(breaks, difference: bool = False) -> list[float]:
    """User-given class edges as floats: three or more, each above the one before, around zero for differences."""
    edges = [float(b) for b in breaks]
    if len(edges) < 3:
        raise ValueError(f"two classes need three edges, got {len(edges)}")
    for low, high in zip(edges, edges[1:]):
        if not low < high:
            raise ValueError(f"edge {high} does not lie above {low}")
    if difference and (edges[0] >= 0 or edges[-1] <= 0):
        raise ValueError(f"edges of a difference must enclose zero, got {edges[0]} to {edges[-1]}")
    return edges
