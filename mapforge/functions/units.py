"""Units of detectors and maps: one factor for each change, from detector areas and the pixel's area."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Square arcseconds in a square degree.
ARCSEC2 = 3600.0**2
KNOWN = ("Jy", "V", "ADU")


def parse(unit: str) -> tuple[str, str | None]:
    """'Jy / detector' -> ('Jy', 'detector'); names are checked, blanks don't matter."""
    head, _, tail = unit.replace(" ", "").partition("/")
    if tail and tail not in ("detector", "detector_reference", "pixel", "arcsec^2"):
        raise ValueError(f"unknown unit {unit!r}")
    return head, tail or None


def factor(source: str, target: str, detector_area: Column, reference_area: float, pixel_area: float) -> Column:
    """What a value in source is multiplied with to be in target; areas are in arcsec^2."""
    (a, p), (b, q) = parse(source), parse(target)
    if a != b:
        raise ValueError(f"{source!r} and {target!r} measure different things")
    areas = {"detector": detector_area, "detector_reference": F.lit(reference_area), "pixel": F.lit(pixel_area), "arcsec^2": F.lit(1.0)}
    if (p is None) != (q is None):
        raise ValueError(f"{source!r} and {target!r} measure different things")
    return F.lit(1.0) if p == q else areas[q] / areas[p]


def to_adu(value: Column, gain: float, offset: float = 0.0, low: float = 0.0, high: float = 65535.0) -> Column:
    """Digital counts: the value over the gain and the offset, rounded half away from zero and clipped."""
    x = value / F.lit(gain) + F.lit(offset)
    return F.least(F.lit(high), F.greatest(F.lit(low), F.signum(x) * F.floor(F.abs(x) + 0.5)))


def to_volt(value: Column, responsivity: float, active_fraction: float = 1.0) -> Column:
    return value * F.lit(responsivity / active_fraction)
