"""Astrometry: a header's linear part and the tangent-plane projection, as columns."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_numbered(naxis: tuple[int, int]) -> None:
    """Pixels are numbered by 32-bit integers: a map whose pixels are to be numbered can't be larger, though a header can."""
    if naxis[0] * naxis[1] > 2**31 - 1:
        raise ValueError("a map has 2**31 - 1 pixels at most")


@dataclass(frozen=True)
class Wcs:
    """naxis, crpix, crval and cd are (x, y); pixel centres lie at integers, the first at 1."""

    naxis: tuple[int, int]
    crpix: tuple[float, float]
    crval: tuple[float, float]
    cd: tuple[tuple[float, float], tuple[float, float]]
    ctype: tuple[str, str] = ("RA---TAN", "DEC--TAN")
    cunit: tuple[str, str] = ("deg", "deg")

    @classmethod
    def from_header(cls, header: Mapping[str, object]) -> Wcs:
        """CD matrix, or CDELT with CROTA2; all four CD keys or none. Only RA---TAN, DEC--TAN."""
        keys = ["CD1_1", "CD1_2", "CD2_1", "CD2_2"]
        have = [k for k in keys if k in header]
        if have and len(have) < 4:
            raise ValueError("the CD matrix is not complete")
        if have:
            a, b, c, d = (float(header[k]) for k in keys)
        elif "CDELT1" in header and "CDELT2" in header:
            s, t, r = float(header["CDELT1"]), float(header["CDELT2"]), math.radians(float(header.get("CROTA2", 0.0)))
            a, b, c, d = s * math.cos(r), -t * math.sin(r), s * math.sin(r), t * math.cos(r)
        else:
            raise ValueError("neither a CD matrix nor CDELT keys")
        if a * d - b * c == 0:
            raise ValueError("the CD matrix has no inverse")
        types = (str(header.get("CTYPE1", "RA---TAN")).strip(), str(header.get("CTYPE2", "DEC--TAN")).strip())
        if types != ("RA---TAN", "DEC--TAN"):
            raise ValueError(f"projection {types} is not supported")
        return cls(
            (int(header["NAXIS1"]), int(header["NAXIS2"])), (float(header["CRPIX1"]), float(header["CRPIX2"])), (float(header["CRVAL1"]), float(header["CRVAL2"])), ((a, b), (c, d)), types,
            (str(header.get("CUNIT1", "deg")).strip(), str(header.get("CUNIT2", "deg")).strip()),
        )

    def to_header(self) -> dict[str, object]:
        (a, b), (c, d) = self.cd
        return {
            "NAXIS": 2, "NAXIS1": self.naxis[0], "NAXIS2": self.naxis[1], "CRPIX1": self.crpix[0], "CRPIX2": self.crpix[1], "CRVAL1": self.crval[0], "CRVAL2": self.crval[1],
            "CD1_1": a, "CD1_2": b, "CD2_1": c, "CD2_2": d, "CTYPE1": self.ctype[0], "CTYPE2": self.ctype[1], "CUNIT1": self.cunit[0], "CUNIT2": self.cunit[1],
        }

    @classmethod
    def square(cls, center: tuple[float, float], step: float, naxis: tuple[int, int], angle: float = 0.0) -> Wcs:
        """Square pixels of `step` degrees around a centre; right ascension grows to the left."""
        check_numbered(naxis)
        r = math.radians(angle)
        cd = ((-step * math.cos(r), -step * math.sin(r)), (-step * math.sin(r), step * math.cos(r)))
        return cls(naxis, ((naxis[0] + 1) / 2, (naxis[1] + 1) / 2), center, cd)

    def resized(self, naxis: tuple[int, int], shift: tuple[float, float]) -> Wcs:
        """The header of a map of any size with its first pixel elsewhere."""
        return replace(self, naxis=naxis, crpix=(self.crpix[0] + shift[0], self.crpix[1] + shift[1]))

    def inverse(self) -> tuple[tuple[float, float], tuple[float, float]]:
        (a, b), (c, d) = self.cd
        det = a * d - b * c
        return ((d / det, -b / det), (-c / det, a / det))


def tangent(wcs: Wcs, ra: Column, dec: Column) -> tuple[Column, Column]:
    """Coordinates in the tangent plane, in degrees."""
    a0, d0 = math.radians(wcs.crval[0]), math.radians(wcs.crval[1])
    a, d = F.radians(ra) - a0, F.radians(dec)
    cosc = F.sin(d) * math.sin(d0) + F.cos(d) * math.cos(d0) * F.cos(a)
    k = 180.0 / math.pi
    return k * F.cos(d) * F.sin(a) / cosc, k * (F.sin(d) * math.cos(d0) - F.cos(d) * math.sin(d0) * F.cos(a)) / cosc


def sky_to_pixel(wcs: Wcs, ra: Column, dec: Column) -> tuple[Column, Column]:
    """1-based pixel coordinates of a position."""
    u, v = tangent(wcs, ra, dec)
    (a, b), (c, d) = wcs.inverse()
    return a * u + b * v + wcs.crpix[0], c * u + d * v + wcs.crpix[1]


def pixel_to_sky(wcs: Wcs, x: Column, y: Column) -> tuple[Column, Column]:
    (a, b), (c, d) = wcs.cd
    p, q = x - wcs.crpix[0], y - wcs.crpix[1]
    u, v = F.radians(a * p + b * q), F.radians(c * p + d * q)
    a0, d0 = math.radians(wcs.crval[0]), math.radians(wcs.crval[1])
    ra = a0 + F.atan2(u, math.cos(d0) - v * math.sin(d0))
    dec = F.atan2((math.sin(d0) + v * math.cos(d0)), F.sqrt((math.cos(d0) - v * math.sin(d0)) * (math.cos(d0) - v * math.sin(d0)) + u * u))
    lon = F.degrees(ra)
    return lon - 360.0 * F.floor(lon / 360.0), F.degrees(dec)


def pixel_index(wcs: Wcs, x: Column, y: Column) -> Column:
    """0-based index of the pixel that holds a position, halves going up; -1 outside the map."""
    check_numbered(wcs.naxis)
    i, j = F.floor(x + 0.5), F.floor(y + 0.5)
    inside = (i >= 1) & (i <= wcs.naxis[0]) & (j >= 1) & (j <= wcs.naxis[1])
    return F.when(inside, i - 1 + (j - 1) * wcs.naxis[0]).otherwise(-1).cast("int")


def projection_scale(wcs: Wcs, x: Column, y: Column) -> Column:
    """Solid angle of a pixel relative to the one at the reference: cos^3 of its distance from the tangent point."""
    step = math.hypot(wcs.cd[0][0], wcs.cd[1][0])
    other = math.hypot(wcs.cd[0][1], wcs.cd[1][1])
    if abs(step - other) > 1e-7 * step:
        raise ValueError("the scale needs square pixels")
    t = math.tan(math.radians(step))
    d = F.sqrt((x - wcs.crpix[0]) * (x - wcs.crpix[0]) + (y - wcs.crpix[1]) * (y - wcs.crpix[1]))
    c = F.cos(F.atan(d * t))
    return c * c * c
