"""String helpers of configuration and file names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def split_kept(c: Column, by: str) -> Column:
    """Parts between single separators; empty parts are kept."""
    return F.split(c, re.escape(by), -1)


def joined(c: Column, by: str = ", ") -> Column:
    return F.array_join(c, by)


def padded_integer(c: Column, width: int, fill: str = "0") -> Column:
    return F.lpad(c.cast("string"), width, fill)


def section(name: str, total: int) -> tuple[str, int, int]:
    """file[a:b] -> (file, first, last), 1-based and inclusive; [a:], [:b], [a], [:] and [] as well.

    Raises ValueError for numbers that are none, lie outside 1 to total, or go backwards.
    """
    m = re.fullmatch(r"([^\[\]]*)(?:\[([^\[\]]*)\])?", name.strip())
    if not m:
        raise ValueError(f"no valid section: {name!r}")
    file, inside = m[1], (m[2] or "").replace(" ", "")
    low, colon, high = inside.partition(":")
    if not re.fullmatch(r"\d*", low) or not re.fullmatch(r"\d*", high):
        raise ValueError(f"no valid section: {name!r}")
    first = int(low) if low else 1
    last = int(high) if high else (first if low and not colon else total)
    if not (1 <= first <= last <= total):
        raise ValueError(f"section {first}:{last} is not inside 1:{total}")
    return file, first, last
