"""Operators along a timeline: rows of one key (slice, detector), in order of a sample number.

keys, order and value name columns; order is an integer that grows by one from 0 within a key, as number() makes it.
Each operator with an adjoint has it beside it. A timeline is one group: its memory bound is one detector's samples.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from .joins import on_keys


def over(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def number(df: DataFrame, keys: list[str], by: list[str], name: str = "t") -> DataFrame:
    """Numbers a key's rows from 0 in the order of `by`."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1).cast("long"))


def _with(df: DataFrame, value: str, new: Column) -> DataFrame:
    return df.withColumn(value, new)


#: Places of a block, where a vector without keys, such as a map, is taken apart by its order.
BLOCK = 1 << 16


def _beside(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds __before and __after, the values of the rows beside; null at the ends.

    Without keys the vector is one sequence that no task could sort: windows then are blocks of places, and the rows at a
    block's rims take the last and first values of the blocks beside from a table with one row for each block.
    """
    if keys:
        w = over(keys, order)
        return df.withColumn("__before", F.lag(value).over(w)).withColumn("__after", F.lead(value).over(w))
    cut = df.withColumn("__block", F.floor(F.col(order) / BLOCK))
    ends = cut.groupBy("__block").agg(F.min_by(value, order).alias("__first"), F.max_by(value, order).alias("__last"))
    row = Window.orderBy("__block")  # one row for each block
    rims = ends.select(F.col("__block").alias("__of"), F.lag("__last").over(row).alias("__low"), F.lead("__first").over(row).alias("__high"))
    w = Window.partitionBy("__block").orderBy(order)
    near = cut.withColumn("__before", F.lag(value).over(w)).withColumn("__after", F.lead(value).over(w)).join(rims, F.col("__block") == F.col("__of"))
    return near.select(*df.columns, F.coalesce("__before", "__low").alias("__before"), F.coalesce("__after", "__high").alias("__after"))


# Differences


def diff(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """x[i] - x[i + 1]; the last is 0."""
    return _beside(df, keys, order, value).withColumn(value, F.coalesce(F.col(value) - F.col("__after"), F.lit(0.0))).select(*df.columns)


def diff_adjoint(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """First x[0], then x[i] - x[i - 1], last -x[n - 2]; a single value gives 0."""
    before, after, x = F.col("__before"), F.col("__after"), F.col(value)
    out = F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), x).when(after.isNull(), -before).otherwise(x - before)
    return _beside(df, keys, order, value).withColumn(value, out).select(*df.columns)


def diff_normal(df: DataFrame, keys: list[str], order: str, value: str, scalar: float = 1.0) -> DataFrame:
    """diff_adjoint(diff(x)) times scalar in one window: 2 x[i] less its neighbours, with free ends."""
    x = F.col(value)
    out = scalar * (F.coalesce(x - F.col("__before"), F.lit(0.0)) + F.coalesce(x - F.col("__after"), F.lit(0.0)))
    return _beside(df, keys, order, value).withColumn(value, out).select(*df.columns)


# Shift and padding


def shift(df: DataFrame, keys: list[str], order: str, value: str, n: int) -> DataFrame:
    """Moves values n places on; what is moved in is 0 and nothing wraps. The adjoint shifts by -n."""
    w = over(keys, order)
    moved = F.lag(value, n).over(w) if n >= 0 else F.lead(value, -n).over(w)
    return _with(df, value, F.coalesce(moved, F.lit(0.0)))


def shift_by(df: DataFrame, keys: list[str], order: str, value: str, offset: str) -> DataFrame:
    """As shift, with an offset for each key in a column: a self-join on the place that a value comes from."""
    source = df.select(*keys, F.col(order).alias("__o"), F.col(value).alias("__x"))
    joined = on_keys(df, source, keys, "left", F.col(order) - F.col(offset) == F.col("__o"))
    return joined.select(*[F.col(c) if c != value else F.coalesce("__x", F.lit(0.0)).alias(value) for c in df.columns])


def pad(df: DataFrame, keys: list[str], order: str, value: str, left: int = 0, right: int = 0) -> DataFrame:
    """(keys, order, value) with zeros before and behind. The adjoint is trim."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    zeros = sizes.select(*keys, F.explode(F.concat(_numbers(F.lit(0), F.lit(left)), _numbers(F.col("n") + left, F.col("n") + left + right))).alias(order), F.lit(0.0).alias(value))
    return df.select(*keys, (F.col(order) + left).cast("long").alias(order), F.col(value)).union(zeros.select(*keys, F.col(order).cast("long"), value))


def _numbers(start: Column, stop: Column) -> Column:
    start, stop = start.cast("long"), stop.cast("long")
    return F.when(stop > start, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<bigint>"))


def trim(df: DataFrame, keys: list[str], order: str, value: str, left: int = 0, right: int = 0) -> DataFrame:
    """Drops so many values at either end and numbers the rest from 0."""
    n = F.count("*").over(Window.partitionBy(*keys))
    inner = df.withColumn("__n", n).filter((F.col(order) >= left) & (F.col(order) < F.col("__n") - right))
    return inner.withColumn(order, F.col(order) - left).select(*keys, order, value)


# Compression


def check_divides(df: DataFrame, keys: list[str], factor: int) -> None:
    if df.groupBy(*keys).count().filter(F.col("count") % factor != 0).limit(1).count():
        raise ValueError(f"{factor} does not divide the length of every timeline")


def average(df: DataFrame, keys: list[str], order: str, value: str, factor: int | Column) -> DataFrame:
    """Means of successive blocks of `factor` values; factor may be a column that is constant in a key."""
    f = F.lit(factor) if isinstance(factor, int) else factor
    block = F.floor(F.col(order) / f).cast("long")
    return df.groupBy(*keys, block.alias(order)).agg((F.sum(value) / F.first(f)).alias(value))


def average_adjoint(df: DataFrame, keys: list[str], order: str, value: str, factor: int | Column) -> DataFrame:
    """Each value over factor, factor times."""
    f = F.lit(factor) if isinstance(factor, int) else factor
    return df.select(*keys, (F.col(value) / f).alias(value), F.explode(_numbers(F.col(order) * f, (F.col(order) + 1) * f)).alias(order)).select(*keys, order, value)


def downsample(df: DataFrame, keys: list[str], order: str, value: str, factor: int | Column) -> DataFrame:
    """The first value of each block."""
    f = F.lit(factor) if isinstance(factor, int) else factor
    return df.filter(F.col(order) % f == 0).select(*keys, F.floor(F.col(order) / f).cast("long").alias(order), value)


def downsample_adjoint(df: DataFrame, keys: list[str], order: str, value: str, factor: int | Column) -> DataFrame:
    """Each value, followed by factor - 1 zeros."""
    f = F.lit(factor) if isinstance(factor, int) else factor
    spread = df.select(*keys, F.col(value), (F.col(order) * f).alias("__first"), F.explode(_numbers(F.col(order) * f, (F.col(order) + 1) * f)).alias(order))
    return spread.select(*keys, order, F.when(F.col(order) == F.col("__first"), F.col(value)).otherwise(0.0).alias(value))


# Packing


def pack(df: DataFrame, keys: list[str], order: str, value: str, mask: str) -> DataFrame:
    """Drops masked values and numbers the rest from 0."""
    kept = df.filter(~F.col(mask))
    return number(kept, keys, [order], "__t").select(*keys, F.col("__t").alias(order), value)


def unpack(packed: DataFrame, full: DataFrame, keys: list[str], order: str, value: str, mask: str) -> DataFrame:
    """Packed values at the unmasked places of `full` (keys, order, mask), 0 at the masked ones; the adjoint of pack."""
    placed = full.select(*keys, order, mask).withColumn("__p", F.sum(F.when(F.col(mask), 0).otherwise(1)).over(over(keys, order)) - 1)
    p = packed.select(*keys, F.col(order).alias("__q"), value)
    joined = on_keys(placed, p, keys, "left", (F.col("__p") == F.col("__q")) & ~F.col(mask))
    return joined.select(*keys, order, F.coalesce(value, F.lit(0.0)).alias(value))


# Interpolation


def _neighbours(df: DataFrame, keys: list[str], order: str, value: str, good: Column) -> DataFrame:
    w = over(keys, order)
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(good, F.struct(F.col(order).cast("double").alias("t"), F.col(value).alias("v")))
    return df.withColumn("__at", at).withColumn("__l", F.last("__at", ignorenulls=True).over(back)).withColumn("__r", F.first("__at", ignorenulls=True).over(on))


def interpolate_clamped(df: DataFrame, keys: list[str], order: str, value: str, mask: str) -> DataFrame:
    """Masked values by straight lines between unmasked neighbours; the nearest unmasked value at the ends. All masked: unchanged."""
    n = _neighbours(df, keys, order, value, ~F.col(mask))
    l, r, t = F.col("__l"), F.col("__r"), F.col(order)
    line = l["v"] + (r["v"] - l["v"]) * (t - l["t"]) / (r["t"] - l["t"])
    filled = F.when(~F.col(mask), F.col(value)).when(l.isNotNull() & r.isNotNull(), line).otherwise(F.coalesce(l["v"], r["v"], F.col(value)))
    return n.withColumn(value, filled).drop("__at", "__l", "__r")


def interpolate_extrapolated(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """NaN runs by straight lines, which go on beyond the first and last two values. One value only: it holds throughout; none: unchanged."""
    n = _neighbours(df, keys, order, value, ~F.isnan(value))
    whole = Window.partitionBy(*keys)
    w = over(keys, order)
    known = F.sum(F.when(~F.isnan(value), 1).otherwise(0)).over(w)
    total = F.sum(F.when(~F.isnan(value), 1).otherwise(0)).over(whole)
    n = n.withColumn("__k", known).withColumn("__n", total)
    pick = lambda i: F.max(F.when((F.col("__k") == i) & F.col("__at").isNotNull(), F.col("__at"))).over(whole)
    n = n.withColumn("__a", pick(F.lit(1))).withColumn("__b", pick(F.lit(2))).withColumn("__c", pick(F.col("__n") - 1)).withColumn("__d", pick(F.col("__n")))
    t = F.col(order)

    def line(p: Column, q: Column) -> Column:
        return p["v"] + (q["v"] - p["v"]) * (t - p["t"]) / (q["t"] - p["t"])

    l, r = F.col("__l"), F.col("__r")
    inner = F.when(l.isNotNull() & r.isNotNull(), line(l, r))
    ends = F.when(F.col("__n") == 1, F.coalesce(l["v"], r["v"])).when(l.isNull() & r.isNotNull(), line(F.col("__a"), F.col("__b"))).when(r.isNull() & l.isNotNull(), line(F.col("__c"), F.col("__d")))
    out = F.when(~F.isnan(value), F.col(value)).otherwise(F.coalesce(inner, ends, F.col(value)))
    return n.withColumn(value, out).select(*df.columns)


# Mean, polynomial and median filters


def subtract_mean(df: DataFrame, keys: list[str], value: str, mask: str | None = None) -> DataFrame:
    """Less the mean of a key's unmasked values; without any, unchanged."""
    v = F.when(~F.col(mask), F.col(value)) if mask else F.col(value)
    return _with(df, value, F.col(value) - F.coalesce(F.avg(v).over(Window.partitionBy(*keys)), F.lit(0.0)))


def filter_line(df: DataFrame, keys: list[str], order: str, value: str, mask: str | None = None) -> DataFrame:
    """Less the least-squares line through the unmasked values; a key with all masked stays as it is."""
    w = Window.partitionBy(*keys)
    good = ~F.col(mask) if mask else F.lit(True)
    x, y = F.when(good, F.col(order).cast("double")), F.when(good, F.col(value))
    n, mx, my = F.count(y).over(w), F.avg(x).over(w), F.avg(y).over(w)
    centred = df.withColumn("__n", n).withColumn("__mx", mx).withColumn("__my", my)
    dx = F.when(good, F.col(order) - F.col("__mx"))
    dy = F.when(good, F.col(value) - F.col("__my"))
    fitted = centred.withColumn("__xy", F.sum(dx * dy).over(w)).withColumn("__xx", F.sum(dx * dx).over(w))
    slope = F.when(F.col("__xx") > 0, F.col("__xy") / F.col("__xx")).otherwise(0.0)
    out = F.when(F.col("__n") > 0, F.col(value) - F.col("__my") - slope * (F.col(order) - F.col("__mx"))).otherwise(F.col(value))
    return fitted.withColumn(value, out).select(*df.columns)


def filter_median_window(df: DataFrame, keys: list[str], order: str, value: str, length: int, mask: str | None = None) -> DataFrame:
    """Less the lower median of the window [i - (length - 1) // 2, i + length // 2], for short windows, in DataFrame operations.

    NaN and masked values are not in windows. A window without values takes the straight line between the medians
    beside it; a timeline of at most `length` values loses its overall median; one without values becomes 0.
    """
    good = ~F.isnan(value) & (~F.col(mask) if mask else F.lit(True))
    frame = over(keys, order).rowsBetween(-((length - 1) // 2), length // 2)
    held = F.sort_array(F.collect_list(F.when(good, F.col(value))).over(frame))
    middle = lambda c: F.get(c, F.floor((F.size(c) - 1) / 2).cast("int"))
    n = df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    n = n.withColumn("__w", held).withColumn("__m", F.coalesce(middle(F.col("__w")), F.lit(float("nan")))).drop("__w")
    whole = F.sort_array(F.collect_list(F.when(good & (F.col("__n") <= length), F.col(value))).over(Window.partitionBy(*keys)))
    n = n.withColumn("__all", middle(whole))
    filled = interpolate_extrapolated(n, keys, order, "__m")
    base = F.when(F.col("__n") <= length, F.col("__all")).otherwise(F.col("__m"))
    return filled.withColumn(value, F.when(base.isNull() | F.isnan(base), 0.0).otherwise(F.col(value) - base)).select(*df.columns)


def by_timeline(df: DataFrame, keys: list[str], order: str, columns: dict[str, str], fn) -> DataFrame:
    """Calls fn(columns as numpy arrays in order) -> dict of new arrays, once for each key; other columns go along."""
    schema = StructType([f for f in df.schema if f.name not in columns] + [StructField(n, DataType.fromDDL(t)) for n, t in columns.items()])

    def run(table):
        table = table.sort_by(order)
        new = fn({c: table.column(c).to_numpy(zero_copy_only=False) for c in table.column_names})
        keep = [c for c in table.column_names if c not in columns]
        return pa.table([*(table.column(c) for c in keep), *(pa.array(new[n]) for n in columns)], [*keep, *columns])

    return df.groupBy(*keys).applyInArrow(run, schema).select(*df.columns, *[c for c in columns if c not in df.columns])


#: Longest window whose values are laid side by side for numpy; a sorted list follows longer ones. Both give the same medians.
SIDE_BY_SIDE = 64


def sliding_lower_median(x: np.ndarray, good: np.ndarray, length: int) -> np.ndarray:
    """Lower medians of the windows of one timeline, NaN where a window is empty."""
    n, before, after = len(x), (length - 1) // 2, length // 2
    if length <= SIDE_BY_SIDE:
        padded = np.concatenate([np.full(before, np.inf), np.where(good, x, np.inf), np.full(after, np.inf)])
        sizes = np.convolve(np.concatenate([np.zeros(before, int), good.astype(int), np.zeros(after, int)]), np.ones(length, int), "valid")
        out, windows = np.empty(n), np.lib.stride_tricks.sliding_window_view(padded, length)
        for at in range(0, n, 1 << 15):
            held, size = np.sort(windows[at : at + (1 << 15)], axis=1), sizes[at : at + (1 << 15)]
            out[at : at + len(held)] = np.where(size > 0, held[np.arange(len(held)), np.maximum(size - 1, 0) // 2], np.nan)
        return out
    out, held, values, ok = np.full(n, np.nan), [], x.tolist(), good.tolist()
    for i in range(-after, n):
        j, k = i + after, i - before - 1
        if j < n and ok[j]:
            bisect.insort(held, values[j])
        if k >= 0 and ok[k]:
            del held[bisect.bisect_left(held, values[k])]
        if i >= 0 and held:
            out[i] = held[(len(held) - 1) // 2]
    return out


def filter_median(df: DataFrame, keys: list[str], order: str, value: str, length: int = 10, mask: str | None = None) -> DataFrame:
    """As filter_median_window, for windows of any length: one pass over each timeline with a sorted window."""

    def fn(c):
        x = c[value].astype(float)
        good = ~np.isnan(x) & (~c[mask].astype(bool) if mask else True)
        if not good.any():
            return {value: np.zeros(len(x))}
        if len(x) <= length:
            held = np.sort(x[good])
            return {value: x - held[(len(held) - 1) // 2]}
        med = sliding_lower_median(x, good, length)
        known = np.flatnonzero(~np.isnan(med))
        if len(known) == 1:
            med[:] = med[known[0]]
        else:
            t = np.arange(len(x))
            filled = np.interp(t, known, med[known])
            for edge, (p, q) in ((t < known[0], known[:2]), (t > known[-1], known[-2:])):
                filled[edge] = med[p] + (med[q] - med[p]) * (t[edge] - p) / (q - p)
            med = filled
        return {value: x - med}

    return by_timeline(df, keys, order, {value: "double"}, fn)


def filter_polynomial(df: DataFrame, keys: list[str], order: str, value: str, degree: int, mask: str | None = None) -> DataFrame:
    """Less the least-squares polynomial through the unmasked values; all masked: unchanged."""

    def fn(c):
        x = c[value].astype(float)
        good = ~c[mask].astype(bool) if mask else np.ones(len(x), bool)
        if not good.any():
            return {value: x}
        t = np.linspace(-1, 1, len(x)) if len(x) > 1 else np.zeros(1)
        base = np.polynomial.legendre.legvander(t, min(degree, max(int(good.sum()) - 1, 0)))
        coef, *_ = np.linalg.lstsq(base[good], x[good], rcond=None)
        return {value: x - base @ coef}

    return by_timeline(df, keys, order, {value: "double"}, fn)


# Responses and noise


def _decay(tau: float) -> float:
    return float(np.exp(-1.0 / tau))


def decaying_sum(x: np.ndarray, w: float) -> np.ndarray:
    """y[i] = w y[i - 1] + x[i], in log2(n) passes that each double the terms; from a value that isn't finite on, no sum is."""
    fine = np.isfinite(x)
    y, s = np.where(fine, x, 0.0), 1
    while s < len(y) and w**s > 0:
        y[s:] += w**s * y[:-s]
        s *= 2
    return y if fine.all() else y + np.cumsum(np.where(fine, 0.0, x))


def exponential(x: np.ndarray, tau: float) -> np.ndarray:
    """y[0] = x[0], y[i] = w y[i - 1] + (1 - w) x[i] with w = exp(-1 / tau); zeros for tau <= 0 or NaN."""
    if not tau > 0:
        return np.zeros(len(x))
    w = _decay(tau)
    return decaying_sum(np.concatenate([x[:1], (1 - w) * x[1:]]), w)


def exponential_adjoint(y: np.ndarray, tau: float) -> np.ndarray:
    if not tau > 0:
        return np.zeros(len(y))
    w = _decay(tau)
    out = decaying_sum(y[::-1], w)[::-1].copy()
    out[1:] *= 1 - w
    return out


def exponential_response(df: DataFrame, keys: list[str], order: str, value: str, tau: float | str, adjoint: bool = False) -> DataFrame:
    """A detector's response to its signal; tau is a number of samples or a column that is constant in a key."""
    kernel = exponential_adjoint if adjoint else exponential

    def fn(c):
        t = c[tau][0] if isinstance(tau, str) else tau
        return {value: kernel(c[value].astype(float), float("nan") if t is None else float(t))}

    return by_timeline(df, keys, order, {value: "double"}, fn)


def half_complex(x: np.ndarray) -> np.ndarray:
    """Real parts r0 ... r(n/2), then imaginary parts i((n-1)/2) ... i1."""
    f = np.fft.rfft(x)
    return np.concatenate([f.real, f.imag[1 : (len(x) + 1) // 2][::-1]])


def from_half_complex(h: np.ndarray) -> np.ndarray:
    n = len(h)
    f = h[: n // 2 + 1].astype(complex)
    m = (n - 1) // 2
    if m:
        f[1 : m + 1] += 1j * h[n - m :][::-1]
    return np.fft.irfft(f, n)


def fft_half_complex(df: DataFrame, keys: list[str], order: str, value: str, inverse: bool = False) -> DataFrame:
    """Fourier transform in half-complex layout; the inverse (which divides by the length) stands for the adjoint."""
    return by_timeline(df, keys, order, {value: "double"}, lambda c: {value: (from_half_complex if inverse else half_complex)(c[value].astype(float))})


def noise_spectrum(coef: np.ndarray, n: int) -> np.ndarray:
    """Fourier coefficients of the symmetric filter for timelines of n samples, negative ones set to 0."""
    size = 1 << int(np.ceil(np.log2(max(n + 2 * (len(coef) - 1), 1))))
    kernel = np.zeros(size)
    kernel[: len(coef)] = coef
    if len(coef) > 1:
        kernel[-(len(coef) - 1) :] = coef[:0:-1]
    return np.maximum(np.fft.rfft(kernel).real, 0.0)


def inverse_noise(df: DataFrame, filters: DataFrame, keys: list[str], order: str, value: str, root: bool = False) -> DataFrame:
    """The inverse noise correlation N^-1 (or its square root): each timeline times its filter in Fourier space.

    filters has keys and coef, an array of autocorrelation coefficients, one row for each detector (a bounded table).
    All spectra are divided by the largest value among all of them, which is one aggregate.
    """
    sized = df.groupBy(*keys).agg(F.count("*").alias("__n")).join(filters, keys)

    def top(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(noise_spectrum(np.asarray(c.as_py(), float), n.as_py()).max()) for c, n in zip(b.column("coef"), b.column("__n"))], pa.float64())], ["m"])

    most = sized.select("coef", "__n").mapInArrow(top, "m double").agg(F.max("m")).first()[0] or 1.0

    def fn(c):
        x = c[value].astype(float)
        s = noise_spectrum(np.asarray(c["coef"][0], float), len(x)) / most
        size = 2 * (len(s) - 1) if len(s) > 1 else 1
        y = np.zeros(size)
        y[: len(x)] = x
        return {value: np.fft.irfft(np.fft.rfft(y) * (np.sqrt(s) if root else s), size)[: len(x)]}

    return by_timeline(df.join(filters, keys), keys, order, {value: "double"}, fn).select(*df.columns)


def multiplexing(df: DataFrame, keys: list[str], order: str, value: str, column: str, factor: int, columns: int = 16) -> DataFrame:
    """Readout of detector column j at j / columns of each frame of `factor` fine samples, by straight lines between these."""
    place = F.col(column) % columns * F.lit(factor / columns)
    low = F.floor(place)
    part = place - low
    nxt = F.coalesce(F.lead(value).over(over(keys, order)), F.col(value))
    read = df.withColumn("__next", nxt).filter(F.col(order) % factor == low)
    return read.select(*keys, F.floor(F.col(order) / factor).cast("long").alias(order), (F.col(value) * (1 - part) + F.col("__next") * part).alias(value))


def multiplexing_adjoint(df: DataFrame, keys: list[str], order: str, value: str, column: str, factor: int, samples: int, columns: int = 16) -> DataFrame:
    """The true adjoint: each readout goes to the two fine samples it came from; `samples` is the number of fine samples."""
    place = F.col(column) % columns * F.lit(factor / columns)
    low = F.floor(place)
    part = place - low
    first = F.col(order) * factor + low
    last = F.lit(samples - 1)
    pairs = F.array(F.struct(first.cast("long").alias("t"), (F.col(value) * (1 - part)).alias("v")), F.struct(F.least(first + 1, last).cast("long").alias("t"), (F.col(value) * part).alias("v")))
    back = df.select(*keys, F.explode(pairs).alias("p")).groupBy(*keys, F.col("p.t").alias(order)).agg(F.sum("p.v").alias(value))
    every = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))).alias(order))
    return every.join(back, [*keys, order], "left").select(*keys, order, F.coalesce(value, F.lit(0.0)).alias(value))
