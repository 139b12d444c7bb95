"""Lazy linear operators: a tree that is simplified when it is built and becomes DataFrame plans when it is applied.

Vectors are DataFrames with index columns and `value`. An operator has apply and adjoint; .T, @, +, - and * by a number
build the tree. Rules at construction: a factor of 1 is the identity, scalars are absorbed, the adjoint of a difference
times the difference is one operator, pack times its adjoint is the identity and the other way round a mask, and
identities and zeros go from products and sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import projection, timeline


class LinearOp:
    """Subclasses give apply and adjoint, and may give rules for products with what stands right of them."""

    symmetric = False

    def apply(self, x: DataFrame) -> DataFrame:
        raise NotImplementedError

    def adjoint(self, y: DataFrame) -> DataFrame:
        if self.symmetric:
            return self.apply(y)
        raise NotImplementedError(f"{type(self).__name__} has no adjoint")

    def after(self, right: LinearOp) -> LinearOp | None:
        """self @ right as one simpler operator, or None."""
        return None

    def scaled(self, c: float) -> LinearOp:
        return Composition.of(Homothety(c), self)

    def __call__(self, x: DataFrame) -> DataFrame:
        return self.apply(x)

    @property
    def T(self) -> LinearOp:
        return self if self.symmetric else Adjoint(self)

    def __matmul__(self, other: LinearOp) -> LinearOp:
        return Composition.of(self, other)

    def __add__(self, other: LinearOp) -> LinearOp:
        return Addition.of(self, other)

    def __mul__(self, c: float) -> LinearOp:
        return self.scaled(float(c))

    __rmul__ = __mul__

    def __neg__(self) -> LinearOp:
        return self * -1.0

    def __sub__(self, other: LinearOp) -> LinearOp:
        return self + -other


class Identity(LinearOp):
    symmetric = True

    def apply(self, x: DataFrame) -> DataFrame:
        return x

    def scaled(self, c: float) -> LinearOp:
        return Homothety.of(c)


class Zero(LinearOp):
    symmetric = True

    def apply(self, x: DataFrame) -> DataFrame:
        return x.withColumn("value", F.lit(0.0))

    def scaled(self, c: float) -> LinearOp:
        return self


class Homothety(LinearOp):
    symmetric = True

    def __init__(self, c: float):
        self.c = float(c)

    @classmethod
    def of(cls, c: float) -> LinearOp:
        return Identity() if c == 1 else Zero() if c == 0 else cls(c)

    def apply(self, x: DataFrame) -> DataFrame:
        return x.withColumn("value", F.col("value") * self.c)

    def scaled(self, c: float) -> LinearOp:
        return Homothety.of(c * self.c)

    def after(self, right: LinearOp) -> LinearOp | None:
        return None if isinstance(right, Composition) or type(right).scaled is LinearOp.scaled else right.scaled(self.c)


class Diagonal(LinearOp):
    """Multiplies with a column expression, or with `weight` of a table by index columns (1 where it has no row)."""

    symmetric = True

    def __init__(self, by: Column | DataFrame, on: list[str] | None = None):
        self.by, self.on = by, on

    def apply(self, x: DataFrame) -> DataFrame:
        if isinstance(self.by, DataFrame):
            joined = x.join(self.by.select(*self.on, F.col("weight").alias("__w")), self.on, "left")
            return joined.withColumn("value", F.col("value") * F.coalesce("__w", F.lit(1.0))).select(*x.columns)
        return x.withColumn("value", F.col("value") * self.by)


class Mask(Diagonal):
    """0 where a condition on the index columns holds, or where a table (index, masked) says so."""

    def __init__(self, by: Column | DataFrame, on: list[str] | None = None):
        table = by.select(*on, F.when(F.col("masked"), 0.0).otherwise(1.0).alias("weight")) if isinstance(by, DataFrame) else F.when(by, 0.0).otherwise(1.0)
        super().__init__(table, on)


class Nonlinear(LinearOp):
    """A function of the value, such as clipping or rounding; it has no adjoint."""

    def __init__(self, f: Callable[[Column], Column]):
        self.f = f

    def apply(self, x: DataFrame) -> DataFrame:
        return x.withColumn("value", self.f(F.col("value")))


def clip(low: float, high: float) -> Nonlinear:
    return Nonlinear(lambda v: F.least(F.lit(high), F.greatest(F.lit(low), v)))


class Adjoint(LinearOp):
    def __init__(self, of: LinearOp):
        self.of_ = of

    def apply(self, x: DataFrame) -> DataFrame:
        return self.of_.adjoint(x)

    def adjoint(self, y: DataFrame) -> DataFrame:
        return self.of_.apply(y)

    @property
    def T(self) -> LinearOp:
        return self.of_

    def after(self, right: LinearOp) -> LinearOp | None:
        return self.of_.normal() if right is self.of_ and hasattr(self.of_, "normal") else None


class Composition(LinearOp):
    """operators[0] @ operators[1] @ ..., the last one applied first."""

    def __init__(self, operators: list[LinearOp]):
        self.operators = operators

    @classmethod
    def of(cls, *parts: LinearOp) -> LinearOp:
        flat: list[LinearOp] = []
        for p in parts:
            flat += p.operators if isinstance(p, Composition) else [p]
        out: list[LinearOp] = []
        for p in flat:
            if isinstance(p, Identity):
                continue
            while out and (one := out[-1].after(p)) is not None:
                out.pop()
                p = one
            if not isinstance(p, Identity):
                out.append(p)
        if any(isinstance(p, Zero) for p in out):
            return Zero()
        return Identity() if not out else out[0] if len(out) == 1 else cls(out)

    def apply(self, x: DataFrame) -> DataFrame:
        for p in reversed(self.operators):
            x = p.apply(x)
        return x

    def adjoint(self, y: DataFrame) -> DataFrame:
        for p in self.operators:
            y = p.adjoint(y)
        return y

    @property
    def T(self) -> LinearOp:
        return Composition.of(*[p.T for p in reversed(self.operators)])

    def scaled(self, c: float) -> LinearOp:
        return Composition.of(self.operators[0].scaled(c), *self.operators[1:])


class Addition(LinearOp):
    """Sums of operators with the same index columns on both sides."""

    def __init__(self, operators: list[LinearOp]):
        self.operators = operators

    @classmethod
    def of(cls, *parts: LinearOp) -> LinearOp:
        flat: list[LinearOp] = []
        for p in parts:
            flat += p.operators if isinstance(p, Addition) else [] if isinstance(p, Zero) else [p]
        return Zero() if not flat else flat[0] if len(flat) == 1 else cls(flat)

    def _sum(self, parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        index = [c for c in out.columns if c != "value"]
        for p in parts[1:]:
            out = out.select(*index, "value").unionByName(p.select(*index, "value"))
        return out.groupBy(*index).agg(F.sum("value").alias("value"))

    def apply(self, x: DataFrame) -> DataFrame:
        return self._sum([p.apply(x) for p in self.operators])

    def adjoint(self, y: DataFrame) -> DataFrame:
        return self._sum([p.adjoint(y) for p in self.operators])

    @property
    def T(self) -> LinearOp:
        return Addition.of(*[p.T for p in self.operators])

    def scaled(self, c: float) -> LinearOp:
        return Addition.of(*[p * c for p in self.operators])


class BlockDiagonal(LinearOp):
    """One operator for each value of a key, such as the slice."""

    def __init__(self, key: str, blocks: dict[object, LinearOp]):
        self.key, self.blocks = key, blocks

    def _each(self, x: DataFrame, f: Callable[[LinearOp, DataFrame], DataFrame]) -> DataFrame:
        parts = [f(p, x.filter(F.col(self.key) == k)) for k, p in self.blocks.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def apply(self, x: DataFrame) -> DataFrame:
        return self._each(x, lambda p, d: p.apply(d))

    def adjoint(self, y: DataFrame) -> DataFrame:
        return self._each(y, lambda p, d: p.adjoint(d))


class BlockColumn(LinearOp):
    """One operator below the other: each one's rows are named in a key; the adjoint adds up."""

    def __init__(self, key: str, blocks: dict[object, LinearOp]):
        self.key, self.blocks = key, blocks

    def apply(self, x: DataFrame) -> DataFrame:
        parts = [p.apply(x).withColumn(self.key, F.lit(k)) for k, p in self.blocks.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def adjoint(self, y: DataFrame) -> DataFrame:
        return Addition([])._sum([p.adjoint(y.filter(F.col(self.key) == k).drop(self.key)) for k, p in self.blocks.items()])


class Projection(LinearOp):
    """The pointing matrix as an operator from maps (pixel, value) to samples."""

    def __init__(self, matrix: DataFrame, sample: list[str] = projection.SAMPLE):
        self.matrix, self.sample = matrix, sample

    def apply(self, x: DataFrame) -> DataFrame:
        return projection.project(self.matrix, x, self.matrix.select(*self.sample).distinct(), self.sample)

    def adjoint(self, y: DataFrame) -> DataFrame:
        return projection.back_project(self.matrix, y, self.sample)


class OnTheFly(Projection):
    """A projection whose matrix is built each time it is used."""

    def __init__(self, build: Callable[[], DataFrame], sample: list[str] = projection.SAMPLE):
        self.build, self.sample = build, sample

    @property
    def matrix(self) -> DataFrame:
        return self.build()


class _Timeline(LinearOp):
    def __init__(self, keys: list[str], order: str):
        self.keys, self.order = keys, order

    @property
    def _at(self) -> tuple:
        return self.keys, self.order, "value"


class Difference(_Timeline):
    def apply(self, x: DataFrame) -> DataFrame:
        return timeline.diff(x, *self._at)

    def adjoint(self, y: DataFrame) -> DataFrame:
        return timeline.diff_adjoint(y, *self._at)

    def normal(self) -> LinearOp:
        return DifferenceNormal(self.keys, self.order)


class DifferenceNormal(_Timeline):
    """Difference.T @ Difference, times a scalar, in one window."""

    symmetric = True

    def __init__(self, keys: list[str], order: str, scalar: float = 1.0):
        super().__init__(keys, order)
        self.scalar = scalar

    def apply(self, x: DataFrame) -> DataFrame:
        return timeline.diff_normal(x, *self._at, self.scalar)

    def scaled(self, c: float) -> LinearOp:
        return Zero() if c == 0 else DifferenceNormal(self.keys, self.order, self.scalar * c)


class Shift(_Timeline):
    def __init__(self, keys: list[str], order: str, n: int):
        super().__init__(keys, order)
        self.n = n

    def apply(self, x: DataFrame) -> DataFrame:
        return timeline.shift(x, *self._at, self.n)

    def adjoint(self, y: DataFrame) -> DataFrame:
        return timeline.shift(y, *self._at, -self.n)


class Pad(_Timeline):
    def __init__(self, keys: list[str], order: str, left: int = 0, right: int = 0):
        super().__init__(keys, order)
        self.left, self.right = left, right

    def apply(self, x: DataFrame) -> DataFrame:
        return timeline.pad(x, *self._at, self.left, self.right)

    def adjoint(self, y: DataFrame) -> DataFrame:
        return timeline.trim(y, *self._at, self.left, self.right)


class Average(_Timeline):
    def __init__(self, keys: list[str], order: str, factor: int | Column):
        super().__init__(keys, order)
        self.factor = factor

    def __new__(cls, keys, order, factor):
        return Identity() if isinstance(factor, int) and factor == 1 else super().__new__(cls)

    def apply(self, x: DataFrame) -> DataFrame:
        return timeline.average(x, *self._at, self.factor)

    def adjoint(self, y: DataFrame) -> DataFrame:
        return timeline.average_adjoint(y, *self._at, self.factor)


class DownSample(Average):
    def apply(self, x: DataFrame) -> DataFrame:
        return timeline.downsample(x, *self._at, self.factor)

    def adjoint(self, y: DataFrame) -> DataFrame:
        return timeline.downsample_adjoint(y, *self._at, self.factor)


class Pack(_Timeline):
    """Drops the masked places of a table (keys, order, masked)."""

    def __init__(self, full: DataFrame, keys: list[str], order: str, mask: str = "masked"):
        super().__init__(keys, order)
        self.full, self.mask = full, mask

    def apply(self, x: DataFrame) -> DataFrame:
        return timeline.pack(x.join(self.full.select(*self.keys, self.order, self.mask), [*self.keys, self.order]), *self._at, self.mask)

    def adjoint(self, y: DataFrame) -> DataFrame:
        return timeline.unpack(y, self.full, *self._at, self.mask)

    def after(self, right: LinearOp) -> LinearOp | None:
        return Identity() if isinstance(right, Adjoint) and right.of_ is self else None

    def normal(self) -> LinearOp:
        return Mask(self.full.select(*self.keys, self.order, F.col(self.mask).alias("masked")), [*self.keys, self.order])


class Response(_Timeline):
    """Convolution with a truncated exponential."""

    def __init__(self, keys: list[str], order: str, tau: float | str):
        super().__init__(keys, order)
        self.tau = tau

    def apply(self, x: DataFrame) -> DataFrame:
        return timeline.exponential_response(x, *self._at, self.tau)

    def adjoint(self, y: DataFrame) -> DataFrame:
        return timeline.exponential_response(y, *self._at, self.tau, adjoint=True)


class HalfComplex(_Timeline):
    def apply(self, x: DataFrame) -> DataFrame:
        return timeline.fft_half_complex(x, *self._at)

    def adjoint(self, y: DataFrame) -> DataFrame:
        return timeline.fft_half_complex(y, *self._at, inverse=True)


class InverseNoise(_Timeline):
    symmetric = True

    def __init__(self, filters: DataFrame, keys: list[str], order: str, root: bool = False):
        super().__init__(keys, order)
        self.filters, self.root = filters, root

    def apply(self, x: DataFrame) -> DataFrame:
        return timeline.inverse_noise(x, self.filters, *self._at, self.root)
