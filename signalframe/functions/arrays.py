"""Array expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    The optimiser inlines a computed column into the lambda that uses it, which
    would recompute it for every array element; a lambda parameter is not inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def mean(x: Column) -> Column:
    return total(x) / F.nullif(F.size(x), F.lit(0))


def spread(x: Column, ddof: int = 0) -> Column:
    """Standard deviation; ``ddof=0`` population, ``ddof=1`` sample.

    Moments are taken about the first element in one fold, so a large offset
    does not cancel and no second pass is needed.
    """

    def step(acc, v):
        d = v - acc["o"]
        return F.struct(acc["o"].alias("o"), (acc["s"] + d).alias("s"), (acc["q"] + d * d).alias("q"), (acc["n"] + 1.0).alias("n"))

    def finish(acc):
        m2 = F.greatest(acc["q"] - acc["s"] * acc["s"] / acc["n"], F.lit(0.0))
        return F.sqrt(m2 / F.nullif(acc["n"] - F.lit(float(ddof)), F.lit(0.0)))

    zero = F.struct(F.coalesce(F.get(x, F.lit(0)).cast("double"), F.lit(0.0)).alias("o"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("n"))
    return F.when(F.size(x) > 0, F.aggregate(x, zero, step, finish))


def moments(x: Column) -> Column:
    """``n, mean, m2, lo, hi`` of the elements that are not null; m2 is the sum of squares about the mean.

    One fold about the first element, so a large offset does not cancel.
    """

    def step(acc, v):
        d = v - acc["o"]
        return F.struct(acc["o"].alias("o"), (acc["s"] + d).alias("s"), (acc["q"] + d * d).alias("q"))

    def finish(known):
        zero = F.struct(F.get(known, F.lit(0)).alias("o"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
        n = F.size(known).cast("long")
        fold = lambda a: F.struct(
            n.alias("n"), (a["o"] + a["s"] / n).alias("mean"), F.greatest(a["q"] - a["s"] * a["s"] / n, F.lit(0.0)).alias("m2"), F.array_min(known).alias("lo"), F.array_max(known).alias("hi")
        )
        return F.when(n > 0, let(F.aggregate(known, zero, step), fold))

    return let(F.filter(doubles(x), lambda v: v.isNotNull()), finish)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda u, v: u * v))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def pad_to(x: Column, n) -> Column:
    """Right-pad with zeros to length ``n``; longer arrays are left alone."""
    size = n if isinstance(n, Column) else F.lit(n)
    missing = F.greatest(size - F.size(x), F.lit(0)).cast("int")
    return F.concat(x, F.array_repeat(F.lit(0.0), missing))


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def softmax(x: Column) -> Column:
    def scaled(top):
        return let(F.transform(x, lambda v: F.exp(v - top)), lambda e: let(total(e), lambda t: F.transform(e, lambda v: v / t)))

    return let(F.array_max(x), scaled)


def quantile(x: Column, q) -> Column:
    """Linear-interpolated quantile of one bounded array."""
    level = q if isinstance(q, Column) else F.lit(float(q))

    def pick(s):
        place = level * (F.size(s) - 1)
        lo = F.floor(place).cast("int")
        hi = F.ceil(place).cast("int")
        return F.get(s, lo) + (place - lo) * (F.get(s, hi) - F.get(s, lo))

    return let(F.sort_array(x), pick)
