"""Mathematical, vector and statistical functions that Spark lacks or spells differently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x.cast("double"))


def dot_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot_product(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return F.try_divide(dot_product(a, b), l2_norm(a) * l2_norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def manhattan_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def truncate(x: Column, digits: int = 0) -> Column:
    """Toward zero, at a decimal digit."""
    scale = 10.0**digits
    return F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)) / scale


def is_inf(x: Column) -> Column:
    return F.abs(x) == float("inf")


def sech(x: Column) -> Column:
    return 1 / F.cosh(x)


def csch(x: Column) -> Column:
    return F.try_divide(F.lit(1.0), F.sinh(x))


def coth(x: Column) -> Column:
    return F.try_divide(F.lit(1.0), F.tanh(x))


def log_base(base: float, x: Column) -> Column:
    """log of x to a base; null for x <= 0."""
    return F.when(x > 0, F.ln(x) / F.ln(F.lit(base)))


def xor(a: Column, b: Column) -> Column:
    return a != b


def boolxor_agg(x: Column) -> Column:
    """Whether exactly one value is true."""
    return F.count_if(x) == 1


def hash_agg(*cs: Column) -> Column:
    """Order-independent hash of the rows of a group, repeated ones included: the sum of their hashes modulo 2**63."""
    return F.pmod(F.sum(F.xxhash64(*cs).cast("decimal(28, 0)")), F.lit(str(1 << 63)).cast("decimal(20, 0)")).cast("long")


def range_bucket(x: Column, bounds: Sequence[float]) -> Column:
    """Number of the bounds that are not above x."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= x))


def range_n(x: Column, start: int, end: int, each: int) -> Column:
    """Number, from 1, of the range [start, start + each), ... that holds x; null outside."""
    return F.when(x.between(start, end), F.floor((x - start) / each) + 1)


def regr_valx(y: Column, x: Column) -> Column:
    return F.when(y.isNotNull(), x)


def regr_valy(y: Column, x: Column) -> Column:
    return F.when(x.isNotNull(), y)


def safe_corr(x: str, y: str) -> Column:
    """Correlation; null where a variance is zero."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    sd = lambda c: F.stddev_pop(F.when(both, F.col(c)))
    return F.try_divide(F.covar_pop(x, y), sd(x) * sd(y))


def normal(mean: float, sd: float, seed: int | None = None) -> Column:
    return F.randn(seed) * sd + mean


def zipf(s: float, n: int, seed: int | None = None) -> Column:
    """A number from 1 to n of chance in proportion to 1 / k**s, by a search of the cumulative chances."""
    weights = [k**-s for k in range(1, n + 1)]
    total, cumulative, t = sum(weights), [], 0.0
    for w in weights:
        t += w
        cumulative.append(t / total)
    return F.least(range_bucket(F.rand(seed), cumulative) + 1, F.lit(n))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres on a sphere of radius 6371008.8."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371008.8 * F.asin(F.sqrt(a))


def greatest_strict(*cs: Column) -> Column:
    """greatest that is null if any argument is."""
    null = F.lit(False)
    for c in cs:
        null |= c.isNull()
    return F.when(~null, F.greatest(*cs))


def least_strict(*cs: Column) -> Column:
    null = F.lit(False)
    for c in cs:
        null |= c.isNull()
    return F.when(~null, F.least(*cs))


def between_symmetric(x: Column, a: Column, b: Column) -> Column:
    return x.between(F.least(a, b), F.greatest(a, b))
