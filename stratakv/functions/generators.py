"""Key distributions for workloads, as columns of a uniform draw in [0, 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THETA = 0.99


def uniform(seed: Column, salt: int = 0) -> Column:
    """A repeatable draw in [0, 1) for each row."""
    return F.pmod(F.xxhash64(seed, F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)


def zeta(n: int, theta: float = THETA) -> float:
    """Sum of i^-theta: exactly to 100 000 terms, then by the integral."""
    exact = min(n, 100_000)
    total = sum(i**-theta for i in range(1, exact + 1))
    return total if n == exact else total + ((n + 0.5) ** (1 - theta) - (exact + 0.5) ** (1 - theta)) / (1 - theta)


def zipf(u: Column, n: int, theta: float = THETA) -> Column:
    """Ranks 0..n-1, small ones often, by inversion of the approximated distribution."""
    z, alpha = zeta(n, theta), 1 / (1 - theta)
    eta = (1 - (2.0 / n) ** (1 - theta)) / (1 - zeta(2, theta) / z)
    rest = F.floor(n * F.pow(eta * u - eta + 1, F.lit(alpha))).cast("long")
    return F.when(u * z < 1, F.lit(0)).when(u * z < 1 + 0.5**theta, F.lit(1)).otherwise(F.least(rest, F.lit(n - 1))).cast("long")


def clustered_zipf(u: Column, v: Column, n: int, unit: int = 1000) -> Column:
    """A zipfian cluster of `unit` neighbours, and a uniform place in it."""
    return zipf(u, max(1, n // unit)) * unit + F.floor(v * unit).cast("long")


def latest(u: Column, head: Column, n: int) -> Column:
    """Recent items often: the head less a zipfian distance, not below 0."""
    return F.greatest(head - zipf(u, n), F.lit(0))


def sequential(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "n")
