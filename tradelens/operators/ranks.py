"""Ranks over whole sets without a task that sees the whole: places by range, average ranks, correlation, fifths, p values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.sources.staging import numbered


def average_ranks(rows: DataFrame, keys: list[str], column: str, ties: list[str], name: str) -> DataFrame:
    """rows with the rank of column within keys as name; equal values share the mean of their places.

    ties are columns that tell rows of equal values apart, so that a value that most rows have is dealt to many tasks. A
    null value has no rank. The ranks are joined to the staged rows, so rows are not computed again.
    """
    placed = numbered(rows, F.asc_nulls_last(column), *ties, keys=keys)
    means = placed.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.avg("place").alias(name))
    means = means.select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(keys)], F.col(column).alias("_value"), name)
    same = F.col(column) == F.col("_value")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_m{i}"))
    return placed.join(means, same, "left").select(*rows.columns, name)


def percent_ranks(rows: DataFrame, keys: list[str], column: str, ties: list[str], name: str) -> DataFrame:
    """rows with the average rank of column as a share of the rows of its keys that have a value."""
    ranked = average_ranks(rows, keys, column, ties, name)
    sizes = ranked.groupBy(*keys).agg(F.count(column).alias("_n"))
    joined = ranked.join(sizes, keys) if keys else ranked.crossJoin(F.broadcast(sizes))
    return joined.withColumn(name, F.col(name) / F.col("_n")).select(*rows.columns, name)


def spearman(rows: DataFrame, keys: list[str], a: str, b: str, ties: list[str], least: int = 8) -> DataFrame:
    """keys, n and rho of the rows that have both values: null for fewer than least or where a side has no spread."""
    both = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_ranks(average_ranks(both, keys, a, ties, "_ra"), keys, b, ties, "_rb")
    spread = F.stddev_pop("_ra") * F.stddev_pop("_rb")
    rho = F.when((F.count(F.lit(1)) >= least) & (spread > 0), F.try_divide(F.covar_pop("_ra", "_rb"), spread))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rho.alias("rho"))


def fifths(rows: DataFrame, keys: list[str], by: str, ties: list[str]) -> DataFrame:
    """rows that have a value with its fifth: 0 for the smallest values, 4 for the largest; null in sets of one row."""
    known = rows.filter(F.col(by).isNotNull())
    placed = numbered(known, by, *ties, keys=keys)
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    joined = placed.join(sizes, keys) if keys else placed.crossJoin(F.broadcast(sizes))
    edge = F.try_divide((F.col("place") - 1) * F.lit(5.0), F.col("_n") - 1)
    return joined.withColumn("fifth", (F.greatest(F.ceil(edge), F.lit(1)) - 1).cast("int")).select(*rows.columns, "fifth")


#: The coefficients of Lanczos' approximation of the gamma function for g = 7.
_LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x of 1/2 and more."""
    y = x - 1
    series = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (y + k)
    t = y + 7.5
    return F.lit(0.9189385332046727) + (y + 0.5) * F.log(t) - t + F.log(series)


def incomplete_beta(a: Column, b: Column, x: Column, steps: int = 300) -> Column:
    """The regularised incomplete beta function for a and b of 1/2 and more and x from 0 to 1, as a continued fraction."""

    def fraction(a: Column, b: Column, x: Column) -> Column:
        safe = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
        first = F.lit(1.0) / safe(1 - (a + b) * x / (a + 1))

        def turn(s: Column, m: Column) -> Column:
            m = m.cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            half = F.transform(F.array(s), lambda s: F.struct((F.lit(1.0) / safe(1 + even * s["d"])).alias("d"), safe(1 + even / s["c"]).alias("c"), s["h"].alias("h")))[0]
            whole = F.transform(F.array(half), lambda s: F.struct(s["d"].alias("d"), s["c"].alias("c"), (s["h"] * s["d"] * s["c"]).alias("h")))[0]
            full = F.transform(F.array(whole), lambda s: F.struct((F.lit(1.0) / safe(1 + odd * s["d"])).alias("d"), safe(1 + odd / s["c"]).alias("c"), s["h"].alias("h")))[0]
            return F.transform(F.array(full), lambda s: F.struct(s["d"].alias("d"), s["c"].alias("c"), (s["h"] * s["d"] * s["c"]).alias("h")))[0]

        start = F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, turn)["h"]

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    near = x < (a + 1) / (a + b + 2)
    # each side is computed where it converges fast
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(near, front * fraction(a, b, x) / a).otherwise(1 - front * fraction(b, a, 1 - x) / b)


def correlation_p(rho: Column, n: Column) -> Column:
    """The two-sided p value of a correlation of n pairs: that of t with n - 2 degrees of freedom; 0 where it is perfect."""
    df = (n - 2).cast("double")
    x = F.greatest(1 - rho * rho, F.lit(0.0))  # df / (df + t * t)
    return F.when((df > 0) & rho.isNotNull(), incomplete_beta(df / 2, F.lit(0.5), x))
