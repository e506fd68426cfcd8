"""Mixtures of negative binomials fitted to k-mer spectra, one for each group, and what follows from them.

A group's spectrum is one row: its counts up to three times the coverage, so the array is bounded by the coverage and not by
the data. All rounds of expectation and maximisation run over that row as higher-order functions, so thousands of groups
are fitted in one pass without a shuffle after the counting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Errors at counts 2 and 3, true k-mers at the coverage and at twice the coverage.
ERRORS, TRUE = 2, 2
PARTS = ERRORS + TRUE
#: Spread of a component at the start, and the least by which a variance exceeds its mean.
SPREAD, LEAST = 1.1, 1e-3
#: Of an error against a true k-mer, below which a count is taken for true.
CUTOFF_ODDS = 0.5


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series at x + 8, stepped back by eight factors."""
    product = F.lit(1.0)
    for i in range(8):
        product = product * (x + i)
    return _let(x + 8, lambda z: (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + (1 / 12.0 - (1 / 360.0 - (1 / 1260.0 - 1 / 1680.0 / (z * z)) / (z * z)) / (z * z)) / z) - F.ln(product)


def log_negative_binomial(x: Column, mean: Column, variance: Column) -> Column:
    """Log density by mean and variance, which is taken a thousandth above the mean if it is not above it."""

    def density(v: Column) -> Column:
        r = mean * mean / (v - mean)
        return _let(r, lambda r: log_gamma(x + r) - log_gamma(x + 1.0) - log_gamma(r) + r * F.ln(mean / v) + x * F.ln((v - mean) / v))

    return _let(F.greatest(variance, mean + LEAST), density)


def log_geometric(x: Column, mean: Column) -> Column:
    return x * F.ln(mean / (mean + 1.0)) - F.ln(mean + 1.0)


def with_coverage(bins: DataFrame, *group: str) -> DataFrame:
    """``bins`` (group, cov, n_kmers) with coverage, the mean count of the k-mers that occur more than once, to two places."""
    of_group = Window.partitionBy(*group)  # a row for each distinct count
    repeated = F.when(F.col("cov") > 1, F.col("n_kmers"))
    return bins.withColumn("coverage", F.round(F.sum(repeated * F.col("cov")).over(of_group) / F.sum(repeated).over(of_group), 2))


def _array(*values: Column) -> Column:
    return F.array(*[v.cast("double") for v in values])


def fit(spectrum: DataFrame, *group: str, rounds: int = 50) -> DataFrame:
    """group, coverage, x_max, mean, variance, mass (arrays of the four components) of ``spectrum`` (group, coverage, cov,
    n_kmers), whose coverage is one number a group.

    Counts above three times the coverage, below 1 or without k-mers take no part; a group without any keeps the components of the
    start. Nulls count as absent. A group whose coverage is null has no fit, so no row.
    """
    used = (F.col("cov") >= 1) & (F.col("cov") <= (TRUE + 1) * F.col("coverage")) & (F.col("n_kmers") > 0)
    bin_ = F.when(used, F.struct(F.col("cov").cast("double").alias("x"), F.col("n_kmers").cast("double").alias("y")))
    rows = spectrum.filter("coverage > 0").groupBy(*group, F.col("coverage").cast("double").alias("coverage")).agg(F.array_sort(F.collect_list(bin_)).alias("bins"))
    parts = F.sequence(F.lit(0), F.lit(PARTS - 1))
    start = _array(*[F.lit(2.0 + i) for i in range(ERRORS)], *[F.col("coverage") * (i + 1) for i in range(TRUE)])
    zero = _array(*[F.lit(0.0)] * PARTS)
    state = F.struct(start.alias("mean"), F.transform(start, lambda m: m * SPREAD).alias("variance"), F.transform(start, lambda _: F.lit(1.0)).alias("mass"))

    def shares(s: Column, x: Column) -> Column:
        """How likely each component made a k-mer that occurs x times."""
        logs = F.transform(parts, lambda j: F.ln(F.get(s["mass"], j)) + log_negative_binomial(x, F.get(s["mean"], j), F.get(s["variance"], j)))
        near = lambda ls: F.transform(ls, lambda a: F.exp(a - F.array_max(ls)))
        return _let(_let(logs, near), lambda e: F.transform(e, lambda a: a / F.aggregate(e, F.lit(0.0), lambda t, b: t + b)))

    def added(s: Column) -> Callable[[Column, Column], Column]:
        def one(sums: Column, b: Column) -> Column:
            w = lambda power: lambda t, p: t + p * b["y"] * (F.lit(1.0) if not power else b["x"] if power == 1 else b["x"] * b["x"])
            more = lambda p: F.struct(*[F.zip_with(sums[c], p, w(i)).alias(c) for i, c in enumerate(("n", "x", "xx"))])
            return _let(shares(s, b["x"]), more)

        return one

    def step(s: Column, _: Column) -> Column:
        sums = F.aggregate("bins", F.struct(*[zero.alias(c) for c in ("n", "x", "xx")]), added(s))

        def moved(t: Column) -> Column:
            mass = F.transform(t["n"], lambda n: F.greatest(n, F.lit(1e-12)))
            means = F.transform(parts, lambda j: F.greatest(F.get(t["x"], j) / F.greatest(F.get(t["n"], j), F.lit(1e-12)), F.lit(LEAST)))
            spread = lambda m: F.transform(parts, lambda j: F.greatest(F.get(t["xx"], j) / F.greatest(F.get(t["n"], j), F.lit(1e-12)) - F.get(m, j) * F.get(m, j), F.get(m, j) + LEAST))
            return _let(means, lambda m: F.struct(m.alias("mean"), spread(m).alias("variance"), mass.alias("mass")))

        return _let(sums, moved)

    fitted = F.when(F.size("bins") == 0, state).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, step))
    return rows.withColumn("s", fitted).select(*group, "coverage", ((TRUE + 1) * F.col("coverage")).alias("x_max"), "s.mean", "s.variance", "s.mass")


def density(x: Column, first: int, last: int) -> Column:
    """K-mers that the components ``first`` to ``last`` (excluded) of a row of ``fit`` expect at a count."""
    whole = F.lit(0.0)
    for j in range(first, last):
        whole = whole + F.get("mass", F.lit(j)) * F.exp(log_negative_binomial(x, F.get("mean", F.lit(j)), F.get("variance", F.lit(j))))
    return whole


def odds(x: Column) -> Column:
    """Errors against the true k-mers that occur once in the genome, among those seen x times; null if neither is expected."""
    return density(x, 0, ERRORS) / F.nullif(density(x, ERRORS, ERRORS + 1), F.lit(0.0))


def summary(fitted: DataFrame) -> DataFrame:
    """``fitted`` with cutoff, genome_size and y_max.

    The cutoff is the first count from the errors' first mean on at which errors are less than half as likely as k-mers
    that occur once, or the first at or above the mean of these; the genome size counts the k-mers of the second true component twice;
    y_max is the height of a plot: the peak of the first true component and a fifth.
    """
    low, peak = F.ceil(F.get("mean", F.lit(0))), F.get("mean", F.lit(ERRORS))
    high = F.greatest(low, F.ceil(peak))
    # the first of the counts below the peak that passes; the counts are as many as the mean of a component is large
    cutoff = F.coalesce(F.get(F.filter(F.sequence(low, high), lambda c: (c < peak) & (odds(c.cast("double")) < CUTOFF_ODDS)), F.lit(0)), high)
    size = F.lit(0.0)
    for j in range(TRUE):
        size = size + (j + 1) * F.get("mass", F.lit(ERRORS + j))
    return fitted.withColumns({"cutoff": cutoff.cast("int"), "genome_size": F.floor(size).cast("long"), "y_max": 1.2 * density(peak, ERRORS, ERRORS + 1)})


def evaluated(spectrum: DataFrame, fitted: DataFrame, *group: str) -> DataFrame:
    """``spectrum`` (group, cov, n_kmers) with fit, what the mixture expects at a count, and odds. A fit is one row a group."""
    joined = spectrum.join(fitted.select(*group, "mean", "variance", "mass"), list(group))
    x = F.col("cov").cast("double")
    return joined.select(*group, "cov", "n_kmers", density(x, 0, PARTS).alias("fit"), odds(x).alias("odds"))
