"""Mixtures over spectra against a plain loop and known values."""

import math

import pytest
from pyspark.sql import functions as F

from readloom.functions import alignment
from readloom.operators import spectrum

SCHEMA = "cluster string, coverage double, cov long, n_kmers long"


def made(coverage, errors, once, twice):
    return {c: round(errors * alignment.poisson(c, 1.2) + once * alignment.negative_binomial(c, coverage, 1.4 * coverage) + twice * alignment.negative_binomial(c, 2 * coverage, 3 * coverage)) for c in range(1, int(5 * coverage))}


@pytest.fixture(scope="module")
def fits(spark):
    spectra = {"a": (28.0, made(30, 5000, 4000, 300)), "b": (12.0, made(11, 900, 2000, 0)), "c": (50.0, {7: 3}), "d": (40.0, {900: 5})}
    rows = [(g, cover, c, n) for g, (cover, bins) in spectra.items() for c, n in bins.items()]
    table = spark.createDataFrame(rows + [("e", None, 3, 4), ("a", 28.0, None, 5), ("a", 28.0, 4, None)], SCHEMA)
    return spectra, table, {r.cluster: r for r in spectrum.summary(spectrum.fit(table, "cluster")).collect()}


def test_log_gamma_and_densities(spark):
    points = [1e-3, 0.2, 1.0, 2.0, 7.5, 30.0, 1e3, 1e7, 4e9]
    found = spark.createDataFrame([(x,) for x in points], "x double").select(spectrum.log_gamma(F.col("x"))).collect()
    assert all(math.isclose(f[0], math.lgamma(x), rel_tol=1e-12, abs_tol=1e-11) for f, x in zip(found, points, strict=True))
    cases = [(k, m, v) for k in (0.0, 1.0, 4.0, 90.0) for m, v in ((2.0, 2.2), (5.0, 9.0), (80.0, 70.0))]
    dense = spark.createDataFrame(cases, "k double, m double, v double").select(spectrum.log_negative_binomial(F.col("k"), F.col("m"), F.col("v")), spectrum.log_geometric(F.col("k"), F.col("m"))).collect()
    for (k, m, v), (binomial, geometric) in zip(cases, dense, strict=True):
        assert math.isclose(math.exp(binomial), alignment.negative_binomial(k, m, v), rel_tol=1e-6)
        assert math.isclose(math.exp(geometric), alignment.geometric(k, m), rel_tol=1e-9)


def test_fits_equal_a_plain_loop(fits):
    spectra, _, found = fits
    assert set(found) == {"a", "b", "c", "d"}  # no coverage, no fit
    for g in "ab":
        coverage, bins = spectra[g]
        naive = alignment.Mixture(bins, coverage)
        for own, theirs in ((found[g]["mean"], naive.mean), (found[g].variance, naive.variance), (found[g].mass, naive.mass)):
            assert all(math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6) for x, y in zip(own, theirs, strict=True))
        assert found[g].genome_size == int(naive.genome_size())


def test_fit_finds_coverage_and_cutoff(fits):
    _, _, found = fits
    assert abs(found["a"]["mean"][2] - 30) < 1 and 3 <= found["a"].cutoff <= 15 and found["a"].x_max == 84
    assert abs(found["a"].genome_size - 4600) < 300
    assert found["a"].y_max == pytest.approx(1.2 * found["a"].mass[2] * alignment.negative_binomial(found["a"]["mean"][2], found["a"]["mean"][2], found["a"].variance[2]))


def test_groups_without_usable_counts_keep_the_start(fits):
    _, _, found = fits
    assert found["d"]["mean"] == [2, 3, 40, 80] and found["d"].mass == [1] * 4
    assert all(math.isfinite(x) for x in found["c"]["mean"] + found["c"].variance + found["c"].mass)


def test_evaluated_spectrum_follows_the_data(fits, spark):
    spectra, table, _ = fits
    rows = spectrum.evaluated(table, spectrum.fit(table, "cluster"), "cluster").filter("cluster = 'a' and cov between 20 and 40").collect()
    assert len(rows) == 21 and all(abs(r.fit - r.n_kmers) < 0.1 * r.n_kmers + 5 and r.odds < 1 for r in rows)


def test_empty_spectrum(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spectrum.summary(spectrum.fit(empty, "cluster")).count() == 0
