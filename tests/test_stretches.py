"""Counting of k-mers by minimizers, and the graph that is made of their stretches."""

import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from readloom.functions.sequence import canonical, explode_kmers
from readloom.operators import graph, stretches


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def by_kmers(frame, k, least=1):
    counts = explode_kmers(frame, k).groupBy(canonical(F.col("kmer")).alias("seq")).agg(F.count("*").alias("kmer_cov")).filter(F.col("kmer_cov") >= least)
    single = counts.select(graph.kmer_code(F.col("seq"), k).alias("id"), "seq", F.lit(1).cast("long").alias("n"), "kmer_cov")
    coded = graph.arcs(frame, k).filter(F.col("cov") >= least).select(graph.kmer_code(F.col("src"), k).alias("src"), graph.kmer_code(F.col("dst"), k).alias("dst"), "cov")
    return graph.concatenate(single, coded, k)


@pytest.mark.parametrize(("k", "least"), [(31, 1), (7, 300)])
def test_counts_of_hot_kmers_and_long_reads(spark, monkeypatch, k, least):
    """Counts above a byte, a read longer than a piece, buckets that wait, k-mers of few letters."""
    rng = random.Random(k)
    long = "".join(rng.choices("ACGT", k=(1 << stretches.PLACES) + 900))
    reads = [long, "A" * 900, "AC" * 400, long[300:500] * 2 + "N" + rc(long[450:700])] + [long[16300:16500]] * 320
    frame = spark.createDataFrame([(r,) for r in reads], "seq string")
    monkeypatch.setattr(stretches, "_AT_ONCE", 50)
    for mine, other in zip(graph.build(frame, k, least), by_kmers(frame, k, least), strict=True):
        assert sorted(map(str, mine.collect())) == sorted(map(str, other.select(mine.columns).collect()))


def test_rings_are_closed_wherever_they_are_opened(spark):
    """Rings of reads that are torn anywhere, each with its own count, on either strand."""
    rng = random.Random(5)
    reads = []
    for times in range(1, 30):
        ring = "".join(rng.choices("ACGT", k=rng.randint(14, 40)))
        pieces = [(ring * 3)[i : i + 13] for i in range(len(ring))]
        reads += [p if rng.random() < 0.5 else rc(p) for p in pieces] * times
    frame = spark.createDataFrame([(r,) for r in reads], "seq string")
    for mine, other in zip(graph.build(frame, 9), by_kmers(frame, 9), strict=True):
        assert sorted(map(str, mine.collect())) == sorted(map(str, other.select(mine.columns).collect()))


def test_kmers_are_not_shuffled_one_by_one_to_be_counted(spark):
    rng = random.Random(2)
    frame = spark.createDataFrame([("".join(rng.choices("ACGT", k=100)),) for _ in range(200)], "seq string")
    shown = io.StringIO()
    with redirect_stdout(shown):
        stretches.stretches(frame, 15).explain()
    assert "HashAggregate" not in shown.getvalue() and "SortAggregate" not in shown.getvalue()
    named = frame.select("seq", F.xxhash64("seq").alias("name"))
    assert named.mapInArrow(stretches._on(stretches._pieces, 15), stretches._ddl(stretches._PIECE)).count() < 200 * 86 / 3
