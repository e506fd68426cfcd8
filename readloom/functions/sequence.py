"""Column functions over DNA strings; all of them are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column) -> Column:
    return complement(F.reverse(seq))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement; for odd k the two always differ."""
    return F.least(kmer, reverse_complement(kmer))


def push_right(kmer: Column, base: Column) -> Column:
    return F.concat(F.substring(kmer, 2, 1 << 20), base)


def push_left(kmer: Column, base: Column) -> Column:
    return F.concat(base, F.left(kmer, F.length(kmer) - 1))


def explode_kmers(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Each row once for each of its k-mers of A, C, G and T only, with ``pos`` and ``kmer``; other columns stay.

    Positions are generated and cut out in compiled code; only rows with other letters have their windows matched.
    """
    whole = df.withColumn("_plain", ~F.col(seq).rlike("[^ACGT]")).filter(F.length(seq) >= k)
    placed = whole.withColumn("pos", F.explode(F.sequence(F.lit(0), F.length(seq) - k)))
    cut = placed.withColumn("kmer", F.substring(F.col(seq), F.col("pos") + 1, F.lit(k)))
    return cut.filter(F.col("_plain") | F.col("kmer").rlike("^[ACGT]+$")).drop("_plain")


def rotations(pattern: str) -> list[str]:
    """All rotations of a pattern and their reverse complements, each once, sorted."""
    turned = {pattern[i:] + pattern[:i] for i in range(len(pattern))}
    table = str.maketrans("ACGT", "TGCA")
    return sorted(turned | {t.translate(table)[::-1] for t in turned})


def rotations_of(pattern: Column) -> Column:
    """``rotations`` of a column of patterns, as an array; null for a null or empty pattern."""
    turned = F.transform(F.sequence(F.lit(0), F.length(pattern) - 1), lambda i: F.concat(F.substring(pattern, i + 1, F.length(pattern)), F.left(pattern, i)))
    return F.when(F.length(pattern) > 0, F.array_sort(F.array_distinct(F.concat(turned, F.transform(turned, reverse_complement)))))


def contains_any(seq: Column, patterns: list[str]) -> Column:
    """Whether any of the patterns occurs; false for a null or too short sequence."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.contains(seq, F.lit(p))
    return F.coalesce(hit, F.lit(False))


def trimmed_length(qual: Column) -> Column:
    """Length that stays after the trailing qualities of '#' and below are cut."""
    return F.length(F.regexp_replace(qual, "[!-#]+$", ""))


def quality_trim(df: DataFrame) -> DataFrame:
    """Cut low qualities off the end of ``seq`` and ``qual``; reads with nothing left are dropped."""
    n = trimmed_length(F.col("qual"))
    return df.withColumn("_n", n).filter("_n > 0").withColumns({"seq": F.expr("left(seq, _n)"), "qual": F.expr("left(qual, _n)")}).drop("_n")


def wrapped(seq: Column, width: int = 70) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def rc_chain(chain: Column) -> Column:
    """A chain of signed node ids read from the other strand."""
    return F.transform(F.reverse(chain), lambda x: -x)


def canonical_chain(chain: Column) -> Column:
    return F.least(chain, rc_chain(chain))
