"""k-mer analytics: counts, spectra, annotation and extension masks. Everything is a group-by with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import canonical, explode_kmers, reverse_complement


def count_kmers(reads: DataFrame, k: int, *group: str) -> DataFrame:
    """Canonical k-mers with their number of occurrences ``n``, within the columns of ``group``."""
    kmers = explode_kmers(reads.select(*group, "seq"), k).select(*group, canonical(F.col("kmer")).alias("kmer"))
    return kmers.groupBy(*group, "kmer").agg(F.count("*").alias("n"))


def saturated(counts: DataFrame, most: int = 65_535) -> DataFrame:
    return counts.withColumn("n", F.least("n", F.lit(most).cast("long")))


def spectrum(counts: DataFrame) -> DataFrame:
    """cov, n_kmers: how many k-mers occur how often; bin 1 holds what lies outside the table, so nothing here."""
    bins = counts.groupBy(F.col("n").alias("cov")).agg(F.count("*").alias("n_kmers"))
    return bins.withColumn("n_kmers", F.when(F.col("cov") == 1, F.lit(0).cast("long")).otherwise(F.col("n_kmers")))


def annotate(reads: DataFrame, frequencies: DataFrame, k: int, *keys: str) -> DataFrame:
    """The keys and, for each read, the frequencies of its k-mers in order (1 for unknown ones), joined by spaces."""
    placed = explode_kmers(reads.select(*keys, "seq"), k).select(*keys, "pos", canonical(F.col("kmer")).alias("kmer"))
    known = placed.join(frequencies.select("kmer", F.col("n").alias("freq")), "kmer", "left")
    listed = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("freq", F.lit(1).cast("long")).alias("freq")))).alias("f"))
    return listed.select(*keys, F.array_join(F.transform("f", lambda x: x["freq"].cast("string")), " ").alias("freqs"))


#: Bit of a base in an extension mask.
BIT = {"A": 1, "C": 2, "G": 4, "T": 8}


def _bit(base: Column) -> Column:
    return F.when(base == "A", 1).when(base == "C", 2).when(base == "G", 4).when(base == "T", 8)


def extension_masks(reads: DataFrame, k: int) -> DataFrame:
    """kmer (canonical), n, left_mask, right_mask: the bases seen next to it, from its own strand."""
    wide = explode_kmers(reads.select("seq"), k)
    before = F.when(F.col("pos") > 0, F.substring(F.col("seq"), F.col("pos"), F.lit(1)))
    after = F.when(F.col("pos") + k < F.length("seq"), F.substring(F.col("seq"), F.col("pos") + k + 1, F.lit(1)))
    own = wide.select("kmer", before.alias("before"), after.alias("after"))
    kept = F.col("kmer") <= reverse_complement(F.col("kmer"))
    flip = own.select(
        canonical(F.col("kmer")).alias("kmer"),
        F.coalesce(_bit(F.when(kept, F.col("before")).otherwise(F.translate("after", "ACGT", "TGCA"))), F.lit(0)).alias("l"),
        F.coalesce(_bit(F.when(kept, F.col("after")).otherwise(F.translate("before", "ACGT", "TGCA"))), F.lit(0)).alias("r"),
    )
    return flip.groupBy("kmer").agg(F.count("*").alias("n"), F.bit_or("l").alias("left_mask"), F.bit_or("r").alias("right_mask"))


def unique_extension(mask: Column) -> Column:
    return F.bit_count(mask) == 1


def cluster_statistics(counts: DataFrame, cluster: str) -> DataFrame:
    """Per cluster, from its k-mers that occur more than once: c (mean multiplicity, 2 places), genome (k-mers that occur
    more than twice), cutoff and k for the next round."""
    kept = counts.filter("n > 1").groupBy(cluster).agg(F.round(F.avg("n"), 2).alias("c"), F.count_if(F.col("n") > 2).alias("genome"))
    cutoff = F.when(F.col("genome") < 100, F.lit(1.0)).otherwise(F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.round((F.col("c") - 1) / F.ln("c"), 2))))
    k = (F.floor((F.col("c") - 5) / 6) * 5 + 15).cast("int")
    odd = F.when(k % 2 == 0, k - 1).otherwise(k)
    return kept.withColumn("cutoff", cutoff).withColumn("k", F.greatest(F.lit(15), F.least(F.lit(41), odd)))


def low_complexity_split(pairs: DataFrame, patterns: list[str]) -> DataFrame:
    """``pairs`` with ``low_complexity``: whether either mate holds one of the patterns."""
    from ..functions.sequence import contains_any

    return pairs.withColumn("low_complexity", contains_any(F.col("seq1"), patterns) | contains_any(F.col("seq2"), patterns))


def library_statistics(reads: DataFrame, *library: str) -> DataFrame:
    return reads.groupBy(*library).agg(F.count("*").alias("n_reads"), F.avg(F.length("seq")).alias("avg_len"))


def weighted_read_length(libraries: DataFrame) -> DataFrame:
    """Average read length over libraries; the sum of bases is cut to an integer first."""
    return libraries.agg((F.sum((F.col("avg_len") * F.col("n_reads")).cast("long")) / F.sum("n_reads")).alias("avg_len"))


def n50(nodes: DataFrame, k: int) -> DataFrame:
    """n_nodes, total_length and n50 (the length at which the ascending running sum reaches half) of ``seq`` lengths.

    The running sum goes over the distinct lengths only, of which there are far fewer than nodes.
    """
    by_length = nodes.groupBy((F.length("seq") - k + 1).alias("length")).agg(F.count("*").alias("m"))
    run = by_length.withColumn("upto", F.sum(F.col("length") * F.col("m")).over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)))
    total = by_length.agg(F.sum("m").alias("n_nodes"), F.sum(F.col("length") * F.col("m")).alias("total_length"))
    return run.join(F.broadcast(total)).filter(F.col("upto") * 2 >= F.col("total_length")).groupBy("n_nodes", "total_length").agg(F.min("length").alias("n50"))  # total is one row


def probe(queries: DataFrame, counts: DataFrame) -> DataFrame:
    """``queries`` (kmer) with found and multi: whether a k-mer, on either strand, is in ``counts``, and more than once."""
    known = counts.select(F.col("kmer").alias("own"), F.col("n").alias("known"))
    hit = queries.withColumn("own", canonical(F.col("kmer"))).join(known, "own", "left").drop("own")
    return hit.withColumns({"found": F.col("known").isNotNull(), "multi": F.coalesce(F.col("known") > 1, F.lit(False))}).drop("known")


def rates(counts: DataFrame) -> DataFrame:
    """sensitivity and specificity of ``counts`` (tp, fp, tn, fn), null without cases."""
    return counts.select((F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("sensitivity"), (F.col("tn") / F.nullif(F.col("tn") + F.col("fp"), F.lit(0))).alias("specificity"))
