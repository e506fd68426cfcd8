"""Maximal exact matches of reads against the nodes of a graph, and the seeds made of them.

Both sides are cut into words of the least length. Words that are equal lie on a diagonal of a read and a node; on it a run
of neighbouring words is one match that no letter extends. So matches are the islands of an equi-join, without an index of
all suffixes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import explode_kmers, reverse_complement


def maximal_matches(reads: DataFrame, nodes: DataFrame, least: int, *keys: str) -> DataFrame:
    """keys, node (signed), node_seq, n, node_first, read_first, len: the matches of ``least`` letters or more between reads
    (keys, seq) and nodes (id, seq, n) on either strand. ``node_seq`` is the node's kept sequence."""
    if not 1 <= least <= 31:
        raise ValueError("words have 1 to 31 letters")
    code = F.conv(F.translate("kmer", "ACGT", "0123"), 4, 10).cast("long")
    own = nodes.select(F.col("id").alias("node"), "seq", F.col("seq").alias("node_seq"), "n")
    both = own.unionByName(own.withColumns({"node": -F.col("node"), "seq": reverse_complement(F.col("seq"))}))
    there = explode_kmers(both, least).select("node", "node_seq", "n", F.col("pos").alias("node_pos"), code.alias("code"))
    here = explode_kmers(reads.select(*keys, "seq"), least).select(*keys, "pos", code.alias("code"))
    met = here.join(there, "code").withColumn("diagonal", F.col("node_pos") - F.col("pos"))
    line = Window.partitionBy(*keys, "node", "diagonal").orderBy("pos")  # as long as a read at most
    runs = met.withColumn("run", F.col("pos") - F.row_number().over(line))
    found = runs.groupBy(*keys, "node", "diagonal", "run").agg(F.first("node_seq").alias("node_seq"), F.first("n").alias("n"), F.min("node_pos").alias("node_first"), F.min("pos").alias("read_first"), (F.count("*") + least - 1).cast("int").alias("len"))
    return found.drop("diagonal", "run")


def exact_seeds(reads: DataFrame, nodes: DataFrame, k: int, *keys: str, least: int = 16, enough: int = 100, most: int = 10) -> DataFrame:
    """keys, node (signed), node_seq, node_first, first, end: up to ``most`` seeds of each read, the longest first.

    The length asked of a match shrinks from k - 1 to ``least`` until a read has ``enough`` matches, which is the length of
    its match number ``enough`` within these bounds. Matches that begin in a node's last k - 1 letters, which its neighbours
    hold too, or in the read's are left out. Matches that follow each other in a node on one diagonal are one seed. Of equal
    lengths the smaller place in the read goes first, then in the node, then the smaller sequence, then the kept strand.
    ``end`` is what a seed of whole k-mers would have: k - 1 letters less, but at least one place.
    """
    found = maximal_matches(reads, nodes, least, *keys)
    ranked = found.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("len"))))
    asked = F.greatest(F.lit(least), F.least(F.lit(k - 1), F.coalesce(F.max(F.when(F.col("nth") == enough, F.col("len"))).over(Window.partitionBy(*keys)), F.lit(least))))
    fit = ranked.withColumn("asked", asked).filter("len >= asked and node_first < n").drop("nth", "asked")
    size = reads.select(*keys, (F.length("seq") - k + 1).alias("places"))
    fit = fit.join(size, list(keys)).filter("read_first < places")
    order = Window.partitionBy(*keys, "node").orderBy("node_first", "read_first")
    diagonal = F.col("node_first") - F.col("read_first")
    parted = fit.withColumn("new", (~F.coalesce(diagonal == F.lag(diagonal).over(order), F.lit(False))).cast("int"))
    parted = parted.withColumn("seed", F.sum("new").over(order))
    merged = parted.groupBy(*keys, "node", "seed").agg(F.first("node_seq").alias("node_seq"), F.min("node_first").alias("node_first"), F.min("read_first").alias("first"), F.max_by(F.col("read_first") + F.col("len"), F.col("node_first")).alias("end"))
    best = Window.partitionBy(*keys).orderBy(F.desc(F.col("end") - F.col("first")), "first", "node_first", "node_seq", F.desc("node"))
    top = merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    end = F.col("end") - F.least(F.lit(k - 1), F.col("end") - F.col("first") - 1)
    return top.select(*keys, "node", "node_seq", "node_first", "first", end.alias("end"), "rank")
