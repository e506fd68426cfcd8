"""The whole run over read pairs: extract, compare, cluster, correct each cluster, put everything together again."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import canonical, explode_kmers, rotations
from ..operators import community, consensus, correction, kmers, similarity
from ..operators.iterate import cut

@dataclass(frozen=True)
class Config:
    pattern: str = "A" * 15
    coverage: float = 30.0
    k: int = 31
    read_length: int = 100
    runs: int = 20
    quality: str = "modularity"
    least_quality: float = 0.5
    smallest: int = consensus.SMALLEST
    largest: int = consensus.LARGEST
    seed: int = 1


def reads_of(pairs: DataFrame) -> DataFrame:
    """pair_id, mate, seq."""
    mates = F.array(F.struct(F.lit(1).alias("mate"), F.col("seq1").alias("seq")), F.struct(F.lit(2).alias("mate"), F.col("seq2").alias("seq")))
    return pairs.select("pair_id", F.explode(mates).alias("r")).select("pair_id", "r.mate", "r.seq")


def candidates(reads: DataFrame, config: Config) -> DataFrame:
    """a, b (a < b) of pairs that share a canonical k-mer whose coverage lies in the window of single-copy nodes: above
    errors, below repeats, and widened until nearly all pairs have such a k-mer.

    Only k-mers that any window can hold keep their members, so no k-mer gathers more pairs than the widest window allows.
    """
    low, high, most = similarity.first_window(config.read_length, config.k, config.coverage)
    placed = explode_kmers(reads.select("pair_id", "seq"), config.k).select("pair_id", canonical(F.col("kmer")).alias("node"))
    counts = placed.groupBy("node").agg(F.count("*").alias("avg_cov"))
    nodes = cut(counts.filter((F.col("avg_cov") > low) & (F.col("avg_cov") < most)))
    members = cut(placed.join(nodes.select("node"), "node", "left_semi").distinct())
    low, high = similarity.coverage_window(nodes, members, low, high, most, reads.select("pair_id").distinct().count())
    return similarity.candidate_pairs(members.join(similarity.within_window(nodes, low, high).select("node"), "node"))


def clusters(pairs: DataFrame, edges: DataFrame, config: Config) -> DataFrame:
    """pair_id, cluster_id (0: none): Louvain on all networks of the ladder at once, consensus of the runs that are good
    enough, and the size filter."""
    name = lambda c: community.keyed(F.col(c), F.col("run"), config.runs).alias(c)
    steps = cut(similarity.ladder(edges, config.runs).select(name("src"), name("dst"), F.col("sim").alias("w")))
    found = cut(community.flatten(community.louvain(steps, config.quality, config.seed, runs=config.runs)))
    values = community.quality(steps, found, config.quality, runs=config.runs).collect()  # a row a run
    good = [r["run"] if config.runs > 1 else 0 for r in values if r["quality"] is not None and r["quality"] > config.least_quality]
    nodes = pairs.select(F.col("pair_id").alias("node"))
    if not good:
        return nodes.select(F.col("node").alias("pair_id"), F.lit(0).cast("long").alias("cluster_id"))
    runs = community.unkeyed(found, config.runs, "node", "community").filter(F.col("run").isin(good))
    size = similarity.optimal_cluster_size(config.read_length, config.k, config.coverage)
    core = consensus.stable_core(nodes, consensus.coclustering(runs), size, len(good))
    return consensus.accepted_clusters(core.withColumnRenamed("node", "pair_id"), config.smallest, config.largest)


def correct(reads: DataFrame, config: Config) -> DataFrame:
    """cluster_id, pair_id, mate, seq, accepted, substitutions of reads (cluster_id, pair_id, mate, seq): one task a cluster.

    A cluster is below the accepted size, so it fits a task.
    """
    counts = kmers.count_kmers(reads, 41, "cluster_id")
    chosen = kmers.cluster_statistics(counts, "cluster_id").select("cluster_id", "k", "cutoff")
    whole = reads.join(chosen, "cluster_id", "left").fillna({"k": 15, "cutoff": 1.0})

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pair_id", "mate"])
        found = correction.correct_reads(rows["seq"].tolist(), int(rows["k"].iloc[0]), float(rows["cutoff"].iloc[0]))
        out = rows[["cluster_id", "pair_id", "mate"]].copy()
        out["seq"], out["accepted"], out["substitutions"] = zip(*found, strict=True)
        return out

    return whole.groupBy("cluster_id").applyInPandas(solve, "cluster_id long, pair_id long, mate int, seq string, accepted boolean, substitutions int")


def run(pairs: DataFrame, config: Config) -> DataFrame:
    """pair_id, mate, seq, cluster_id (null for pairs without the pattern), accepted: every read of ``pairs`` (pair_id,
    seq1, seq2) once."""
    split = cut(kmers.low_complexity_split(pairs.select("pair_id", "seq1", "seq2"), rotations(config.pattern)))
    low = split.filter("low_complexity").drop("low_complexity")
    edges = cut(similarity.similarities(candidates(reads_of(low), config), low, config.read_length))
    labels = cut(clusters(low, edges, config))
    labelled = reads_of(low).join(labels, "pair_id")
    corrected = correct(labelled.filter("cluster_id > 0"), config).select("pair_id", "mate", "seq", "cluster_id", "accepted")
    rest = labelled.filter("cluster_id = 0").select("pair_id", "mate", "seq", "cluster_id", F.lit(False).alias("accepted"))
    normal = reads_of(split.filter("not low_complexity")).select("pair_id", "mate", "seq", F.lit(None).cast("long").alias("cluster_id"), F.lit(False).alias("accepted"))
    return corrected.unionByName(rest).unionByName(normal)
