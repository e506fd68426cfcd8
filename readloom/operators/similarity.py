"""Similarity of read pairs: which pairs to compare, their overlap scores, and the networks made of them.

Pairs are compared where they share a node that is neither an error nor a repeat, so candidates come from an equi-join on
nodes whose coverage lies in a window. Overlap scores are dynamic programs over batches of string pairs in numpy, one
anti-diagonal at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH, MISMATCH, GAP = 1, -4, -7
LOWEST, HIGHEST, RUNS = 10.0, 20.0, 20


def overlap_scores(left: list[str], right: list[str], match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP) -> np.ndarray:
    """Best overlap score of each pair of strings: gaps at the front of either are free, and the best cell of the last row
    or column counts, at least 0."""
    n = len(left)
    if not n:
        return np.zeros(0, np.int64)
    la, lb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    a, b = (np.ascontiguousarray(_codes(x, int(size.max(initial=0)), fill).T) for x, size, fill in ((left, la, -1), (right, lb, -2)))
    high, wide = len(a), len(b)
    if max(a.max(initial=0), b.max(initial=0)) < 128:
        a, b = a.astype(np.int8), b.astype(np.int8)
    # letters are rows, pairs of strings columns, so a diagonal is a block of rows; cell (i, j) of diagonal d = i + j stands at
    # place j + 1, borders are 0 and are never written
    kind = np.int16 if (high + wide + 2) * max(abs(match), abs(mismatch), abs(gap)) < 1 << 15 else np.int64
    before, last, now = (np.zeros((wide + 2, n), kind) for _ in range(3))
    best, back, even = np.zeros(n, kind), a[::-1], (la == high).all() and (lb == wide).all()
    for d in range(2, high + wide + 1):
        low, top = max(1, d - high), min(wide, d - 1)
        if low > top:
            continue
        cells = np.multiply(back[high - d + low : high - d + top + 1] == b[low - 1 : top], match - mismatch, dtype=kind)
        cells += mismatch
        cells += before[low : top + 1]
        beside = np.maximum(last[low : top + 1], last[low + 1 : top + 2])
        beside += gap
        np.maximum(cells, beside, out=now[low + 1 : top + 2])
        if even:  # only the ends of a diagonal can lie in the last row or column
            if d > high:
                np.maximum(best, now[low + 1], out=best)
            if top == wide:
                np.maximum(best, now[top + 1], out=best)
        else:
            j = np.arange(low, top + 1)[:, None]
            edge = (((d - j) == la) & (j <= lb)) | ((j == lb) & ((d - j) <= la))
            np.maximum(best, np.where(edge, now[low + 1 : top + 2], 0).max(axis=0), out=best)
        before, last, now = last, now, before
    return best.astype(np.int64)


def _codes(texts: list[str], wide: int, fill: int) -> np.ndarray:
    out = np.full((len(texts), wide), fill, np.int32)
    for k, text in enumerate(texts):
        out[k, : len(text)] = np.frombuffer(text.encode("utf-32-le"), np.int32)
    return out


_SWAP = str.maketrans("ACGTacgt", "TGCAtgca")


def pair_scores(p1: list[str], p2: list[str], q1: list[str], q2: list[str]) -> np.ndarray:
    """Best score of two read pairs: both mates, or one mate of each crosswise, with the first pair as it is and with it
    read from the other strand."""
    back1, back2 = [x.translate(_SWAP)[::-1] for x in p2], [x.translate(_SWAP)[::-1] for x in p1]
    best = np.zeros(len(p1), np.int64)
    for a, b in ((p1, p2), (back1, back2)):
        for score in (overlap_scores(a, q1) + overlap_scores(b, q2), overlap_scores(b, q1), overlap_scores(a, q2)):
            best = np.maximum(best, score)
    return best


def _pair_score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            scores = pair_scores(*([x or "" for x in part.column(c).to_pylist()] for c in ("p1", "p2", "q1", "q2")))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(scores, pa.int64())], ["a", "b", "score"])


def optimal_cluster_size(length: float, k: int, coverage: float) -> int:
    """Reads that one place of the genome should give: k-mers without an error, at a given coverage."""
    return int(math.floor(0.98**k * (length - k + 1) * coverage / length + 0.5))


def first_window(length: float, k: int, coverage: float) -> tuple[float, float, float]:
    """Bounds of node coverage, and how far the upper one may be widened: around half of what the size gives when the
    factor of error-free k-mers is applied to it again."""
    most = optimal_cluster_size(length, k, optimal_cluster_size(length, k, coverage))
    half = most / 2
    spread = 3 * math.sqrt(max(half, 0.0))
    return max(2.0, half - spread), min(float(most), half + spread), float(most)


def within_window(nodes: DataFrame, low: float, high: float) -> DataFrame:
    """Nodes (with ``avg_cov``) whose coverage, cut to an integer, lies strictly between the bounds."""
    return nodes.filter((F.floor("avg_cov") > low) & (F.floor("avg_cov") < high))


def coverage_window(nodes: DataFrame, members: DataFrame, low: float, high: float, most: float, total: int | None = None) -> tuple[float, float]:
    """Widen the upper bound by 1 until fewer than 2 % of the reads have no node inside, or ``most`` is reached.

    ``members`` has pair_id and node; ``total`` is the number of pairs, if not all of them are members of a node. What is collected is one row for each integer coverage up to ``most``, which gives the
    share at every bound at once: a pair is inside as soon as its lowest node above ``low`` is.
    """
    fit = nodes.filter(F.floor("avg_cov") > low).select("node", F.floor("avg_cov").alias("cov"))
    lowest = members.join(fit, "node").groupBy("pair_id").agg(F.min("cov").alias("cov"))
    total = members.select("pair_id").distinct().count() if total is None else total
    counts = dict(lowest.filter(F.col("cov") < most).groupBy("cov").count().collect())
    while high < most and sum(n for c, n in counts.items() if c < high) <= 0.98 * total:
        high += 1
    return low, high


def candidate_pairs(members: DataFrame) -> DataFrame:
    """a, b (a < b) of pairs that share a node; ``members`` has pair_id and node.

    A node inside the coverage window has at most that many reads, so no group of the join is large.
    """
    one = members.select("node", F.col("pair_id").alias("a")).distinct()
    other = members.select("node", F.col("pair_id").alias("b")).distinct()
    return one.join(other, "node").filter("a < b").select("a", "b").distinct()


def similarities(candidates: DataFrame, pairs: DataFrame, average_length: int) -> DataFrame:
    """src, dst, sim: the pair score as a share of two average reads, in percent; only those above 0."""
    left = pairs.select(F.col("pair_id").alias("a"), F.upper("seq1").alias("p1"), F.upper("seq2").alias("p2"))
    right = pairs.select(F.col("pair_id").alias("b"), F.upper("seq1").alias("q1"), F.upper("seq2").alias("q2"))
    scored = candidates.join(left, "a").join(right, "b").select("a", "b", "p1", "p2", "q1", "q2").mapInArrow(_pair_score, "a long, b long, score long")
    return scored.select(F.col("a").alias("src"), F.col("b").alias("dst"), similarity(F.col("score"), average_length).alias("sim")).filter("sim > 0")


def similarity(score: Column, average_length: int) -> Column:
    return 100.0 * score / (2 * average_length)


def ladder(edges: DataFrame, runs: int = RUNS) -> DataFrame:
    """run, src, dst, sim: run i keeps what lies above the i-th of equal steps; weights are rounded to two places after the
    comparison."""
    step = (HIGHEST - LOWEST) / runs
    steps = edges.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return steps.filter(F.col("sim") > LOWEST + F.col("run") * step).select("run", "src", "dst", F.round("sim", 2).alias("sim"))
