"""Mixing sources to target sizes by balanced sampling with the cube method.

A source's target over its size is its rate, 0 to 2. Each of its documents is taken floor(rate) times outright and once
more with the rest of the rate as inclusion probability. Which documents get that extra copy is decided by the cube
method: the probabilities of a few documents at a time move along the null space of the balancing constraints (number
of documents and number of words) until one of them is 0 or 1. That keeps both totals exactly, chunk by chunk, and
leaves at most two undecided documents of each chunk; those of many chunks are gathered and moved again, until a source
has one chunk. From the last flight a ladder of documents is kept out: for each power of two the one whose size is nearest.
With the two that the flight leaves they are the landing problem, whose subset sums are dense from a word to the largest
document. Of all ways to take them the one nearest to the target is found by meeting in the middle; where none is within
half a word, each of these documents may also be taken one time less or more, 0 to 2 times in all. No document that the
flight decided is touched.

Chunks are cut by hashes and each is small, so a source that holds most rows is spread over many tasks. All choices come
from hashes of the rows, so reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; a source of size 0 has
target 0 and none of its documents is taken; a source's repeated rows are equal documents of their own; ids may repeat
or be null; a very long text is one document of its size, whole; ties are broken by hashes of the rows; an empty table
gives an empty result; extra columns are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, unused

SHARE = 1.5
MOST = 2.0
WEIGHTS = (3.0, 1.0, 2.0)
CHUNK = 2_000
#: Documents of a source at most, one for each power of two, that are left to the landing besides those that the flight leaves.
RUNGS = 24


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: one row a source; ``sized`` has source and size.

    A source's target is its weight's share of ``SHARE`` times all sizes, but at most ``MOST`` times its own size; what
    that leaves over is shared by weight among the others, again and again. The end of this is a level L with targets
    min(weight * L, MOST * size), found by going through the sources by size over weight: those before the first one
    that L does not fill are full.
    """
    size = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    size = size.withColumn("weight", F.element_at(weights, (F.row_number().over(order) - 1) % len(WEIGHTS) + 1))
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(0))
    steps = size.select(
        "source",
        "source_size",
        "weight",
        (F.sum("source_size").over(everything) * SHARE).alias("wanted"),
        (F.coalesce(F.sum("source_size").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * MOST).alias("before"),
        F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("left"),
    )
    level = (F.col("wanted") - F.col("before")) / F.col("left")
    steps = steps.withColumn("level", F.when(F.col("weight") * level <= MOST * F.col("source_size"), level))
    steps = steps.withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("weight") * F.col("level"), MOST * F.col("source_size"))
    return steps.select("source", "source_size", F.coalesce(target, MOST * F.col("source_size")).cast("double").alias("target"))


def flight(probability: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Move probabilities until at most two are strictly between 0 and 1, keeping their sum and their sum with sizes.

    Three undecided documents at a time: the null space of the constraints (1, 1, 1) and their sizes is their cross
    product. The step to either side is drawn so that each probability keeps its mean.
    """
    draw = np.random.default_rng(seed)
    p = probability.astype(float).copy()
    open_: list[int] = []
    for new in range(len(p)):
        if not 1e-9 < p[new] < 1 - 1e-9:
            p[new] = round(p[new])
            continue
        open_.append(new)
        if len(open_) < 3:
            continue
        i, j, k = open_
        u = (size[k] - size[j], size[i] - size[k], size[j] - size[i])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        ahead = min((1 - p[x]) / d if d > 0 else p[x] / -d for x, d in zip(open_, u, strict=True) if d)
        behind = min(p[x] / d if d > 0 else (1 - p[x]) / -d for x, d in zip(open_, u, strict=True) if d)
        step = ahead if draw.random() < behind / (ahead + behind) else -behind
        for x, d in zip(open_, u, strict=True):
            p[x] += step * d
        for x in open_[:]:
            if p[x] < 1e-9 or p[x] > 1 - 1e-9:
                p[x] = round(p[x])
                open_.remove(x)
    return p


def ladder(size: np.ndarray) -> list[int]:
    """For each power of two up to the largest size the place of the document whose size is nearest, each taken once."""
    left = {k: int(x) for k, x in enumerate(size) if x > 0}
    rungs = []
    for power in range(min(int(max(left.values(), default=0)).bit_length(), RUNGS)):
        if left:
            rungs.append(min(left, key=lambda k: abs(left[k] - (1 << power))))
            del left[rungs[-1]]
    return rungs


def _nearest_way(options: np.ndarray, size: np.ndarray, want: float) -> tuple[np.ndarray, float]:
    """How often to take each document, each one of ``options``, so that the words come nearest to ``want``, and by how much
    they miss it. All ways of one half are sorted, and each way of the other half looks up its best complement."""
    radix, half = len(options), len(size) // 2

    def sums(part: np.ndarray) -> np.ndarray:
        total = np.zeros(1)
        for s in part:
            total = (total[None, :] + options[:, None] * s).reshape(-1)  # the last document is the most significant digit
        return total

    def digits(way: int, n: int) -> list[float]:
        return [options[way // radix**k % radix] for k in range(n)]

    left, right = sums(size[:half]), sums(size[half:])
    order = np.argsort(right, kind="stable")
    at = np.searchsorted(right[order], want - left)
    pairs = [(np.abs(left + right[order[k]] - want), k) for k in (np.minimum(at, len(right) - 1), np.maximum(at - 1, 0))]
    side = int(pairs[1][0].min() < pairs[0][0].min())
    off, places = pairs[side]
    best = int(off.argmin())
    return np.array(digits(best, half) + digits(int(order[places[best]]), len(size) - half)), float(off[best])


def land(p: np.ndarray, size: np.ndarray, whole: int | None = None) -> np.ndarray:
    """Decide the undecided rows: those of the ladder and two more. They are taken 0 or 1 times more, whichever way comes
    nearest to the words that their probabilities stand for; if ``whole``, the times that every row is taken anyway, is given
    and no way comes within half a word, -whole to 2 - whole times. Decided rows stay as they are."""
    open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    if not len(open_):
        return np.round(p)
    want = float(p[open_] @ size[open_])
    way, off = _nearest_way(np.array([0.0, 1.0]), size[open_], want)
    if whole is not None and off > 0.5:
        wider, less = _nearest_way(np.arange(-whole, 3 - whole, dtype=float), size[open_], want)
        way = wider if less < off - 1e-6 else way
    p = p.copy()
    p[open_] = way
    return np.round(p)


def _seed(keys: list[int]) -> int:
    """From the row keys alone, so that reruns agree."""
    return int(np.bitwise_xor.reduce(np.array(keys, np.int64))) & 0x7FFFFFFF


def _fly(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("size", "descending"), ("row_key", "ascending"), ("p", "ascending")])  # what stays open is small
    size = np.array(rows.column("size").to_pylist(), np.int64)
    p = rows.column("p").to_numpy().copy()
    last = rows.column("last")[0].as_py()
    fly = np.setdiff1d(np.arange(len(p)), ladder(size) if last else [])
    p[fly] = flight(p[fly], size[fly].tolist(), _seed(rows.column("row_key").to_pylist()))
    if last:
        p = land(p, size.astype(float), rows.column("whole")[0].as_py())
    return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))


def balanced_extra(rows: DataFrame) -> DataFrame:
    """Decide p of each row (row_key, source_key, size, p, whole), balanced within each source_key: the whole number of times
    that it is taken besides ``whole``, 0 or 1 but for the few rows of a landing."""
    keep = ["row_key", "source_key", "size", "p", "whole"]
    schema = "row_key long, source_key long, size long, p double, whole long, chunk int, last boolean"
    decided = None
    todo = rows.select(*keep)
    while True:
        open_ = todo.filter("p > 0 and p < 1")
        counts = open_.groupBy("source_key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        spread = open_.join(counts, "source_key").select(*keep, F.pmod(F.xxhash64("row_key", F.lit(11)), F.col("chunks")).cast("int").alias("chunk"), (F.col("chunks") == 1).alias("last"))
        flown = cut(spread.groupBy("source_key", "chunk").applyInArrow(_fly, schema))
        part = flown.filter("not (p > 0 and p < 1)").select(*keep)
        decided = part if decided is None else decided.unionByName(part)
        todo = flown.select(*keep)
        if todo.filter("p > 0 and p < 1").limit(1).count() == 0:
            return decided


def mix(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken."""
    sized = cut(docs.select("doc_id", n_words(F.col("text")).alias("size"), "source"))
    # rows that agree in id, size and source are told apart by a running number
    twin = Window.partitionBy("doc_id", "size", "source").orderBy(F.lit(1))
    planned, times = _planned(sized.withColumn("row_key", F.xxhash64("doc_id", "size", "source", F.row_number().over(twin))))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with size, source_size, target and taken (repeats counted). Rows that
    agree in id, source and text are taken alike. A column of ``docs`` that has one of these names, in any case, is
    replaced; all others stay."""
    key = F.xxhash64("doc_id", "source", "text")
    sized = docs.select("doc_id", n_words(F.col("text")).alias("size"), "source", key.alias("row_key")).groupBy("row_key", "doc_id", "source").agg(F.sum("size").alias("size"), F.max("size").alias("one"))
    planned, times = _planned(cut(sized))
    (name,) = unused(docs, "row_key")
    taken = planned.select(F.col("row_key").alias(name), F.col("one").alias("size"), "source_size", "target", (F.col("one") * times).cast("long").alias("taken")).filter("taken > 0")
    clash = [c for c in docs.columns if c.lower() in ("size", "source_size", "target", "taken")]
    return docs.drop(*clash).withColumn(name, key).join(taken, name).drop(name)


def _planned(sized: DataFrame) -> tuple[DataFrame, Column]:
    """``sized`` (row_key, size, source and more) with source_size and target, and how many times each row is taken."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = source_targets(sized).withColumn("rate", rate)
    targets = targets.select("source", F.col("source_size").cast("long").alias("source_size"), "target", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"), F.xxhash64("source", F.lit(5)).alias("source_key"))
    planned = cut(sized.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s", "source"))
    extra = balanced_extra(planned).groupBy("row_key").agg(F.max("p").alias("extra"))
    return planned.join(extra, "row_key", "left"), F.col("whole") + F.coalesce(F.col("extra"), F.col("p")).cast("long")
