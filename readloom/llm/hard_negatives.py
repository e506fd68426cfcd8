"""Hard negatives by bit-sliced integer products.

Components become integers, and a block of rows becomes bit planes: for each bit of the integers, from the sign down, one
word of bits over the components of each row. An anchor's product with a plane is a sum of bit counts of ANDs with the
anchor's own planes. Planes are taken most significant first; after each, what the planes left can still add lies between
two sums over the anchor, so every row has an interval for its score, half as wide as before. Rows whose interval cannot
qualify are dropped: those outside all windows, and those below the fifth of the rows that are surely inside. The scores of
the rows that are left after the last plane are exact.

Positives are sought among the rows of the anchor's label, negatives among all others, both in pairs of blocks of rows and
of anchors, so no group grows with a label or with the table. Of each pair of blocks at most ``KEEP`` rows a window come
back; the best of these are taken.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; rows of the
anchor's own id are neither its positives nor its negatives; repeated equal rows are one anchor, but each is a positive or
negative of others; rows of one id that differ are anchors of their own; vectors are compared with those of equal length,
empty ones too (score 0); ties go to the smaller id; a positive with a negative score has no negatives, since its window is
empty; scores beyond the range of long are its ends; an anchor without positives, or a positive without negatives, has no
rows; an empty table gives an empty result; extra columns are ignored; there is no text, and vectors of many components
only widen rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .integer_vectors import exact_products, floored, matrix, paired, usable

SCALE, POSITIVES, KEEP = 256, 5, 5
#: A negative's score is at least so many hundredths of the positive's, and at most all of it.
SHARE = 80
ROWS, ANCHORS = 4_096, 4_096
_ALL = (-float("inf"), float("inf"))


@dataclass(frozen=True)
class Planes:
    """bits[t]: of each row, bit t of the components, 64 to a word; ``top`` is the sign's plane, which counts negative."""

    bits: np.ndarray
    top: int

    @classmethod
    def of(cls, whole: np.ndarray) -> Planes:
        values = whole.astype(np.int64)
        top = max(int(max(values.max(initial=0), -1 - values.min(initial=0))).bit_length(), 1)
        width = -(-values.shape[1] // 64) * 64
        bits = np.zeros((top + 1, len(values), width // 64), np.uint64)
        wide = np.zeros((len(values), width), np.uint8)
        for t in range(top + 1):
            wide[:, : values.shape[1]] = (values >> t) & 1
            bits[t] = np.packbits(wide, axis=1, bitorder="little").view(np.uint64)
        return cls(bits, top)

    def weight(self, t: int) -> int:
        return -(1 << t) if t == self.top else 1 << t


def with_plane(anchor: Planes, one: int, plane: np.ndarray) -> np.ndarray:
    """The products of anchor number ``one`` with rows of zeros and ones, from counts of common bits."""
    total = np.zeros(len(plane), np.int64)
    for s in range(anchor.top + 1):
        total += anchor.weight(s) * np.bitwise_count(plane & anchor.bits[s, one]).sum(axis=1, dtype=np.int64)
    return total


def survivors(anchor: Planes, one: int, whole: np.ndarray, rows: Planes, among: np.ndarray, windows: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows ``among`` those that may be one of the ``KEEP`` best inside a window, with their exact scores."""
    up, down = int(whole[whole > 0].sum()), int(whole[whole < 0].sum())
    so_far = np.zeros(len(among), np.int64)
    for t in range(rows.top, -1, -1):
        if not len(among):
            break
        so_far += rows.weight(t) * with_plane(anchor, one, rows.bits[t, among])
        rest = (1 << t) - 1
        low, high = so_far + rest * down, so_far + rest * up
        alive = np.zeros(len(among), bool)
        for least, most in windows:
            may, sure = (high >= least) & (low <= most), low[(low >= least) & (high <= most)]
            if len(sure) >= KEEP:
                may &= high >= np.partition(sure, -KEEP)[-KEEP]
            alive |= may
        among, so_far = among[alive], so_far[alive]
    return among, so_far


def _best(rows: pa.Table, anchors: pa.Table, negatives: bool) -> dict[str, np.ndarray]:
    """anchor_key, place of the window, vec_id and score of the ``KEEP`` best rows of each window of each anchor."""
    ids, x, y = rows.column("vec_id").to_numpy(), matrix(rows), matrix(anchors)
    (whole, tame), (own, own_tame) = floored(x, SCALE), floored(y, SCALE)
    planes, anchor_planes = Planes.of(whole), Planes.of(own)
    label = rows.column("label").to_numpy(zero_copy_only=False)
    keys, owners = anchors.column("anchor_key").to_numpy(), anchors.column("anchor_id").to_numpy()
    labels = anchors.column("label" if not negatives else "anchor_label").to_numpy(zero_copy_only=False)
    positives = anchors.column("positives").to_pylist() if negatives else [None] * len(keys)
    out: list[tuple[int, int, int, int]] = []
    for k in range(len(keys)):
        windows = [(-(-SHARE * p // 100), p) for p in positives[k]] if negatives else [_ALL]
        there = (ids != owners[k]) & ((label != labels[k]) if negatives else (label == labels[k]))
        sliced = there & tame if own_tame[k] else np.zeros(len(ids), bool)
        found, score = survivors(anchor_planes, k, own[k], planes, np.flatnonzero(sliced), windows)
        beyond = np.flatnonzero(there & ~sliced)
        if len(beyond):
            found, score = np.concatenate([found, beyond]), np.concatenate([score, exact_products(y[k], x[beyond], SCALE)])
        for place, (least, most) in enumerate(windows):
            inside = np.flatnonzero((score >= least) & (score <= most))
            best = inside[_order(score[inside], ids[found[inside]])]
            out += [(int(keys[k]), place, int(ids[found[i]]), int(score[i])) for i in best[:KEEP]]
    return dict(zip(("anchor_key", "place", "vec_id", "score"), np.array(out, np.int64).reshape(-1, 4).T, strict=True))


def _order(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Highest score first, then smallest id."""
    return np.lexsort((ids, ~score))


_SCHEMA = pa.schema([("anchor_key", pa.int64()), ("place", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FIELDS = "anchor_key long, place long, vec_id long, score long"


def _positives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    return pa.table(_best(rows, anchors, negatives=False), schema=_SCHEMA) if rows.num_rows and anchors.num_rows else _SCHEMA.empty_table()


def _negatives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    return pa.table(_best(rows, anchors, negatives=True), schema=_SCHEMA) if rows.num_rows and anchors.num_rows else _SCHEMA.empty_table()


def _first(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor_key", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(embeddings: DataFrame, is_anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of ``embeddings`` (vec_id,
    embedding, label) for which ``is_anchor`` (over vec_id) holds."""
    rows = usable(embeddings, "label").filter("label is not null").withColumn("deal", F.xxhash64("vec_id", "v"))
    anchors = rows.filter(is_anchor).select(F.col("vec_id").alias("anchor_id"), "v", "length", "label").distinct()
    anchors = cut(anchors.withColumn("anchor_key", F.monotonically_increasing_id()))
    dealt = anchors.withColumn("deal", F.col("anchor_key"))
    near = paired(rows, dealt, ["length", "label"], ROWS, ANCHORS).applyInArrow(_positives, _FIELDS)
    positives = cut(_first(near, POSITIVES).select("anchor_key", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    listed = positives.groupBy("anchor_key").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))  # five at most
    asking = anchors.join(listed, "anchor_key").select("anchor_key", "anchor_id", "v", "length", F.col("label").alias("anchor_label"), F.col("p.positive_score").alias("positives"), F.col("anchor_key").alias("deal"))
    hard = _first(paired(rows, asking, ["length"], ROWS, ANCHORS).applyInArrow(_negatives, _FIELDS), KEEP)
    hard = hard.select("anchor_key", (F.col("place") + 1).alias("place"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = hard.join(positives, ["anchor_key", "place"]).join(anchors.select("anchor_key", "anchor_id"), "anchor_key")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
