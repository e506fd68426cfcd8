"""Quality by compression: zstandard dictionaries of good and of bad text.

A text is cut into pieces of ``PIECE`` bytes, and each piece is compressed twice, once with a dictionary trained on good
and once with one trained on bad labelled text. What the pieces take in sum under either, and the difference of the two
sums over their total, is the text's normalised difference: positive where it is built like good text. A logistic curve
over this one number and its signed square, fitted on labelled texts that no dictionary has seen, turns it into a
calibrated score.

Dictionaries and curve are learnt from at most ``TRAIN_ROWS`` labelled ids outside the held-out fifth: half of them for
the dictionaries, half for the curve. A dictionary is trained on ``PIECES`` pieces of its side, those of the smallest
hash, wherever they lie in their texts; so what reaches the driver is bounded in bytes: 2 * PIECES * PIECE for the
dictionaries, and one number a row for the curve.

Defined cases: a null or empty text is scored like an empty string; a very long text is compressed piece by piece, whole;
unlabelled tables, or labels of one kind, give even odds; an empty ``documents`` gives an empty result; repeated rows and
ties are scored alike, each on its own; labels of a repeated id count once, the larger one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import calibration
from .common import held_out, labelled

TRAIN_ROWS = 8_000
PIECE, PIECES = 2048, 4_000
DICTIONARY = 110 * 1024
LEVEL = 3
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    curve: tuple[list[float], list[float], list[float]]


def pieces(text: bytes) -> list[bytes]:
    return [text[k : k + PIECE] for k in range(0, max(len(text), 1), PIECE)]


def dictionary(found: list[bytes]) -> bytes:
    """A dictionary trained on the pieces, of ``DICTIONARY`` bytes or, where they are too few or too uniform for that, of the
    largest half, quarter, ... that can be trained; where none can, the distinct pieces themselves, in the order of their
    hashes, as many as fit whole."""
    size = DICTIONARY
    while found and size >= 256:
        try:
            return zstandard.train_dictionary(size, found, k=min(PIECE, size // 2), d=8, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    kept, left = [], DICTIONARY
    for piece in dict.fromkeys(part for whole in found for part in pieces(whole)):
        if len(piece) <= left:
            kept.append(piece)
            left -= len(piece)
    return b"".join(kept)


class Compressor:
    def __init__(self, good: bytes, bad: bytes):
        self.sides = []
        for content in (good, bad):
            known = zstandard.ZstdCompressionDict(content or b"\n" * 8)  # a trained one is known by its magic number, which is no UTF-8
            known.precompute_compress(level=LEVEL)
            self.sides.append(zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_content_size=False))

    def difference(self, text: bytes) -> float:
        """(bad - good) / (bad + good) of the compressed sizes, -1 to 1."""
        good, bad = (sum(len(side.compress(p)) for p in pieces(text)) for side in self.sides)
        return (bad - good) / (bad + good)


def _side_pieces(rows: DataFrame, label: int) -> list[bytes]:
    """The ``PIECES`` pieces of the smallest hash of the texts of one label."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(xxhash.xxh64_intdigest(p, seed=n) >> 1, p) for t in batch.column("text").cast(pa.binary()).to_pylist() for n, p in enumerate(pieces(t)) if p]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([p for _, p in found], pa.binary())], ["key", "piece"])

    cut = rows.filter(F.col("label") == label).select("text").mapInArrow(cut_up, "key long, piece binary")
    return [bytes(r["piece"]) for r in cut.orderBy("key", "piece").limit(PIECES).collect()]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = labelled(docs, labels, "quality", TRAIN_ROWS).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(2)))
    good, bad = (dictionary(_side_pieces(rows.filter("half = 0"), side)) for side in (1, 0))
    if not good or not bad:
        return Model(good, bad, calibration.fit(np.zeros((0, 2)), np.zeros(0)))
    seen = differences(rows.filter("half = 1").select("label", "text", F.xxhash64("doc_id", "text").alias("key")), Model(good, bad, ([], [], [0.0])), "label int, key long")
    known = seen.orderBy("key", "difference").limit(TRAIN_ROWS).collect()
    both = len({r["label"] for r in known}) == 2
    x = np.array([[r["difference"], r["difference"] * abs(r["difference"])] for r in known] if both else [], float).reshape(-1, 2)
    return Model(good, bad, calibration.fit(x, np.array([r["label"] for r in known] if both else [], float)))


def differences(rows: DataFrame, model: Model, keys: str) -> DataFrame:
    """The columns named in ``keys`` (with types) and each row's normalised difference."""
    names = [k.split()[0] for k in keys.split(", ")]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressor(model.good, model.bad)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                values = pa.array([c.difference(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), values], [*names, "difference"])

    return rows.select(*names, "text").mapInArrow(compared, f"{keys}, difference double")


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and difference of every row of ``docs``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    found = differences(own, model, "doc_id long, held_out boolean")
    mean, scale, beta = model.curve
    powers = (F.col("difference"), F.col("difference") * F.abs("difference"))
    z = sum((b * (x - m) / s for b, x, m, s in zip(beta, powers, mean, scale, strict=False)), F.lit(beta[-1]))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return found.select("doc_id", "held_out", score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), "difference")
