"""Periodic runs of words by bit-parallel lags.

A document's words are numbered as they first occur, and each bit of these numbers becomes one big integer with a bit a
word. For a lag q, XOR of a plane with itself shifted by q marks the words that differ from the word q places on in that
bit; OR over the planes marks all that differ. Runs of period q are the long stretches without a mark. They are isolated
by doubling: ANDing the unmarked places with themselves shifted by 1, 2, 4, ... leaves the places from which a long enough
stretch starts. After a plane or two nothing is left at most lags, and the other planes are not looked at.

A stretch has the smallest period q unless the same stretch was found at a smaller lag: a run is at least four periods
long, so two periods of it have their greatest common divisor as a period too.

Each document is one row of a map over Arrow batches: nothing is shuffled, and a task holds the planes of one document at a
time. Lags up to a quarter of the words are compared, 64 words to a machine word, so time grows with the square of a text's
length over some hundreds.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; very long texts are read whole; a
null id stays null; repeated rows and ids are rows of their own; extra columns are ignored; an empty table gives an empty
result; runs are listed by start, then period, so ties have one order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Texts that are turned into Python strings at a time.
STEP = 256
_WORDS = re.compile(WORD)


def bit_planes(words: list[str]) -> list[int]:
    """One integer for each bit of the words' numbers; bit i of it belongs to word i."""
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    return [int.from_bytes(np.packbits((ids >> t & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for t in range((len(number) - 1).bit_length())]


def long_stretches(same: int, least: int) -> int:
    """The places from which ``least`` bits in a row are set."""
    have = 1
    while same and have < least:
        step = min(have, least - have)
        same &= same >> step
        have += step
    return same


def _edges(starts: int) -> list[tuple[int, int]]:
    """First and last place of each group of adjacent bits."""
    change = starts ^ (starts << 1)
    at = np.flatnonzero(np.unpackbits(np.frombuffer(change.to_bytes(-(-change.bit_length() // 8), "little"), np.uint8), bitorder="little"))
    return [(int(a), int(b) - 1) for a, b in at.reshape(-1, 2)]


def runs_of(words: list[str]) -> list[tuple[int, int, int]]:
    """start, length, period of every run, by start, then period."""
    n = len(words)
    if n < LEAST_WORDS:
        return []
    planes = bit_planes(words)
    every = (1 << n) - 1
    found: dict[tuple[int, int], int] = {}
    for lag in range(1, n // LEAST_PERIODS + 1):
        least = max(LEAST_WORDS, LEAST_PERIODS * lag) - lag
        every >>= 1
        differ, starts = 0, -1
        for plane in planes:
            differ |= plane ^ (plane >> lag)
            starts = long_stretches((differ & every) ^ every, least)
            if not starts:
                break
        if starts == -1:  # one word, again and again
            starts = long_stretches(every, least)
        if starts:
            for first, last in _edges(starts):
                found.setdefault((first, last + least + lag), lag)
    return sorted((start, end - start, lag) for (start, end), lag in found.items())


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, covered in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not covered]


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period) and collapsed (kept words joined by one space), row by row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                sizes, runs, kept = [], [], []
                for text in part.column("text").to_pylist():
                    words = _WORDS.findall(text or "")
                    own = runs_of(words)
                    sizes.append(len(words))
                    runs.append([{"start": a, "length": b, "period": c} for a, b, c in own])
                    kept.append(" ".join(collapse(words, own)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(over, schema)


def strongest(runs: Column) -> Column:
    """The first of the runs with the greatest length over period, compared as fractions; null if there is none."""
    greater = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(greater(x, best), x).otherwise(best))


def planted(doc_id: Column, text: Column) -> Column:
    """A text with the periodic tail that the query's contract plants in a tenth of the documents, chosen by id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(place, lambda i: F.get(words, at(i).cast("int"))), " ")).otherwise("")

    own = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.when(text.isNotNull() & (h % 10 == 0), let(own, tail)).otherwise(text)
