"""Substring dedup: repeated runs of ``WIDTH`` words, by prefix-partitioned suffix trees.

Every word of the corpus begins a suffix, and two suffixes meet in an inner node at depth ``WIDTH`` or deeper if they share
their first ``WIDTH`` words. The tree is never built in one place:

* A suffix's prefix reaches from its first word to the end of its anchor, the smallest-hashed run of ``ANCHOR`` words that
  begins within its first words, so prefixes have ``ANCHOR`` to ``WIDTH`` words. Suffixes that meet agree in them. A
  suffix whose anchor occurs once in the corpus is a leaf by itself and goes no further.
* All suffixes of an anchor go to one group. Neighbouring suffixes of a document mostly share their anchor, so a stretch of
  them travels as one row of words. Groups are dealt to parts of about ``PART_BYTES``. An anchor that alone has more
  stretches than ``HOT`` is not one group: its suffixes go by their prefix of all ``WIDTH`` words. Stretches of equal words
  are merged before a part is gathered, so it holds what differs, however common it is.
* A part names its words by numbers, sorts its suffixes by doubling the length that is compared up to ``WIDTH`` words, and so
  has its inner nodes of that depth. Of the leaves below a node only the first of the corpus stays.

A suffix that is not the first leaf of its node makes its first ``WIDTH`` words a repeat; runs of such suffixes are the
maximal repeats, and are cut out of the documents, which lie in blocks of about ``BLOCK_BYTES``. Hashes only choose
anchors and deal rows; words are compared as they are.

Words are the runs of characters other than space and TAB to CR, unchanged.

Defined cases: a null or blank text has no words; rows that share an id, or have none, are documents of their own, those
without id before all others, and are ordered by a hash of their text; equal rows are told apart too; texts of fewer than
``WIDTH`` words keep everything; a very long text is one document of one block, whole; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .word_hash import U, pieces, runs, words

WIDTH, ANCHOR = 20, 6
BLOCK_BYTES, PART_BYTES = 3_000_000, 8_000_000
#: Stretches of one anchor, counted once a block, above which its suffixes are dealt by all their words.
HOT = 20_000
_NO_ID = -(2**63)
_RANK = "doc_id long, tie long, block int, row int"


class _Suffixes:
    """The suffixes of a block that have ``WIDTH`` words, in document order: row, start and anchor, and the stretches of
    neighbours that share an anchor."""

    def __init__(self, rows: pa.Table):
        rows = rows.set_column(rows.schema.get_field_index("doc_id"), "doc_id", rows.column("doc_id").fill_null(_NO_ID))
        self.rows = rows.sort_by([("doc_id", "ascending"), ("tie", "ascending"), ("text", "ascending")])
        self.texts = [t or b"" for t in self.rows.column("text").cast(pa.binary()).to_pylist()]
        hashes, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for _, part in pieces(self.texts):
            w = words(part)
            hashes.append(w.hash)
            counts.append(w.count)
        self.count = np.concatenate(counts)
        word = np.concatenate(hashes)
        owner = np.repeat(np.arange(len(self.count)), self.count)
        first = np.cumsum(self.count) - self.count
        n = max(0, len(word) - WIDTH + 1)
        at = np.flatnonzero(owner[:n] == owner[WIDTH - 1 :]) if n else np.zeros(0, np.int64)
        self.row, self.start = owner[at], at - first[owner[at]]
        self.anchor = self._anchors(word)[at] if n else np.zeros(0, np.int64)
        self.hash = runs(word, WIDTH)[at] if n else np.zeros(0, U)
        new = np.ones(len(at), bool)
        new[1:] = (self.row[1:] != self.row[:-1]) | (self.anchor[1:] != self.anchor[:-1])
        self.head = np.flatnonzero(new)
        self.length = np.diff(np.concatenate((self.head, [len(at)])))

    @staticmethod
    def _anchors(word: np.ndarray) -> np.ndarray:
        low = runs(word, ANCHOR)
        span, have = WIDTH - ANCHOR + 1, 1
        while have < span:  # smallest of ever longer stretches
            step = min(have, span - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        return low.astype(np.int64)


_ANCHORS = pa.schema([("anchor", pa.int64()), ("block", pa.int32()), ("n", pa.int64())])


def _anchors(rows: pa.Table) -> pa.Table:
    """Anchors of a block with their number of stretches, and one more where suffixes of one stretch agree (a short period)."""
    s = _Suffixes(rows)
    found, n = np.unique(s.anchor[s.head], return_counts=True)
    order = np.argsort(s.hash)
    again = order[1:][s.hash[order[1:]] == s.hash[order[:-1]]]
    n[np.searchsorted(found, np.unique(s.anchor[again]))] += 1
    return pa.table([found, np.full(len(found), rows.column("block")[0].as_py(), np.int32), n], schema=_ANCHORS)


_STRETCHES = pa.schema([("anchor", pa.int64()), ("hot", pa.bool_()), ("words", pa.string()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("block", pa.int32()), ("row", pa.int32()), ("start", pa.int32())])


def _stretches(rows: pa.Table, shared: pa.Table) -> pa.Table:
    """The stretches whose anchor occurs elsewhere too; of equal ones of a block the first, as the others follow it."""
    if not rows.num_rows or not shared.num_rows:
        return _STRETCHES.empty_table()
    s = _Suffixes(rows)
    block = rows.column("block")[0].as_py()
    hot = dict(zip(shared.column("anchor").to_pylist(), shared.column("hot").to_pylist(), strict=True))
    some = np.flatnonzero(np.isin(s.anchor[s.head], shared.column("anchor").to_numpy()))
    ids, ties = s.rows.column("doc_id").to_numpy(), s.rows.column("tie").to_numpy()
    seen, out, at_row, part = set(), [], -1, []
    for k in some.tolist():
        head, length = s.head[k], int(s.length[k])
        row, start, anchor = int(s.row[head]), int(s.start[head]), int(s.anchor[head])
        if row != at_row:
            at_row, part = row, s.texts[row].split()
        is_hot = hot[anchor]
        # the suffixes of a hot anchor travel one by one, so that equal ones are merged
        for begin, size in ((start + i, 1) for i in range(length)) if is_hot else ((start, length),):
            text = b" ".join(part[begin : begin + size + WIDTH - 1])
            if text not in seen:
                seen.add(text)
                out.append((anchor, is_hot, text.decode(), ids[row], ties[row], block, row, begin))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _STRETCHES, strict=True)], schema=_STRETCHES) if out else _STRETCHES.empty_table()


_FIRSTS = pa.schema([("block", pa.int32()), ("row", pa.int32()), ("start", pa.int32())])


def _inner_nodes(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of the inner node of depth ``WIDTH`` that the suffix at each place of ``at`` hangs below.

    Ranks of the first 1, 2, 4, ... words are joined in pairs until they cover ``WIDTH`` words; equal ranks are equal words.
    """
    rank, have = word, 1
    while have < WIDTH:
        step = min(have, WIDTH - have)
        pair = rank[: len(rank) - step] * (rank.max() + 1) + rank[step:]
        rank, have = np.unique(pair, return_inverse=True)[1].reshape(-1), have + step
    return rank[at]


def _first_leaves(rows: pa.Table) -> pa.Table:
    """Of the suffixes of a part, the first leaf of each inner node."""
    rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "tie", "block", "row", "start")])
    number: dict[str, int] = {}
    found = [[number.setdefault(w, len(number)) for w in text.split(" ")] for text in rows.column("words").to_pylist()]
    size = np.fromiter(map(len, found), np.int64, len(found))
    word = np.fromiter((w for f in found for w in f), np.int64, int(size.sum()))
    suffixes = size - WIDTH + 1
    place = np.arange(suffixes.sum()) - np.repeat(np.cumsum(suffixes) - suffixes, suffixes)
    stretch = np.repeat(np.arange(len(found)), suffixes)
    node = _inner_nodes(word, (np.cumsum(size) - size)[stretch] + place)
    first = np.sort(np.unique(node, return_index=True)[1])  # suffixes are in the order of the corpus
    stretch, place = stretch[first], place[first]
    block, row, start = (rows.column(c).to_numpy()[stretch] for c in ("block", "row", "start"))
    return pa.table([block, row, (start + place).astype(np.int32)], schema=_FIRSTS)


def _cutter(fields: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def cut_out(rows: pa.Table, news: pa.Table) -> pa.Table:
        """``news`` has the block's shared anchors (anchor), and those suffixes of them that are first leaves (row, start)."""
        if not rows.num_rows:
            return fields.empty_table()
        s = _Suffixes(rows)
        anchor = news.column("anchor").drop_null().to_numpy()
        firsts = news.filter(news.column("anchor").is_null())
        base = np.cumsum(s.count) - s.count
        kept_first = base[firsts.column("row").to_numpy()] + firsts.column("start").to_numpy() if firsts.num_rows else np.zeros(0, np.int64)
        repeat = np.isin(s.anchor, anchor) & ~np.isin(base[s.row] + s.start, kept_first)
        bounds = np.searchsorted(s.row, np.arange(len(s.count) + 1))
        kept, removed, spans = [], [], []
        for k, text in enumerate(s.texts):
            part = text.split()
            starts = s.start[bounds[k] : bounds[k + 1]][repeat[bounds[k] : bounds[k + 1]]]
            found, gone = [], 0
            if len(starts):
                cover = np.zeros(len(part) + 1, np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + WIDTH, -1)
                dropped = np.cumsum(cover)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], dropped, [False]))))
                found = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
                gone = int(dropped.sum())
                part = [w for w, g in zip(part, dropped.tolist(), strict=True) if not g]
            spans.append(found)
            removed.append(gone)
            kept.append(b" ".join(part))
        ids = s.rows.column("doc_id")
        ids = pa.compute.if_else(pa.compute.equal(ids, _NO_ID), pa.scalar(None, pa.int64()), ids)
        return pa.table([ids, pa.array(s.count), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, fields.field("spans").type)], schema=fields)

    return cut_out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept (the words that stay, joined by
    one space), spans (start and end of the removed runs, in words)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # the partition keeps equal rows apart that many files hold
    place = F.xxhash64("doc_id", "text", F.spark_partition_id())
    blocks = slim.select(F.pmod(place, F.lit(max(1, -(-size // BLOCK_BYTES)))).cast("int").alias("block"), "doc_id", F.xxhash64("text").alias("tie"), "text")
    anchors = blocks.groupBy("block").applyInArrow(_anchors, "anchor long, block int, n long")
    every = Window.partitionBy("anchor")
    shared = anchors.withColumn("all", F.sum("n").over(every)).filter("all > 1").select("block", "anchor", (F.col("all") > HOT).alias("hot"))
    found = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_stretches, f"anchor long, hot boolean, words string, {_RANK}, start int")
    parts = max(1, -(-2 * size // PART_BYTES))
    key = F.when(F.col("hot"), F.xxhash64("words")).otherwise(F.xxhash64("anchor"))
    dealt = found.select(F.pmod(key, F.lit(parts)).cast("int").alias("part"), "words", F.struct("doc_id", "tie", "block", "row", "start").alias("rank")).repartition("part")
    merged = dealt.groupBy("part", "words").agg(F.min("rank").alias("rank")).select("part", "words", "rank.*")
    firsts = merged.groupBy("part").applyInArrow(_first_leaves, "block int, row int, start int")
    news = shared.select("block", "anchor", F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("start"))
    news = news.unionByName(firsts.withColumn("anchor", F.lit(None).cast("long")))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    fields = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", span)])
    return blocks.groupBy("block").cogroup(news.groupBy("block")).applyInArrow(_cutter(fields), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>")
