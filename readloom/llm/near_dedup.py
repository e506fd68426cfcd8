"""Near-duplicate classes: BagMinHash signatures, bands, exact multiset overlap, connected components.

Words are the runs of characters other than space and TAB to CR, unchanged; a document is the multiset of its runs of
five words (fewer words: one run of all). Documents whose multisets have a weighted Jaccard similarity of 0.8 or more
are linked, and classes are the connected components of the links.

No step emits the pairs of a group. Equal texts collapse to one node first. A band's bucket is tied together by the
pairs of its members with one central member, each checked on the texts. What such a star leaves apart, that is buckets
which still hold several components, is compared block by block inside tasks, exactly: all nodes outside a bucket's largest
component with all nodes of the bucket. A block returns only a spanning forest of its links. So the rows that move grow
with the bucket, and with the product of both numbers over the size of a block.

Defined cases: a null or blank text (no word) is linked to nothing and is a class of its own row; equal texts are one
class even if their ids repeat; null ids keep their row, with the class of their text; ties in the choice of a centre or
of a class id go to the smaller value; a very long text is hashed and compared whole; extra columns, whatever their names
and types, are ignored by ``near_duplicates`` and kept by ``keep_first``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .bag_minhash import bands, overlap, shingle_bags, signatures
from .common import cut, unused
from .word_hash import U, pieces, words

REGISTERS, ROWS, SIMILARITY, BLOCK = 100, 5, 0.8, 256


def _node(text: Column) -> Column:
    return F.xxhash64(text)


def _has_word(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for begin, part in pieces(texts):
            w = words(part)
            keys = bands(signatures(shingle_bags(w), len(part), REGISTERS), ROWS).astype(np.int64)
            some = np.flatnonzero(w.count)
            node = batch.column("node").slice(begin, len(part)).take(pa.array(some))
            values = pa.array(keys[some].reshape(-1))
            offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * keys.shape[1])
            yield pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(offsets, values)], ["node", "bands"])


def _bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for _, part in pieces(texts):
        text, element, weight = shingle_bags(words(part))
        at = np.searchsorted(text, np.arange(len(part) + 1))
        out += [(element[i:j], weight[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b) with both texts, those that are similar enough."""
    for batch in batches:
        left, right = ([x or b"" for x in batch.column(c).cast(pa.binary()).to_pylist()] for c in ("text_a", "text_b"))
        distinct = {t: k for k, t in enumerate(dict.fromkeys(left + right))}
        bags = _bags(list(distinct))
        ok = [overlap(bags[distinct[x]], bags[distinct[y]]) >= SIMILARITY for x, y in zip(left, right, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _forest(n: int, pairs: np.ndarray) -> list[int]:
    """Indices of the pairs that join two trees, taken in order."""
    top, kept = list(range(n)), []
    for at, (i, j) in enumerate(pairs.tolist()):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        while top[j] != j:
            top[j] = top[top[j]]
            j = top[j]
        if i != j:
            top[max(i, j)] = min(i, j)
            kept.append(at)
    return kept


def _block_links(rows: pa.Table) -> pa.Table:
    """A spanning forest of the links between two blocks of a bucket; a node may stand in both."""
    rows = rows.sort_by("node")
    node, component, side = (rows.column(c).to_numpy() for c in ("node", "component", "side"))
    bags = _bags(rows.column("text").cast(pa.binary()).to_pylist())
    sizes = np.array([b[1].sum() for b in bags])
    texts = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    element, weight = (np.concatenate([b[k] for b in bags]) for k in (0, 1))
    # units that two texts share are sums over weight levels: products of 0-1 grids of (text, shingle), in slices
    order = np.lexsort((texts, element))
    texts, element, weight = texts[order], element[order], weight[order]
    length = np.diff(np.concatenate((np.flatnonzero(np.concatenate(([True], element[1:] != element[:-1]))), [len(element)])))
    run = np.repeat(np.arange(len(length)), length)
    common = np.zeros((len(bags), len(bags)))
    low = 0
    for high in np.unique(weight):
        there = (weight >= high) & (length[run] > 1)
        used, column = np.unique(run[there], return_inverse=True)
        for c in range(0, len(used), 4096):
            part = (column >= c) & (column < c + 4096)
            grid = np.zeros((len(bags), min(4096, len(used) - c)), np.float32)
            grid[texts[there][part], column[part] - c] = 1
            common += (high - low) * (grid @ grid.T).astype(float)
        low = high
    near = np.triu(common / (sizes[:, None] + sizes[None, :] - common) >= SIMILARITY, 1) & (component[:, None] != component[None, :])
    near &= side[:, None] != side[None, :]
    pairs = np.argwhere(near)
    pairs = pairs[_forest(len(bags), pairs)]
    return pa.table({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def components(links: DataFrame) -> DataFrame:
    """Component (its smallest node) of every node that has a link; ``links`` has a and b.

    Smallest neighbouring labels with pointer jumping; every round is cut, and rounds end when no label changes.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n")).select("node", F.least("node", "n").alias("component")))
    while True:
        nearest = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        step = label.join(nearest, "node").select("node", "component", F.least("component", "seen").alias("low"))
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = cut(step.join(jump, "low", "left").select("node", F.least("low", "lower").alias("component"), F.col("component").alias("was")))
        if new.filter("component <> was").limit(1).count() == 0:
            return new.select("node", "component")
        label = new.select("node", "component")


def _stars(member: DataFrame) -> DataFrame:
    """For each node, up to two central members of its buckets, those that share most buckets with it first."""
    count = member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = member.join(count, "bucket")
    central = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    hub = shared.select("bucket", "node").join(central, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("top"))
    hub = hub.select("bucket", F.col("top.node").alias("hub"))
    pair = member.join(hub, "bucket").filter("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("times"))
    best = pair.groupBy("node").agg(F.max(F.struct("times", "hub")).alias("one"))
    other = pair.join(best, "node").filter("hub <> one.hub").groupBy("node").agg(F.max(F.struct("times", "hub")).alias("two"))
    return best.select("node", F.col("one.hub").alias("hub")).union(other.select("node", "two.hub"))


def _verified(pairs: DataFrame, text: DataFrame) -> DataFrame:
    left, right = text.select(F.col("node").alias("a"), F.col("text").alias("text_a")), text.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_linked, "a long, b long")


def text_classes(docs: DataFrame) -> DataFrame:
    """The linked nodes (64-bit hashes of texts) with their component; a node without a link has no row."""
    base = docs.select(_node(F.col("text")).alias("node"), "text").filter("text is not null")
    member = cut(base.mapInArrow(_band_keys, "node long, bands array<long>").groupBy("node").agg(F.first("bands").alias("bands")))
    member = member.select("node", F.explode("bands").alias("bucket"))
    stars = cut(_stars(member))
    shared = member.join(member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "bucket").select("bucket", "node")
    nodes = shared.select("node").distinct()
    text = cut(base.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    links = cut(_verified(stars.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), text))
    first = components(links)
    # buckets with more than one component, block against block
    placed = shared.join(first, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("m"))
    # two nodes of different components are never both in the bucket's largest one, so the others meet all, and only they
    open_ = parts.groupBy("bucket").agg(F.sum("m").alias("n"), F.max("m").alias("most"), F.max_by("component", F.struct("m", "component")).alias("major")).filter("n > most")
    rest = cut(placed.join(open_.select("bucket", "n", (F.col("n") - F.col("most")).alias("others"), "major"), "bucket"))
    block = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    blocks, other_blocks = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n", "others"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    one = rest.filter("component <> major").select("bucket", "node", "component", block(7, other_blocks).alias("i"), each(blocks).alias("j"), F.lit(0).alias("side"))
    all_ = rest.select("bucket", "node", "component", each(other_blocks).alias("i"), block(9, blocks).alias("j"), F.lit(1).alias("side"))
    spread = one.unionByName(all_).join(text, "node").groupBy("bucket", "i", "j").applyInArrow(_block_links, "a long, b long")
    more = cut(spread.distinct())
    return components(links.union(more))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id long, text string): doc_id, class_id (the smallest doc_id of its class)
    and class_size (rows of the class)."""
    slim = docs.select("doc_id", _node(F.col("text")).alias("node"), _has_word(F.col("text")).alias("some"))
    return _classed(slim, text_classes(docs))


def _classed(slim: DataFrame, linked: DataFrame) -> DataFrame:
    placed = slim.join(linked, "node", "left").select("doc_id", "some", F.coalesce("component", "node").alias("component"))
    size = placed.filter("some").groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    joined = placed.join(size.withColumn("some", F.lit(True)), ["component", "some"], "left")
    return joined.select("doc_id", F.when(F.col("some"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest (doc_id, text hash); blank texts all stay."""
    mark = _has_word(F.col("text"))
    key, w_id, w_node, twin = unused(docs, "key", "w_id", "w_node", "twin")
    marked = docs.filter(mark).withColumn(key, _node(F.col("text")))
    slim = marked.select("doc_id", F.col(key).alias("node"))
    placed = slim.join(text_classes(docs), "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
    winner = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("w")).select(F.col("w.doc_id").alias(w_id), F.col("w.node").alias(w_node))
    kept = marked.join(winner, F.col("doc_id").eqNullSafe(F.col(w_id)) & (F.col(key) == F.col(w_node)), "left_semi")
    # rows that agree in id and text are told apart by all that they hold; maps and variants have no order and count as text
    others = [F.col(f"`{f.name}`") if _ordered(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    order = Window.partitionBy("doc_id", key).orderBy(*others or [F.lit(1)])
    kept = kept.withColumn(twin, F.row_number().over(order)).filter(F.col(twin) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(docs.filter(~mark))


def _ordered(kind: DataType) -> bool:
    return not any(word in kind.simpleString() for word in ("map<", "variant", "interval"))
