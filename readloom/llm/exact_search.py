"""Exact top-k search by integer inner product with a table of pivot distances.

With |q|, |x| and their distance d, the product q.x is (|q|^2 + |x|^2 - d^2) / 2. For every pivot p the distances of q and
of x to p differ by at most d, so the greatest such difference over many pivots is a lower bound of d, and gives an upper
bound of the product; one pivot is the origin, whose bound is |q||x|.

Rows are dealt into blocks by their nearest and second nearest pivot, large ones split by hash, and a block is one row of
the index: ids, integer vectors, norms, the precomputed distances of all its rows to all pivots, and the range of these.
A query first searches the block it lies in, and so knows a score that its list has at least. Ranges of distances then tell
which other blocks can hold a better row; only those are visited. In a block the rows are taken in the order of their
bounds, a batch at a time, until the next bound is below the K-th best score found.

Pivots are the most distant rows of a sample of ``SAMPLE`` rows by hash; they only decide how much is skipped, never what is
found. All pairs of blocks (queries with summaries of blocks, queries with a block) are groups of bounded size.

Defined cases: rows with a null id or vector, or with null or non-finite components, take no part; zero vectors do; rows of
the query's own id are its own; repeated equal rows are one query, but each a candidate; vectors are compared with those of
equal length, empty ones too (score 0); equal scores go to the smaller id; with fewer than K candidates all are returned;
vectors whose squared norm reaches ``TAME`` have no bounds: they are kept in blocks that every query visits, as queries they
visit every block, and are scored as Python integers; scores beyond the range of long are its ends; an empty table gives an
empty result; extra columns are ignored; there is no text, and vectors of many components only widen rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unused
from .integer_vectors import exact_products, floored, join_small, matrix, paired, usable

K, SCALE, PIVOTS, SAMPLE = 10, 1_024, 32, 2_048
#: Rows of a block, queries that visit it at a time, blocks whose summaries are looked at together, rows scored at a time.
BLOCK, QUERIES, SUMMARIES, BATCH = 4_096, 4_096, 4_096, 64
#: The block of rows without bounds has this number in place of pivots.
_WILD = -1


def choose_pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length in the sample: the origin, then rows that are farthest from all pivots before."""
    rows = vectors.select("v", "length").orderBy(F.xxhash64("deal"), "deal").limit(SAMPLE).collect()
    pivots = {}
    for length in sorted({r["length"] for r in rows}):
        known = [r["v"] for r in rows if r["length"] == length]
        x, tame = floored(np.array(known, float).reshape(len(known), length), SCALE)
        x, chosen = x[tame], [np.zeros(length)]
        far = (x * x).sum(axis=1)
        while len(chosen) < PIVOTS and far.max(initial=0.0) > 0:
            chosen.append(x[far.argmax()])
            far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(axis=1))
        pivots[length] = np.array(chosen)
    return pivots


def distances(whole: np.ndarray, pivots: dict[int, np.ndarray]) -> np.ndarray:
    p = pivots.get(whole.shape[1], np.zeros((1, whole.shape[1])))
    squares = (whole * whole).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * whole @ p.T
    return np.sqrt(np.maximum(squares, 0.0))


def place(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with ``block``: from the nearest pivot, the second nearest where more than a block share the first, and a
    hash where more than a block share both."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, length = batch.column("v"), batch.column("length").to_numpy()
            first, second = np.full(len(length), _WILD), np.full(len(length), _WILD)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                whole, tame = floored(lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n), SCALE)
                order = np.argsort(distances(whole, pivots), axis=1, kind="stable")
                first[at[tame]] = order[tame, 0]
                second[at[tame]] = order[tame, min(1, order.shape[1] - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32()), pa.array(second, pa.int32())], [*batch.schema.names, "first", "second"])

    rows = cut(vectors.mapInArrow(nearest, "vec_id long, v array<double>, length int, asks boolean, deal long, first int, second int"))
    fine = rows.groupBy("length", "first", "second").agg(F.count("*").alias("n"))
    cells = fine.groupBy("length", "first").agg(F.sum("n").alias("n_first"), F.collect_list(F.struct("second", "n")).alias("cells"))  # at most PIVOTS
    cells = cells.select("length", "first", "n_first", F.inline("cells"))
    whole = F.col("n_first") <= BLOCK
    cells = cells.select("length", "first", "second", F.when(whole, _WILD).otherwise(F.col("second")).alias("cell"), F.when(whole, 1).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int").alias("parts"))
    dealt = join_small(rows, cells, ["length", "first", "second"])
    part = F.pmod(F.xxhash64("deal", F.lit(7)), F.col("parts")).cast("long")
    block = ((F.col("first") + 1) * (PIVOTS + 1) + F.col("cell") + 1).cast("long") * F.lit(1 << 40) + part
    return dealt.select("vec_id", "v", "length", "asks", "deal", block.alias("block"))


_INDEX = pa.schema([("length", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("x", pa.binary()), ("away", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("norm", pa.float64()), ("wild", pa.bool_())])
_INDEX_FIELDS = "length int, block long, ids binary, x binary, away binary, low array<double>, high array<double>, norm double, wild boolean"


def build_index(placed: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """One row for each block; a wild block keeps its vectors as they are, and no distances."""

    def pack(rows: pa.Table) -> pa.Table:
        x = matrix(rows)
        whole, tame = floored(x, SCALE)
        wild = not tame.all()
        away = distances(whole, pivots)
        squares = (whole * whole).sum(axis=1)
        one = {"length": rows.column("length")[0].as_py(), "block": rows.column("block")[0].as_py(), "ids": rows.column("vec_id").to_numpy().tobytes()}
        one |= {"x": (x if wild else whole).tobytes(), "away": away.tobytes(), "low": away.min(axis=0).tolist(), "high": away.max(axis=0).tolist(), "norm": float(squares.max()), "wild": wild}
        return pa.Table.from_pylist([one], schema=_INDEX)

    return cut(placed.select("length", "block", "vec_id", "v").groupBy("length", "block").applyInArrow(pack, _INDEX_FIELDS))


def _slack(scale: np.ndarray) -> np.ndarray:
    """More than rounding can take from a bound."""
    return 1.0 + 1e-9 * scale


def best_of_block(query: np.ndarray, away: np.ndarray, own: int, floor: float, ids: np.ndarray, x: np.ndarray, squares: np.ndarray, block_away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of the K best rows of a block that reach ``floor``, best first."""
    norm = float(query @ query)
    apart = np.zeros(len(ids))
    for p in range(len(away)):
        np.maximum(apart, np.abs(block_away[:, p] - away[p]), out=apart)
    bound = (norm + squares - apart * apart) / 2 + _slack(norm + squares)
    bound[ids == own] = -np.inf
    order = np.flatnonzero(bound >= floor)
    order = order[np.argsort(-bound[order], kind="stable")]
    best_id, best = np.empty(0, np.int64), np.empty(0)
    at, size = 0, BATCH
    while at < len(order) and (bound[order[at]] > -np.inf):
        if len(best) == K and bound[order[at]] < best[-1]:
            break
        rows = order[at : at + size]
        rows = rows[bound[rows] > -np.inf]
        best_id, best = np.concatenate([best_id, ids[rows]]), np.concatenate([best, x[rows] @ query])
        top = np.lexsort((best_id, -best))[:K]
        best_id, best = best_id[top], best[top]
        at, size = at + size, 2 * size
    reach = best >= floor
    return best_id[reach], best[reach].astype(np.int64)


def _searched(pivots: dict[int, np.ndarray], least: bool):
    """A function for co-groups of one block of the index and queries that visit it; with ``least`` queries have a floor."""

    def search(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if blocks.num_rows and queries.num_rows:
            b = blocks.to_pylist()[0]
            ids = np.frombuffer(b["ids"], np.int64)
            x = np.frombuffer(b["x"], np.float64).reshape(len(ids), -1)
            block_away = np.frombuffer(b["away"], np.float64).reshape(len(ids), -1)
            squares = (x * x).sum(axis=1) if not b["wild"] else np.zeros(len(ids))
            y = matrix(queries)
            whole, tame = floored(y, SCALE)
            away, keys, owners = distances(whole, pivots), queries.column("query_key").to_pylist(), queries.column("query_id").to_pylist()
            floors = queries.column("floor").to_pylist() if least else [None] * len(keys)
            for k, key in enumerate(keys):
                floor = -np.inf if floors[k] is None else floors[k]
                if b["wild"] or not tame[k]:
                    score = exact_products(y[k], x if b["wild"] else x / SCALE, SCALE)
                    other = np.flatnonzero((ids != owners[k]) & (score >= floor))
                    top = other[np.lexsort((ids[other], ~score[other]))[:K]]
                    found, score = ids[top], score[top]
                else:
                    found, score = best_of_block(whole[k], away[k], owners[k], floor, ids, x, squares, block_away)
                out += [(key, i, s) for i, s in zip(found.tolist(), score.tolist(), strict=True)]
        values = np.array(out, np.int64).reshape(-1, 3).T
        return pa.table(list(values), names=["query_key", "vec_id", "score"])

    return search


def _routed(pivots: dict[int, np.ndarray]):
    """A function for co-groups of summaries of blocks and queries: the blocks that each query still has to visit."""

    def route(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        keep = ["query_key", "query_id", "v", "length", "floor", "home"]
        names = ["query_key", "query_id", "v", "length", "floor", "block"]
        if not blocks.num_rows or not queries.num_rows:
            return queries.select(keep).rename_columns(names).slice(0, 0)
        low, high = (np.array(blocks.column(c).to_pylist(), float) for c in ("low", "high"))
        norm, wild, block = (blocks.column(c).to_numpy(zero_copy_only=False) for c in ("norm", "wild", "block"))
        whole, tame = floored(matrix(queries), SCALE)
        away, squares = distances(whole, pivots), (whole * whole).sum(axis=1)
        floors = np.array([-np.inf if f is None else f for f in queries.column("floor").to_pylist()], float)
        home = queries.column("home").to_numpy()
        who, where = [], []
        for k in range(len(home)):
            apart = np.maximum(np.maximum(low - away[k], away[k] - high), 0.0).max(axis=1)
            bound = (squares[k] + norm - apart * apart) / 2 + _slack(squares[k] + norm)
            go = np.flatnonzero(((bound >= floors[k]) | wild | (not tame[k])) & (block != home[k]))
            who.append(np.full(len(go), k))
            where.append(block[go])
        visits = queries.select(keep).take(pa.array(np.concatenate(who)))
        return visits.set_column(5, "block", pa.array(np.concatenate(where), pa.int64()))

    return route


_FOUND = "query_key long, vec_id long, score long"


def search(embeddings: DataFrame, is_query: Column) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``embeddings`` (vec_id, embedding) for which ``is_query`` (over
    vec_id) holds: the K highest integer inner products."""
    (asks,) = unused(embeddings, "asks")
    vectors = usable(embeddings.withColumn(asks, F.coalesce(is_query, F.lit(False))), F.col(asks).alias("asks"))
    vectors = vectors.withColumn("deal", F.xxhash64("vec_id", "v"))
    pivots = choose_pivots(vectors)
    placed = cut(place(vectors, pivots))
    index = build_index(placed, pivots).withColumn("deal", F.col("block"))
    queries = placed.filter("asks").select(F.col("vec_id").alias("query_id"), "v", "length", "block").distinct()
    queries = cut(queries.withColumn("query_key", F.monotonically_increasing_id())).withColumn("deal", F.col("query_key"))
    near = cut(paired(index, queries, ["length", "block"], 1, QUERIES).applyInArrow(_searched(pivots, False), _FOUND))
    floors = near.groupBy("query_key").agg(F.when(F.count("*") >= K, F.min("score")).alias("floor"))
    asking = queries.join(floors, "query_key", "left").withColumnRenamed("block", "home")
    summaries = index.select("length", "block", "low", "high", "norm", "wild", "deal")
    visits = paired(summaries, asking, ["length"], SUMMARIES, QUERIES).applyInArrow(_routed(pivots), "query_key long, query_id long, v array<double>, length int, floor long, block long")
    visits = cut(visits.withColumn("deal", F.col("query_key")))
    far = paired(index, visits, ["length", "block"], 1, QUERIES).applyInArrow(_searched(pivots, True), _FOUND)
    found = near.unionByName(far).join(queries.select("query_key", "query_id"), "query_key")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")
