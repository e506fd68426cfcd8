"""Approximate nearest neighbours: one HNSW graph per shard, shard results merged.

Rows are dealt to shards by a hash of their id and vector, so copies of one vector spread over all shards. Shards grow
with the square root of the table, from ``SHARD`` rows to ``LARGEST``, so that the number of shards that a query has to
visit grows more slowly than the table. A shard indexes its distinct vectors; each stands for the smallest ``K + 1`` ids
that have it, which is all that a list of the K nearest without the query's own row can need. Queries visit every shard in
blocks; a shard returns the K best of what its graph finds, scored in double precision on the original vectors, component
by component in order; the K best of all are kept.

Defined cases: null or zero vectors, those with null or non-finite components, empty ones and rows without id take no
part, as query or candidate; rows of the query's own id are its own; vectors are compared with those of equal length;
equal scores go to the smaller vec_id; with fewer than K candidates all found are returned; extra columns are ignored;
an empty table gives an empty result; finite vectors of any magnitude are ranked, and products beyond the range of doubles
are infinite and rank so; vectors have no long text, and one of very many components only makes its rows wider.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hnsw
from .common import cut

K, SHARD, LARGEST, BLOCK, STEP = 20, 4096, 65_536, 16_384, 256
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array<float>), length: the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    v = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda x: x != 0))
    return v.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("length"))


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False).reshape(n, -1)


def _build(rows: pa.Table) -> pa.Table:
    """Index one shard: distinct vectors with the smallest ids of each, and the graph."""
    rows = rows.sort_by("vec_id")
    ids, x = rows.column("vec_id").to_numpy(), _matrix(rows.column("v"), rows.num_rows)
    distinct, which = np.unique(x, axis=0, return_inverse=True)
    order = np.argsort(which.reshape(-1), kind="stable")
    group = which.reshape(-1)[order]
    rank = np.arange(len(group)) - np.searchsorted(group, group)
    table = np.full((len(distinct), K + 1), -1, np.int64)
    there = np.zeros((len(distinct), K + 1), bool)
    low = rank <= K
    table[group[low], rank[low]], there[group[low], rank[low]] = ids[order][low], True
    index = hnsw.build(distinct, int(rows.column("shard")[0].as_py())) | {"exact": distinct, "ids": table, "there": there}
    return pa.table({"shard": rows.column("shard").slice(0, 1), "length": rows.column("length").slice(0, 1), "graph": pa.array([hnsw.pack(index)], pa.binary())})


def _search(queries: pa.Table, graphs: pa.Table) -> pa.Table:
    if not queries.num_rows or not graphs.num_rows:
        return _FOUND.empty_table()
    index = hnsw.unpack(graphs.column("graph")[0].as_py())
    ids, x = queries.column("vec_id").to_numpy(), _matrix(queries.column("v"), queries.num_rows)
    parts: list[list[np.ndarray]] = [[], [], []]
    for a in range(0, len(ids), STEP):
        own, q = ids[a : a + STEP], x[a : a + STEP]
        node = hnsw.search(index, q)
        at, place = np.nonzero(node >= 0)
        node = node[at, place]
        score = _products(index["exact"][node], q[at])
        owner, copy = np.nonzero(index["there"][node])
        query, vec, score = at[owner], index["ids"][node[owner], copy], score[owner]
        other = vec != own[query]
        query, vec, score = query[other], vec[other], score[other]
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        best = np.arange(len(query)) - np.searchsorted(query, query) < K
        for part, values in zip(parts, (own[query[best]], vec[best], score[best]), strict=True):
            part.append(values)
    return pa.table([np.concatenate(p) for p in parts], schema=_FOUND)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(a.shape[1]):
            total += a[:, k] * b[:, k]
    return total


def build_index(vectors: DataFrame) -> DataFrame:
    """shard, length, graph: one row for each shard of ``vectors`` (from ``valid_vectors``)."""
    known = vectors.groupBy("length").agg(F.count("*").alias("n"))
    size = F.least(F.lit(LARGEST), SHARD * F.greatest(F.lit(1), F.floor(F.sqrt(F.floor(F.col("n") / (10 * SHARD))))))
    counts = known.select("length", F.ceil(F.col("n") / size).cast("int").alias("shards"))
    dealt = vectors.join(counts, "length").withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.col("shards")).cast("int"))
    return cut(dealt.select("shard", "length", "vec_id", "v").groupBy("shard", "length").applyInArrow(_build, "shard int, length int, graph binary"))


def nearest(embeddings: DataFrame, is_query: Column) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``embeddings`` for which ``is_query`` (over vec_id) holds."""
    vectors = valid_vectors(embeddings)
    index = build_index(vectors)
    queries = vectors.filter(is_query).dropDuplicates(["vec_id", "v"])
    blocks = queries.groupBy("length").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    queries = queries.join(blocks, "length").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = index.join(blocks, "length").select("shard", "length", "graph", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    visits = queries.join(index.groupBy("length").agg(F.max("shard").alias("last")), "length").select("vec_id", "v", "length", "block", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("shard"))
    keys = ["length", "shard", "block"]
    found = visits.groupBy(keys).cogroup(dealt.groupBy(keys)).applyInArrow(_search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")
