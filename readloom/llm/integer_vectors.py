"""What the operators on integer inner products share: usable rows, exact products, and groups of bounded size.

A component x becomes floor(scale * x). As long as a vector's squared norm is below ``TAME``, its inner products with others
like it are sums of doubles without rounding. The few vectors beyond are called wild: their products are Python integers.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

TAME = 2.0**52
#: Tables of at most so many rows, counted first, are broadcast; they hold a few numbers a row.
BROADCAST_ROWS = 20_000


def usable(embeddings: DataFrame, *more: str | Column) -> DataFrame:
    """vec_id, v (array<double>), length and the columns of ``more``: rows with an id and a vector of finite components."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("length"), *more)


def matrix(rows: pa.Table) -> np.ndarray:
    """Column v of rows of one length."""
    column = rows.column("v").combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def floored(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) as doubles, and which rows are tame; wild rows become zeros."""
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(x * scale)
        tame = (whole * whole).sum(axis=1) < TAME
    whole[~tame] = 0.0
    return whole, tame


def exact_products(one: np.ndarray, many: np.ndarray, scale: int) -> np.ndarray:
    """Integer products of vectors of any magnitude, clipped to the range of long."""
    whole = lambda row: [math.floor(Fraction(float(x)) * scale) for x in row]
    own = whole(one)
    ends = np.iinfo(np.int64)
    return np.array([min(max(sum(a * b for a, b in zip(own, whole(row), strict=True)), ends.min), ends.max) for row in many], np.int64)


def join_small(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a table of one row a key; broadcast if it is counted to be small, so that a hot key stays spread."""
    small = cut(small)
    return rows.join(F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small, keys)


def paired(left: DataFrame, right: DataFrame, keys: list[str], left_rows: int, right_rows: int):
    """Co-groups in which each block of ``left`` meets each block of ``right`` that has the same ``keys``.

    The rows of a key are dealt by hash into blocks of about so many rows, whatever their number, and a pair of blocks is a
    group: no group grows with the tables. Both tables have a column ``deal`` to hash.
    """
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, also where both come of one table
    counted = lambda df, n, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    sizes = counted(left, left_rows, "left_blocks").join(counted(right, right_rows, "right_blocks"), keys)
    sizes = cut(sizes)
    block = lambda salt, n: F.pmod(F.xxhash64("deal", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = join_small(left, sizes, keys).withColumn("a", block(3, "left_blocks")).withColumn("b", each("right_blocks"))
    b = join_small(right, sizes, keys).withColumn("b", block(5, "right_blocks")).withColumn("a", each("left_blocks"))
    drop = ["left_blocks", "right_blocks", "deal"]
    by = [*keys, "a", "b"]
    return a.drop(*drop).groupBy(*by).cogroup(b.drop(*drop).groupBy(*by))
