"""DNA reads derived from a table of texts, so that every operator has input in which both engines agree.

Letters are mapped to bases; a text's sequence is cut into reads of 100 bases, and neighbouring reads are the mates of a
pair. Ids are made of the document and the place in it, so no global numbering is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READ = 100
LETTERS, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"
#: Pairs of one document get ids from doc_id * PAIRS on.
PAIRS = 1 << 20

SQL = f"""
dna AS (SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
placed AS (SELECT doc_id, seq, unnest(range(0, length(seq) // {READ})) AS i FROM dna),
reads AS (SELECT doc_id * {PAIRS} + i // 2 AS pair_id, CAST(i % 2 + 1 AS INTEGER) AS mate, substr(seq, CAST(i * {READ} + 1 AS BIGINT), {READ}) AS seq FROM placed),
pairs AS (SELECT a.pair_id, a.seq AS seq1, b.seq AS seq2 FROM reads a JOIN reads b ON a.pair_id = b.pair_id AND a.mate = 1 AND b.mate = 2)"""


def spread(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` over at least as many partitions as there are cores: a table of few splits is hashed by its key, a table of
    many is left as it was read."""
    least = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(least, key) if docs.rdd.getNumPartitions() < least else docs


def dna(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id") -> DataFrame:
    """doc_id, seq of the texts of a table whose rows are named by ``key``."""
    docs = spark.read.parquet(f"{sf_dir}/{table}.parquet").filter(F.col("text").isNotNull() & F.col(key).isNotNull()).select(key, "text")
    return spread(docs, key).select(F.col(key).alias("doc_id"), F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), LETTERS, BASES).alias("seq"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, mate (1 or 2), seq."""
    n = F.expr(f"length(seq) div {READ}")
    placed = dna(spark, sf_dir).filter(F.length("seq") >= READ).select("doc_id", "seq", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    return placed.select(
        (F.col("doc_id") * PAIRS + F.expr("i div 2")).alias("pair_id"), (F.col("i") % 2 + 1).cast("int").alias("mate"), F.substring(F.col("seq"), (F.col("i") * READ + 1).cast("int"), F.lit(READ)).alias("seq")
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, seq1, seq2 of the complete pairs; made inside each document, without a join."""
    n = F.expr(f"length(seq) div {2 * READ}")
    placed = dna(spark, sf_dir).filter(F.length("seq") >= 2 * READ).select("doc_id", "seq", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    at = (F.col("i") * 2 * READ + 1).cast("int")
    return placed.select((F.col("doc_id") * PAIRS + F.col("i")).alias("pair_id"), F.substring(F.col("seq"), at, F.lit(READ)).alias("seq1"), F.substring(F.col("seq"), at + READ, F.lit(READ)).alias("seq2"))
