"""Helpers that several operators share: lineage cuts, column checks and the hash split of labels."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text, as the contracts spell it; the class is space and the five ASCII controls TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``. Where none is set, a temporary folder is
    taken on a single machine (``local`` masters, as in tests), and anything else is an error.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, also set as the checkpoint folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="readloom-checkpoint-"))
    return context.getCheckpointDir()


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for a null."""
    inner = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(text.isNull() | (inner == ""), F.lit(0)).otherwise(F.size(F.split(inner, SPACE))).cast("long")


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """The texts of at most ``bound`` labelled ids outside the held-out fifth, as ``doc_id``, ``text`` and ``label``, cut.

    The ids are those with the smallest hash, so that the choice is even over the table and the same at every run; ``bound``
    limits what a fit has to see, whatever the size of the tables. The rows stay where they are: nothing here is collected,
    so neither long texts nor rows that repeat an id reach the driver.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select("doc_id", "text").filter("text is not null and doc_id is not null")
    return cut(texts.join(known, "doc_id").select("doc_id", "text", "label"))


def unused(df: DataFrame, *stems: str) -> list[str]:
    """For each stem a column name that ``df`` lacks, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        names.append(stem)
    return names


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, however often ``use`` refers to it, lambdas included."""
    return F.element_at(F.transform(F.array(value), use), 1)
