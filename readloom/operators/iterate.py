"""Lineage cuts and connected components for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written below the folder of ``spark.checkpoint.dir`` and read again; on a single machine (``local``
    masters) without such a folder, below a temporary one.

    A checkpoint would keep the size that its plan was estimated to have. In rounds of joins with itself that estimate is
    squared every round, and planning soon takes longer than running; a written table has the size of its files.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="readloom-"))
    place = f"{context.getCheckpointDir().rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)  # letters pack to a quarter
    return spark.read.schema(df.schema).parquet(place)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): smallest neighbouring labels with pointer jumping, until nothing changes.

    ``nodes`` has node; ``edges`` has src and dst. Nodes without an edge are components of their own.
    """
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct())
    label = cut(nodes.select("node", F.col("node").alias("component")).distinct())
    while True:
        low = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("seen"))
        step = label.join(low, "node", "left").select("node", "component", F.least("component", F.coalesce("seen", "component")).alias("low"))
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        label = cut(step.join(jump, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("component"), F.col("component").alias("was")))
        if label.filter("component <> was").limit(1).count() == 0:
            return label.select("node", "component")
        label = label.select("node", "component")
