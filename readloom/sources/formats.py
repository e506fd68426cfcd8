"""Sequence files as DataFrames: FASTA, FASTQ, SAM, raw lines and label lists, plain or gzipped.

Formats whose records stand for themselves (FASTA by its header sign, SAM, raw) are split by Spark's text source, so a
file is read by many tasks. A FASTQ record is four lines, and only its place in the file tells a header from a line of
qualities: lines are numbered inside the block of a file that they were read from, and get what the blocks before it
hold, a count a block, so every file of a folder is framed on its own however it is split.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import wrapped

_KIND = re.compile(r"\.(fasta|fa|fastq|fq|sam|raw)(\.gz)?$", re.IGNORECASE)
_NAMES = {"fa": "fasta", "fq": "fastq"}


def format_of(path: str) -> str:
    """fasta, fastq, sam or raw by the file's ending, in any case, with or without .gz."""
    found = _KIND.search(path)
    if not found:
        raise ValueError(f"unknown sequence format: {path}")
    kind = found.group(1).lower()
    return _NAMES.get(kind, kind)


def corrected_path(path: str) -> str:
    """Where the corrected reads of a file go by default."""
    found = _KIND.search(path)
    if not found:
        raise ValueError(f"unknown sequence format: {path}")
    return f"{path[: found.start()]}.corr{found.group(0)}"


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Any of the four formats; every one has idx (place in the file, from 0), id and seq."""
    return {"fasta": read_fasta, "fastq": read_fastq, "sam": read_sam, "raw": read_raw}[format_of(path)](spark, path)


def numbered_parts(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """file, line (from 0 in its file), place (from 0 over all files, in the order of their paths), value: the lines below a
    path, or what stands between separators."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    text = reader.text(path)
    source = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    order = Window.partitionBy("file", "block").orderBy("at")
    parts = text.select("value", *source, F.monotonically_increasing_id().alias("at"))  # rises inside a block
    parts = parts.withColumn("nth", F.row_number().over(order) - 1).drop("at")
    blocks = text.select(*source).groupBy("file", "block").agg(F.count("*").alias("n"))
    blocks = blocks.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n"))
    files = blocks.groupBy("file").agg(F.sum("n").alias("lines"))
    files = files.select(F.col("file").alias("of"), (F.sum("lines").over(Window.orderBy("file")) - F.col("lines")).alias("first"))  # a row a file
    begins = blocks.join(files, F.col("file") == F.col("of")).select("file", "block", "before", "first")
    found = parts.join(begins, ["file", "block"]).withColumn("line", F.col("before") + F.col("nth"))
    return found.select("file", "line", (F.col("first") + F.col("line")).alias("place"), "value")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """idx, id, seq; lines before a file's first header belong to no record."""
    # only a file's first part still has its sign, or is what stands before the first header
    rows = numbered_parts(spark, path, "\n>").filter("line > 0 or startswith(value, '>')").withColumn("value", F.regexp_replace("value", "^>", ""))
    head = F.split("value", "\r?\n", 2)
    return rows.select(F.col("place").alias("idx"), head[0].alias("id"), F.regexp_replace(F.coalesce(F.get(head, F.lit(1)), F.lit("")), r"\s", "").alias("seq"))


def _over_files(rows: DataFrame, nth: str, name: str) -> DataFrame:
    """``rows`` (file and ``nth``, a number inside the file) with ``name``: a number over all files, in the order of paths."""
    files = rows.groupBy("file").agg(F.count("*").alias("n"))
    files = files.select(F.col("file").alias("of"), (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("first"))  # a row a file
    return rows.join(files, F.col("file") == F.col("of")).withColumn(name, F.col("first") + F.col(nth))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """file, record (from 0 in its file), idx, id, seq, qual."""
    lines = numbered_parts(spark, path).select("file", F.expr("line div 4").alias("record"), (F.col("line") % 4).alias("at"), F.rtrim("value").alias("value"))
    record = lines.groupBy("file", "record").agg(*[F.max(F.when(F.col("at") == k, F.col("value"))).alias(c) for k, c in ((0, "head"), (1, "seq"), (3, "qual"))])
    record = record.filter(~((F.col("head") == "") & F.col("seq").isNull()))
    head = F.when(F.startswith("head", F.lit("@")), F.expr("substring(head, 2)")).otherwise(F.raise_error(F.concat(F.lit("no FASTQ header: "), F.col("head"))))
    return _over_files(record, "record", "idx").select("file", "record", "idx", head.alias("id"), F.coalesce("seq", F.lit("")).alias("seq"), F.coalesce("qual", F.lit("")).alias("qual"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """idx, id, seq, qual; a record whose first line has no @ is an error, as is a last one that is cut short."""
    return _records(spark, path).select("idx", "id", "seq", "qual")


_SAM = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
_SAM_INTS = ("flag", "pos", "mapq", "pnext", "tlen")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """idx, id, seq and the other fields of alignment lines; sequences are taken as they stand, whatever their strand."""
    lines = numbered_parts(spark, path).withColumnRenamed("line", "in_file").withColumnRenamed("place", "line").filter("not startswith(value, '@') and trim(value) <> ''")
    field = F.split("value", "\t")
    fields = [F.get(field, F.lit(k)).cast("int" if c in _SAM_INTS else "string").alias(c) for k, c in enumerate(_SAM)]
    return lines.select(F.col("line").alias("idx"), F.get(field, F.lit(0)).alias("id"), *fields[1:], F.slice(field, 12, 1 << 20).alias("tags"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """idx, id (the place again), seq: one sequence a line."""
    lines = numbered_parts(spark, path).withColumnRenamed("line", "in_file").withColumnRenamed("place", "line").filter("trim(value) <> ''")
    return lines.select(F.col("line").alias("idx"), F.col("line").cast("string").alias("id"), F.rtrim("value").alias("seq"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """pair_id (from 1), id, seq1, qual1, seq2, qual2 of an interleaved FASTQ file; mates have one id, else it is an error.
    A file's last read without a mate is left out; pairs are numbered over all files, in the order of their paths."""
    reads = _records(spark, path)
    mate = lambda k: F.max(F.when(F.col("record") % 2 == k, F.struct("id", "seq", "qual")))
    both = reads.groupBy("file", F.expr("record div 2 + 1").alias("nth")).agg(mate(0).alias("a"), mate(1).alias("b")).filter("b is not null")
    both = _over_files(both, "nth", "pair_id")
    same = F.when(F.col("a.id") == F.col("b.id"), F.col("a.id")).otherwise(F.raise_error(F.lit("mates with different ids")))
    return both.select("pair_id", same.alias("id"), F.upper("a.seq").alias("seq1"), F.col("a.qual").alias("qual1"), F.upper("b.seq").alias("seq2"), F.col("b.qual").alias("qual2"))


def read_patterns(spark: SparkSession, path: str, k: int) -> DataFrame:
    """pattern: the first k bases of the FASTA records that hold only A, C, G, T and are long enough; others are errors."""
    records = read_fasta(spark, path).withColumn("seq", F.upper("seq"))
    fine = F.col("seq").rlike("^[ACGT]+$") & (F.length("seq") >= k)
    return records.select(F.when(fine, F.left("seq", F.lit(k))).otherwise(F.raise_error(F.concat(F.lit("no pattern: "), F.col("seq")))).alias("pattern"))


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """kmer, n of a FASTA file whose headers are counts; the k-mer is the canonical one."""
    from ..functions.sequence import canonical

    records = read_fasta(spark, path)
    return records.groupBy(canonical(F.upper("seq")).alias("kmer")).agg(F.max(F.col("id").cast("long")).alias("n"))


def _write(rows: DataFrame, path: str, compression: str | None) -> None:
    writer = rows.write.mode("errorifexists")
    (writer.option("compression", compression) if compression else writer).text(path)


def write_fasta(rows: DataFrame, path: str, order: str | None = None, compression: str | None = None) -> None:
    """``rows`` has id and seq; sequences are wrapped at 70 columns."""
    rows = rows.repartitionByRange(order).sortWithinPartitions(order) if order else rows
    _write(rows.select(F.concat_ws("\n", F.concat(F.lit(">"), "id"), wrapped(F.col("seq")))), path, compression)


def write_fastq(rows: DataFrame, path: str, order: str | None = None, compression: str | None = None) -> None:
    """``rows`` has id, seq and qual."""
    rows = rows.repartitionByRange(order).sortWithinPartitions(order) if order else rows
    _write(rows.select(F.concat_ws("\n", F.concat(F.lit("@"), "id"), "seq", F.lit("+"), "qual")), path, compression)


def write_raw(rows: DataFrame, path: str, order: str | None = None, compression: str | None = None) -> None:
    rows = rows.repartitionByRange(order).sortWithinPartitions(order) if order else rows
    _write(rows.select("seq"), path, compression)


def write_sam(rows: DataFrame, path: str, compression: str | None = None) -> None:
    fields = [F.coalesce(F.col("id" if c == "qname" else c).cast("string"), F.lit("*")) for c in _SAM]
    _write(rows.select(F.concat_ws("\t", *fields, F.array_join("tags", "\t"))), path, compression)


def write_network(edges: DataFrame, path: str) -> None:
    """Edges (run, src, dst, sim) as tab-separated lines with two decimals, one folder for each run."""
    line = F.concat_ws("\t", "src", "dst", F.format_string("%.2f", "sim")).alias("value")
    edges.select("run", line).write.partitionBy("run").mode("errorifexists").text(path)


def write_clusters(reads: DataFrame, path: str) -> None:
    """Reads (cluster_id, id, seq, qual) as FASTQ, one folder for each cluster."""
    record = F.concat_ws("\n", F.concat(F.lit("@"), "id"), "seq", F.lit("+"), "qual").alias("value")
    reads.select("cluster_id", record).repartition("cluster_id").write.partitionBy("cluster_id").mode("errorifexists").text(path)


_TAGS = {"accepted": "A", "score": "S", "branch": "B", "positions": "P", "chain": "C"}


def chain_lines(rows: DataFrame) -> DataFrame:
    """Tagged lines of read alignments (id, accepted, score, branch, first_off, last_off, chain, status)."""
    tag = lambda c, value: F.concat(F.lit(f"{_TAGS[c]}("), value, F.lit(f"){_TAGS[c]}"))
    flag = lambda c: F.col(c).cast("int").cast("string")
    parts = [
        tag("accepted", flag("accepted")),
        tag("score", F.col("score").cast("string")),
        tag("branch", flag("branch")),
        tag("positions", F.concat_ws(", ", "first_off", "last_off")),
        tag("chain", F.array_join(F.transform("chain", lambda x: x.cast("string")), " ")),
    ]
    return rows.select(F.concat_ws("\n", "id", F.concat_ws(" ", *parts, "status")).alias("value"))


def parse_chain(line: str) -> dict[str, object]:
    """Columns that read the tagged part of an alignment line; ``line`` names the column."""
    inner = lambda c: F.regexp_extract(line, rf"{_TAGS[c]}\((.*?)\){_TAGS[c]}", 1)
    place = F.split(inner("positions"), r",\s*")
    chain = F.filter(F.split(F.trim(inner("chain")), r"\s+"), lambda x: x != "")
    return {
        "accepted": inner("accepted") == "1",
        "score": inner("score").cast("int"),
        "branch": inner("branch") == "1",
        "first_off": F.get(place, F.lit(0)).try_cast("int"),
        "last_off": F.get(place, F.lit(1)).try_cast("int"),
        "chain": F.transform(chain, lambda x: x.cast("int")),
        "status": F.regexp_extract(line, r"([A-Z]+)\s*$", 1),
    }


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """idx, id and the alignment columns of a file of two lines for each read."""
    lines = numbered_parts(spark, path).select("file", F.expr("line div 2").alias("record"), (F.col("line") % 2).alias("at"), "value")
    both = lines.groupBy("file", "record").agg(F.max(F.when(F.col("at") == 0, F.col("value"))).alias("id"), F.max(F.when(F.col("at") == 1, F.col("value"))).alias("tags"))
    return _over_files(both, "record", "idx").select("idx", "id", *[c.alias(k) for k, c in parse_chain("tags").items()])


def write_graph(nodes: DataFrame, arcs: DataFrame, path: str) -> None:
    """A graph as two Parquet tables."""
    nodes.write.mode("errorifexists").parquet(f"{path}/nodes")
    arcs.write.mode("errorifexists").parquet(f"{path}/arcs")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/arcs")


def write_cytoscape(nodes: DataFrame, arcs: DataFrame, path: str) -> None:
    """Tab-separated node and arc tables with headers."""
    nodes.write.mode("errorifexists").option("sep", "\t").option("header", True).csv(f"{path}.nodes")
    arcs.write.mode("errorifexists").option("sep", "\t").option("header", True).csv(f"{path}.arcs")
