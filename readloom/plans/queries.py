"""One query for each operator, over reads and graphs derived from the shared tables, and the same result as SQL.

Reads are cut from ``documents`` (see ``reads``). Graph queries work on the low-complexity pairs, as the pipeline does.
Weighted graphs for the community operators are suppliers and parts, linked by the lines that have both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence
from ..operators import chains, community, consensus, flow, graph, graph_alignment, kmers, matches, paths, similarity, spectrum
from ..operators.iterate import cut
from . import pipeline
from .reads import BASES, LETTERS, SQL, dna, pairs, reads

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

K, GRAPH_K, PATTERN = 9, 15, "AAAAAAA"
_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _canonical(x: str) -> str:
    return f"least({x}, {_RC.format(x)})"


def _kmers(k: int, source: str = "reads") -> str:
    return f"""kmers AS (SELECT pair_id, mate, seq, CAST(p AS INTEGER) AS pos, substr(seq, CAST(p + 1 AS BIGINT), {k}) AS kmer
        FROM (SELECT pair_id, mate, seq, unnest(range(0, length(seq) - {k} + 1)) AS p FROM {source})),
    canon AS (SELECT pair_id, mate, pos, {_canonical('kmer')} AS kmer FROM kmers)"""


_LOW = f"""low AS (SELECT * FROM pairs WHERE {' OR '.join(f"contains({c}, '{p}')" for c in ('seq1', 'seq2') for p in sequence.rotations(PATTERN))}),
lowreads AS (SELECT pair_id, 1 AS mate, seq1 AS seq FROM low UNION ALL SELECT pair_id, 2, seq2 FROM low)"""


def _low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.low_complexity_split(pairs(spark, sf_dir), sequence.rotations(PATTERN)).filter("low_complexity").drop("low_complexity")


def _low_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.reads_of(_low(spark, sf_dir))


# reads and sequences


@query(f"WITH {SQL} SELECT pair_id, mate, seq FROM reads")
def read_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir)


@query(f"WITH {SQL} SELECT pair_id, seq1, seq2 FROM pairs")
def read_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


@query(f"WITH {SQL} SELECT mate, count(*) AS n_reads, avg(length(seq)) AS avg_len FROM reads GROUP BY mate")
def library_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.library_statistics(reads(spark, sf_dir), "mate")


@query("SELECT CAST(sum(CAST(trunc(a * n) AS BIGINT)) AS DOUBLE) / sum(n) AS avg_len FROM (SELECT lang, count(*) AS n, avg(length(text)) AS a FROM documents WHERE text IS NOT NULL GROUP BY lang)")
def weighted_read_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    return kmers.weighted_read_length(kmers.library_statistics(docs.select("lang", F.col("text").alias("seq")), "lang"))


@query(f"WITH {SQL} SELECT pair_id, mate, translate(seq, 'ACGT', 'TGCA') AS comp, {_RC.format('seq')} AS rc FROM reads")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("pair_id", "mate", sequence.complement(F.col("seq")).alias("comp"), sequence.reverse_complement(F.col("seq")).alias("rc"))


_TRIM = "regexp_replace(translate(seq, 'ACGT', '#I5\"'), '[!-#]+$', '')"


@query(f"WITH {SQL} SELECT pair_id, mate, left(seq, length(qual)) AS seq, qual FROM (SELECT pair_id, mate, seq, {_TRIM} AS qual FROM reads) WHERE length(qual) > 0")
def quality_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualities are derived from the bases."""
    return sequence.quality_trim(reads(spark, sf_dir).withColumn("qual", F.translate("seq", "ACGT", '#I5"'))).select("pair_id", "mate", "seq", "qual")


@query(f"WITH {SQL} SELECT pair_id, mate, '>' || pair_id || '/' || mate || chr(10) || substr(seq, 1, 70) || CASE WHEN length(seq) > 70 THEN chr(10) || substr(seq, 71) ELSE '' END AS record FROM reads")
def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit(">"), F.col("pair_id").cast("string"), F.lit("/"), F.col("mate").cast("string"))
    return reads(spark, sf_dir).select("pair_id", "mate", F.concat_ws("\n", name, sequence.wrapped(F.col("seq"))).alias("record"))


# low-complexity extraction


@query(
    f"""WITH {SQL}, p AS (SELECT DISTINCT left(seq, 7) AS pattern FROM reads), turned AS (SELECT pattern, list_transform(range(0, 7), lambda i: substr(pattern, i + 1, 7) || left(pattern, i)) AS t FROM p)
    SELECT pattern, unnest(list_distinct(list_concat(t, list_transform(t, lambda x: {_RC.format('x')})))) AS rotation FROM turned"""
)
def pattern_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rotations, on both strands, of the patterns that reads begin with."""
    starts = reads(spark, sf_dir).select(F.left("seq", F.lit(7)).alias("pattern")).distinct()
    return starts.select("pattern", F.explode(sequence.rotations_of(F.col("pattern"))).alias("rotation"))


@query(f"WITH {SQL}, {_LOW} SELECT p.pair_id, p.seq1, p.seq2, l.pair_id IS NOT NULL AS low_complexity FROM pairs p LEFT JOIN low l USING (pair_id)")
def lowcomplex_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.low_complexity_split(pairs(spark, sf_dir), sequence.rotations(PATTERN))


# k-mers


@query(f"WITH {SQL}, {_kmers(K)} SELECT kmer, count(*) AS n FROM canon GROUP BY kmer")
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.count_kmers(reads(spark, sf_dir), K)


@query(f"WITH {SQL}, {_kmers(K)}, c AS (SELECT kmer, count(*) AS n FROM canon GROUP BY kmer) SELECT count(*) AS n_distinct, count(*) FILTER (n > 1) AS n_repeated FROM c")
def kmer_gt1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.count_kmers(reads(spark, sf_dir), K).agg(F.count("*").alias("n_distinct"), F.count_if(F.col("n") > 1).alias("n_repeated"))


@query(f"WITH {SQL}, {_kmers(K)} SELECT kmer, least(count(*), 65535) AS n FROM canon GROUP BY kmer")
def kmer_saturated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.saturated(kmers.count_kmers(reads(spark, sf_dir), K))


@query(f"WITH {SQL}, {_kmers(K)}, c AS (SELECT kmer, count(*) AS cov FROM canon GROUP BY kmer) SELECT cov, CASE WHEN cov = 1 THEN 0 ELSE count(*) END AS n_kmers FROM c GROUP BY cov")
def kmer_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.spectrum(kmers.count_kmers(reads(spark, sf_dir), K))


@query(
    f"WITH {SQL}, {_LOW}, {_kmers(GRAPH_K, 'lowreads')}, c AS (SELECT kmer, count(*) AS n FROM canon GROUP BY kmer)"
    " SELECT pair_id, mate, string_agg(CAST(n AS VARCHAR), ' ' ORDER BY pos) AS freqs FROM canon JOIN c USING (kmer) GROUP BY pair_id, mate"
)
def kmer_freq_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = _low_reads(spark, sf_dir)
    return kmers.annotate(low, kmers.count_kmers(low, GRAPH_K), GRAPH_K, "pair_id", "mate")


def _bit(x: str) -> str:
    return f"CASE {x} WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 ELSE 0 END"


_MASKS = f"""sided AS (SELECT kmer, {_RC.format('kmer')} AS rc, CASE WHEN pos > 0 THEN substr(seq, pos, 1) END AS b, CASE WHEN pos + {K} < length(seq) THEN substr(seq, pos + {K} + 1, 1) END AS a FROM kmers),
turned AS (SELECT least(kmer, rc) AS kmer, {_bit("CASE WHEN kmer <= rc THEN b ELSE translate(a, 'ACGT', 'TGCA') END")} AS l, {_bit("CASE WHEN kmer <= rc THEN a ELSE translate(b, 'ACGT', 'TGCA') END")} AS r FROM sided),
masks AS (SELECT kmer, count(*) AS n, CAST(bit_or(l) AS INTEGER) AS left_mask, CAST(bit_or(r) AS INTEGER) AS right_mask FROM turned GROUP BY kmer)"""


@query(f"WITH {SQL}, {_kmers(K)}, {_MASKS} SELECT * FROM masks")
def extension_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.extension_masks(reads(spark, sf_dir), K)


@query(f"WITH {SQL}, {_kmers(K)}, {_MASKS} SELECT kmer, bit_count(left_mask) = 1 AS unique_left, bit_count(right_mask) = 1 AS unique_right FROM masks")
def unique_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = kmers.extension_masks(reads(spark, sf_dir), K)
    return masks.select("kmer", kmers.unique_extension(F.col("left_mask")).alias("unique_left"), kmers.unique_extension(F.col("right_mask")).alias("unique_right"))


@query(
    f"""WITH {SQL}, grouped AS (SELECT d.source, r.seq FROM reads r JOIN (SELECT doc_id, source FROM documents) d ON r.pair_id // 1048576 = d.doc_id),
    kmers AS (SELECT source, {_canonical('kmer')} AS kmer FROM (SELECT source, unnest(list_transform(range(1, length(seq) - {K} + 2), lambda i: substr(seq, i, {K}))) AS kmer FROM grouped)),
    counts AS (SELECT source, kmer, count(*) AS n FROM kmers GROUP BY source, kmer),
    s AS (SELECT source, round(avg(n), 2) AS c, count(*) FILTER (n > 2) AS genome FROM counts WHERE n > 1 GROUP BY source),
    t AS (SELECT *, CAST(floor((c - 5) / 6) * 5 + 15 AS INTEGER) AS raw FROM s)
    SELECT source, c, genome, CASE WHEN genome < 100 THEN 1.0 ELSE least(5.0, greatest(1.0, round((c - 1) / ln(c), 2))) END AS cutoff, greatest(15, least(41, CASE WHEN raw % 2 = 0 THEN raw - 1 ELSE raw END)) AS k FROM t"""
)
def cluster_k_and_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources stand for clusters."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    grouped = reads(spark, sf_dir).withColumn("doc_id", F.expr("pair_id div 1048576")).join(source, "doc_id")
    return kmers.cluster_statistics(kmers.count_kmers(grouped, K, "source"), "source")


_SOURCE_COUNTS = f"""grouped AS (SELECT d.source, r.seq FROM reads r JOIN (SELECT doc_id, source FROM documents) d ON r.pair_id // 1048576 = d.doc_id),
    kmers AS (SELECT source, {_canonical('kmer')} AS kmer FROM (SELECT source, unnest(list_transform(range(1, length(seq) - {K} + 2), lambda i: substr(seq, i, {K}))) AS kmer FROM grouped)),
    hist AS (SELECT source, n AS cov, count(*) AS n_kmers FROM (SELECT source, kmer, count(*) AS n FROM kmers GROUP BY source, kmer) GROUP BY source, n)"""


def _log_density(x: str, mean: str, variance: str) -> str:
    r = f"({mean} * {mean} / ({variance} - {mean}))"
    return f"(lgamma({x} + {r}) - lgamma({x} + 1) - lgamma({r}) + {r} * ln({mean} / {variance}) + {x} * ln(({variance} - {mean}) / {variance}))"


def _mixture(histogram: str, group: str) -> str:
    """Fifty rounds over ``histogram`` (group, cov, n_kmers) from the mean of the counts above 1, and a row ``fitted`` a group."""
    columns = ", ".join(f"any_value(mean) FILTER (j = {j}) AS mean{j}, any_value(variance) FILTER (j = {j}) AS variance{j}, any_value(mass) FILTER (j = {j}) AS mass{j}" for j in range(spectrum.PARTS))
    return f"""cover AS (SELECT {group}, round(sum(cov * n_kmers) FILTER (cov > 1) / sum(n_kmers) FILTER (cov > 1), 2) AS c FROM {histogram} GROUP BY ALL),
    used AS (SELECT {group}, CAST(cov AS DOUBLE) AS x, CAST(n_kmers AS DOUBLE) AS y FROM {histogram} JOIN cover USING ({group}) WHERE cov <= 3 * c),
    rounds AS (SELECT {group}, 0 AS i, j, CAST(m AS DOUBLE) AS mean, CAST(1.1 * m AS DOUBLE) AS variance, CAST(1 AS DOUBLE) AS mass FROM (SELECT {group}, unnest([0, 1, 2, 3]) AS j, unnest([2.0, 3.0, c, 2 * c]) AS m FROM cover WHERE c > 0)
        UNION ALL SELECT {group}, i + 1, j, greatest(sx / greatest(sn, 1e-12), 1e-3), greatest(sxx / greatest(sn, 1e-12) - pow(greatest(sx / greatest(sn, 1e-12), 1e-3), 2), greatest(sx / greatest(sn, 1e-12), 1e-3) + 1e-3), greatest(sn, 1e-12)
        FROM (SELECT {group}, i, j, sum(w * y) AS sn, sum(w * x * y) AS sx, sum(w * x * x * y) AS sxx FROM (SELECT *, e / sum(e) OVER (PARTITION BY {group}, x) AS w FROM (
            SELECT *, exp(l - max(l) OVER (PARTITION BY {group}, x)) AS e FROM (SELECT {group}, i, j, x, y, ln(mass) + {_log_density('x', 'mean', 'variance')} AS l FROM rounds JOIN used USING ({group}) WHERE i < 50))) GROUP BY {group}, i, j)),
    fitted AS (SELECT {group}, c, {columns} FROM rounds JOIN cover USING ({group}) WHERE i = 50 GROUP BY {group}, c)"""


def _part(x: str, j: int, times: str = "1") -> str:
    return f"(ln(mass{j}) + {_log_density(x, f'({times} * mean{j})', f'({times} * variance{j})')})"


def _odds(x: str) -> str:
    return f"((exp({_part(x, 0)}) + exp({_part(x, 1)})) / exp({_part(x, 2)}))"


_CUTOFF = f"""tried AS (SELECT *, unnest(range(CAST(ceil(mean0) AS BIGINT), greatest(CAST(ceil(mean0) AS BIGINT), CAST(ceil(mean2) AS BIGINT)) + 1)) AS k FROM fitted),
    cutoffs AS (SELECT {{0}}, coalesce(min(k) FILTER (k < mean2 AND {_odds('k')} < 0.5), max(k)) AS cutoff FROM tried GROUP BY {{0}})"""


def _source_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, cov, n_kmers and coverage, the mean count of the k-mers that occur more than once."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    grouped = reads(spark, sf_dir).withColumn("doc_id", F.expr("pair_id div 1048576")).join(source, "doc_id")
    bins = kmers.count_kmers(grouped, K, "source").groupBy("source", F.col("n").alias("cov")).agg(F.count("*").alias("n_kmers"))
    return spectrum.with_coverage(bins, "source")


@query(
    f"""WITH RECURSIVE {SQL}, {_SOURCE_COUNTS}, {_mixture('hist', 'source')}, {_CUTOFF.format('source')}
    SELECT source, c AS coverage, {', '.join(f'round(mean{j}, 3) AS mean{j}, round(variance{j}, 3) AS variance{j}, round(mass{j}, 3) AS mass{j}' for j in range(spectrum.PARTS))}, CAST(cutoff AS INTEGER) AS cutoff,
    round(1.2 * exp({_part('mean2', 2)}), 3) AS y_max FROM fitted JOIN cutoffs USING (source)"""
)
def spectrum_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture, cutoff and height of the plot of each source's spectrum; sources stand for clusters."""
    found = spectrum.summary(spectrum.fit(_source_spectrum(spark, sf_dir), "source"))
    parts = [F.round(F.get(c, F.lit(j)), 3).alias(f"{c}{j}") for j in range(spectrum.PARTS) for c in ("mean", "variance", "mass")]
    return found.select("source", "coverage", *parts, "cutoff", F.round("y_max", 3).alias("y_max"))


@query(
    f"""WITH RECURSIVE {SQL}, {_SOURCE_COUNTS}, {_mixture('hist', 'source')}
    SELECT source, cov, n_kmers, round({' + '.join(f"exp({_part('cov', j)})" for j in range(spectrum.PARTS))}, 3) AS fit, round({_odds('cov')}, 6) AS odds FROM hist JOIN fitted USING (source) WHERE cov <= 3 * c"""
)
def spectrum_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixture expects at each count of a source up to three times its coverage, and the odds of errors there."""
    bins = cut(_source_spectrum(spark, sf_dir))
    found = spectrum.evaluated(bins.filter("cov <= 3 * coverage"), spectrum.fit(bins, "source"), "source")
    return found.withColumns({"fit": F.round("fit", 3), "odds": F.round("odds", 6)})


@query(f"WITH {SQL}, {_kmers(K)}, c AS (SELECT kmer, count(*) AS k FROM canon GROUP BY kmer) SELECT k, round(exp(k * ln(10.0) - 10.0 - lgamma(k + 1)), 12) AS p, count(*) AS n_kmers FROM c GROUP BY k")
def poisson_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely the counts of the k-mers of all reads are if ten are expected."""
    bins = kmers.count_kmers(reads(spark, sf_dir), K).groupBy(F.col("n").alias("k")).agg(F.count("*").alias("n_kmers"))
    return bins.select("k", F.round(graph.poisson_pdf(F.col("k"), 10.0), 12).alias("p"), "n_kmers")


@query(
    f"""WITH {SQL}, {_kmers(K)}, c AS (SELECT kmer, count(*) AS n FROM canon GROUP BY kmer),
    ref AS (SELECT translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM benchmark WHERE text IS NOT NULL),
    q AS (SELECT DISTINCT substr(seq, CAST(p + 1 AS BIGINT), {K}) AS kmer FROM (SELECT seq, unnest(range(0, length(seq) - {K - 1})) AS p FROM ref))
    SELECT q.kmer, c.n IS NOT NULL AS found, coalesce(c.n > 1, false) AS multi FROM q LEFT JOIN c ON {_canonical('q.kmer')} = c.kmer"""
)
def kmer_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-mers of the benchmark, looked up among those of the reads."""
    asked = sequence.explode_kmers(dna(spark, sf_dir, "benchmark", "item_id"), K).select("kmer").distinct()
    return kmers.probe(asked, kmers.count_kmers(reads(spark, sf_dir), K))


# de Bruijn graphs

_ARCS = f"""wide AS (SELECT substr(seq, CAST(p + 1 AS BIGINT), {GRAPH_K + 1}) AS e FROM (SELECT seq, unnest(range(0, length(seq) - {GRAPH_K})) AS p FROM lowreads)),
arcs AS (SELECT left(e, {GRAPH_K}) AS src, right(e, {GRAPH_K}) AS dst, count(*) AS cov FROM (SELECT e FROM wide UNION ALL SELECT {_RC.format('e')} FROM wide) GROUP BY e)"""


@query(f"WITH {SQL}, {_LOW}, {_ARCS} SELECT src, dst, cov FROM arcs")
def arc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.arcs(_low_reads(spark, sf_dir), GRAPH_K)


_LINKS = f"""o AS (SELECT src, min(dst) AS dst FROM arcs GROUP BY src HAVING count(*) = 1), i AS (SELECT dst FROM arcs GROUP BY dst HAVING count(*) = 1),
links AS (SELECT src, dst FROM o JOIN i USING (dst) WHERE src <> dst AND dst <> {_RC.format('src')})"""


@query(f"WITH {SQL}, {_LOW}, {_ARCS}, {_LINKS} SELECT src, dst FROM links")
def unique_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unique_links(graph.arcs(_low_reads(spark, sf_dir), GRAPH_K))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.build(_low_reads(spark, sf_dir), GRAPH_K)


# ids are hashes, so results name nodes by their sequence; paths are walked from their heads, rings from their largest k-mer
_KEY = "CASE WHEN {0} <= {1} THEN '1' || {0} ELSE '0' || translate({1}, 'ACGT', 'TGCA') END"
_NODES = f"""{SQL}, {_LOW}, {_kmers(GRAPH_K, 'lowreads')}, {_ARCS}, {_LINKS},
counts AS (SELECT kmer, count(*) AS n FROM canon GROUP BY kmer),
om AS (SELECT kmer, n, {_KEY.format('kmer', _RC.format('kmer'))} AS key FROM (SELECT kmer, n FROM counts UNION ALL SELECT {_RC.format('kmer')}, n FROM counts)),
walk AS (SELECT kmer AS top, kmer AS node, kmer AS seq, n AS cov FROM om WHERE kmer NOT IN (SELECT dst FROM links)
    UNION ALL SELECT top, dst, seq || right(dst, 1), cov + om.n FROM walk JOIN links ON node = src JOIN om ON dst = om.kmer),
ringed AS (SELECT kmer, key FROM om WHERE kmer NOT IN (SELECT node FROM walk)),
ring AS (SELECT kmer AS start, kmer AS node, key FROM ringed UNION SELECT start, dst, om.key FROM ring JOIN links ON node = src JOIN om ON dst = om.kmer),
low_of AS (SELECT DISTINCT arg_max(node, key) AS top FROM ring GROUP BY start),
round AS (SELECT top, top AS node, top AS seq, n AS cov, key AS best, {_KEY.format(_RC.format('top'), 'top')} AS other FROM low_of JOIN om ON top = kmer
    UNION ALL SELECT top, dst, seq || right(dst, 1), cov + om.n, greatest(best, om.key), greatest(other, {_KEY.format(_RC.format('dst'), 'dst')}) FROM round JOIN links ON node = src JOIN om ON dst = om.kmer WHERE dst <> top),
nodes AS (SELECT arg_max(seq, length(seq)) AS seq, max(cov) AS kmer_cov, max(length(seq)) - {GRAPH_K - 1} AS n FROM walk GROUP BY top HAVING arg_max(seq, length(seq)) <= {_RC.format('arg_max(seq, length(seq))')}
    UNION ALL SELECT arg_max(seq, length(seq)), max(cov), max(length(seq)) - {GRAPH_K - 1} FROM round GROUP BY top HAVING arg_max(best, length(seq)) >= arg_max(other, length(seq))),
both_ends AS (SELECT seq, 1 AS strand, left(seq, {GRAPH_K}) AS first, right(seq, {GRAPH_K}) AS last FROM nodes
    UNION ALL SELECT seq, -1, left({_RC.format('seq')}, {GRAPH_K}), right({_RC.format('seq')}, {GRAPH_K}) FROM nodes),
node_arcs AS (SELECT s.seq AS src, s.strand AS src_strand, d.seq AS dst, d.strand AS dst_strand, cov FROM arcs JOIN both_ends s ON arcs.src = s.last JOIN both_ends d ON arcs.dst = d.first),
sided AS (SELECT seq, kmer_cov, n, kmer_cov / n AS avg, coalesce(l, 0) AS n_left, coalesce(r, 0) AS n_right FROM nodes LEFT JOIN (SELECT src AS seq, count(*) FILTER (src_strand = -1) AS l, count(*) FILTER (src_strand = 1) AS r FROM node_arcs GROUP BY src) USING (seq))"""


def _named(nodes: DataFrame, signed: str, name: str) -> DataFrame:
    """The key to join by, the sequence and, by the sign of the column ``signed``, the strand of a node."""
    return nodes.select(F.col("id").alias(f"{signed}_id"), F.col("seq").alias(name))


def _arcs_by_sequence(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    keyed = arcs.withColumns({"src_id": F.abs("src"), "dst_id": F.abs("dst"), "src_strand": F.signum("src").cast("int"), "dst_strand": F.signum("dst").cast("int")}).drop("src", "dst")
    return keyed.join(_named(nodes, "src", "src"), "src_id").join(_named(nodes, "dst", "dst"), "dst_id").drop("src_id", "dst_id")


@query(f"WITH RECURSIVE {_NODES} SELECT seq, CAST(kmer_cov AS BIGINT) AS kmer_cov FROM nodes")
def unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0].select("seq", "kmer_cov")


@query(f"WITH RECURSIVE {_NODES} SELECT src, src_strand, dst, dst_strand, cov FROM node_arcs")
def node_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arcs_by_sequence(*_graph(spark, sf_dir)).select("src", "src_strand", "dst", "dst_strand", "cov")


_PLACES = f"""places AS (SELECT seq, strand, CAST(p AS INTEGER) AS node_pos, substr(s, CAST(p + 1 AS BIGINT), {GRAPH_K}) AS kmer FROM (SELECT seq, strand, s, unnest(range(0, length(s) - {GRAPH_K - 1})) AS p
    FROM (SELECT seq, 1 AS strand, seq AS s FROM nodes UNION ALL SELECT seq, -1, {_RC.format('seq')} FROM nodes))),
positions AS (SELECT pair_id, mate, pos, places.seq AS node, strand, node_pos FROM kmers JOIN places USING (kmer))"""


@query(f"WITH RECURSIVE {_NODES}, {_PLACES} SELECT node, count(*) AS kmer_cov, count(*) FILTER (pos = 0) AS read_start_cov FROM positions GROUP BY node")
def node_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = _low_reads(spark, sf_dir)
    nodes = graph.unitigs(low, GRAPH_K)
    found = graph.started(low, nodes, GRAPH_K)
    return found.join(nodes.select(F.col("id").alias("node"), "seq"), "node").select(F.col("seq").alias("node"), "kmer_cov", "read_start_cov")


@query(f"WITH RECURSIVE {_NODES}, {_PLACES} SELECT pair_id, mate, pos, node, strand, node_pos FROM positions")
def npp_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each k-mer of each low-complexity read lies in the graph."""
    low = _low_reads(spark, sf_dir)
    nodes = graph.unitigs(low, GRAPH_K)
    found = graph.read_positions(low, nodes, GRAPH_K, "pair_id", "mate").withColumns({"node_id": F.abs("node"), "strand": F.signum("node").cast("int")}).drop("node")
    return found.join(_named(nodes, "node", "node"), "node_id").select("pair_id", "mate", "pos", "node", "strand", "node_pos")


@query(f"WITH RECURSIVE {_NODES}, lengths AS (SELECT n, sum(n) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS upto FROM nodes) SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT CAST(sum(n) AS BIGINT) FROM nodes) AS total_length, CAST(min(n) AS INTEGER) AS n50 FROM lengths WHERE upto * 2 >= (SELECT sum(n) FROM nodes)")
def graph_stats_n50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.n50(_graph(spark, sf_dir)[0], GRAPH_K)


@query(f"WITH RECURSIVE {_NODES} SELECT coalesce(CAST(sum(kmer_cov) AS DOUBLE) / sum(n), 4.0) AS estimate FROM sided WHERE avg >= {graph.initial_cutoff()}")
def initial_cov_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.initial_coverage(_graph(spark, sf_dir)[0])


@query(f"WITH RECURSIVE {_NODES} SELECT CAST(sum(kmer_cov) AS DOUBLE) / sum(n) AS avg_cov FROM sided WHERE avg > 2 AND length(seq) + 1 > 31")
def node_cov_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_average(_graph(spark, sf_dir)[0])


@query(f"WITH RECURSIVE {_NODES}, a AS (SELECT CAST(sum(kmer_cov) AS DOUBLE) / sum(n) AS a FROM sided WHERE avg > 2 AND length(seq) + 1 > 31) SELECT seq, CAST(CASE WHEN avg < 2 THEN 0 ELSE greatest(1, round(avg / a)) END AS INTEGER) AS multiplicity FROM sided, a")
def expected_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _graph(spark, sf_dir)[0]
    average = graph.node_average(nodes).crossJoin(nodes.select("seq", graph.average_coverage().alias("cov")))  # one row
    return average.select("seq", graph.expected_multiplicity(F.col("avg_cov"), F.col("cov"), F.lit(2.0)).alias("multiplicity"))


@query(f"WITH RECURSIVE {_NODES} SELECT seq, n, avg AS avg_cov, n_left, n_right FROM sided")
def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, arcs = _graph(spark, sf_dir)
    return graph.sides(nodes, arcs).select("seq", "n", graph.average_coverage().alias("avg_cov"), "n_left", "n_right")


@query(f"WITH RECURSIVE {_NODES} SELECT seq, CAST(kmer_cov AS BIGINT) AS kmer_cov, n_left, n_right FROM sided WHERE n_left = 0 OR n_right = 0")
def dead_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dead_ends(graph.sides(*_graph(spark, sf_dir))).select("seq", "kmer_cov", "n_left", "n_right")


@query(f"WITH RECURSIVE {_NODES} SELECT seq, CAST(kmer_cov AS BIGINT) AS kmer_cov FROM sided WHERE n_left = 1 AND n_right = 1 AND seq IN (SELECT src FROM node_arcs WHERE src = dst AND src_strand = dst_strand)")
def self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, arcs = _graph(spark, sf_dir)
    return graph.self_loops(graph.sides(nodes, arcs), arcs).select("seq", "kmer_cov")


_CYCLES = "cycles AS (SELECT x.src, x.src_strand, x.dst, x.dst_strand FROM node_arcs x JOIN node_arcs y ON x.src = y.dst AND x.src_strand = y.dst_strand AND x.dst = y.src AND x.dst_strand = y.src_strand WHERE x.src <> x.dst)"


@query(f"WITH RECURSIVE {_NODES}, {_CYCLES} SELECT * FROM cycles")
def two_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, arcs = _graph(spark, sf_dir)
    return _arcs_by_sequence(nodes, graph.two_cycles(arcs)).select("src", "src_strand", "dst", "dst_strand")


_TIPS = f"""{_CYCLES}, small AS (SELECT * FROM sided WHERE avg <= 1 AND n <= {GRAPH_K + 1}),
rivals AS (SELECT a.dst, a.dst_strand, a.src, s.avg FROM node_arcs a JOIN sided s ON a.src = s.seq),
gone AS (SELECT seq FROM small WHERE n_left = 1 AND n_right = 1 AND (seq IN (SELECT src FROM node_arcs WHERE src = dst AND src_strand = dst_strand) OR seq IN (SELECT src FROM cycles))
    UNION SELECT seq FROM small WHERE least(n_left, n_right) = 0 AND n_left + n_right <> 1
    UNION SELECT m.seq FROM small m JOIN node_arcs a ON a.src = m.seq WHERE least(n_left, n_right) = 0 AND n_left + n_right = 1 AND EXISTS (SELECT 1 FROM rivals r WHERE r.dst = a.dst AND r.dst_strand = a.dst_strand AND r.src <> m.seq AND r.avg > m.avg))"""


@query(f"WITH RECURSIVE {_NODES}, {_TIPS} SELECT seq, CAST(kmer_cov AS BIGINT) AS kmer_cov FROM nodes WHERE seq NOT IN (SELECT seq FROM gone)")
def clipped_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass; of equally covered tips at one place all stay."""
    return graph.clip_tips(*_graph(spark, sf_dir), 1.0, GRAPH_K + 1)[0].select("seq", "kmer_cov")


@query(
    f"""WITH RECURSIVE {_NODES}, {_PLACES}, started AS (SELECT node AS seq, count(*) FILTER (pos = 0) AS s FROM positions GROUP BY node),
    ranked AS (SELECT n, s, row_number() OVER (ORDER BY n DESC, seq) AS nth, sum(n) OVER (ORDER BY n DESC, seq) - n AS before FROM nodes JOIN started USING (seq)),
    rate AS (SELECT avg(s / n) AS mean FROM ranked WHERE nth <= 100 AND (nth <= 30 OR before < 0.05 * (SELECT sum(n) FROM nodes))),
    scored AS (SELECT seq, n, s, m, abs(s - m * mean * n) / sqrt(m * mean * n) AS z FROM (SELECT seq, n, s, mean, unnest(range(1, 11)) AS m FROM nodes JOIN started USING (seq), rate)),
    better AS (SELECT *, z < least(3.5, coalesce(min(z) OVER (PARTITION BY seq ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 3.5)) AS b FROM scored)
    SELECT seq, n, s AS read_start_cov, CAST(CASE WHEN count(*) FILTER (b) = 1 AND min(z) FILTER (b) < 3.0 THEN min(m) FILTER (b) ELSE 0 END AS INTEGER) AS multiplicity FROM better GROUP BY seq, n, s"""
)
def multiplicity_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each node occurs by the read starts in it, against the rate of the longest nodes."""
    low = _low_reads(spark, sf_dir)
    nodes = graph.unitigs(low, GRAPH_K)
    started = graph.started(low, nodes, GRAPH_K)
    rows = cut(nodes.join(started.select(F.col("node").alias("id"), "read_start_cov"), "id").select(F.col("seq").alias("id"), "n", "read_start_cov"))
    mean = graph.read_start_statistics(rows).first()["mean"]
    return graph.multiplicity_by_score(rows, mean or 0.0).select(F.col("id").alias("seq"), "n", "read_start_cov", "multiplicity")


@query(
    f"""WITH RECURSIVE {_NODES}, refs AS (SELECT item_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS ref FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
    asked AS (SELECT {_canonical(f'substr(ref, CAST(p + 1 AS BIGINT), {GRAPH_K})')} AS kmer FROM (SELECT ref, unnest(range(0, length(ref) - {GRAPH_K - 1})) AS p FROM refs)),
    own AS (SELECT seq, n, {_canonical(f'substr(seq, CAST(p + 1 AS BIGINT), {GRAPH_K})')} AS kmer FROM (SELECT seq, n, unnest(range(0, length(seq) - {GRAPH_K - 1})) AS p FROM nodes)),
    hits AS (SELECT seq, count(*) AS h FROM own JOIN asked USING (kmer) GROUP BY seq)
    SELECT seq AS node, CAST(round(coalesce(h, 0) / n) AS INTEGER) AS multiplicity FROM nodes LEFT JOIN hits USING (seq)"""
)
def true_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the references of the benchmark hold each node of the low-complexity reads."""
    nodes = graph.unitigs(_low_reads(spark, sf_dir), GRAPH_K)
    references = dna(spark, sf_dir, "benchmark", "item_id").withColumnRenamed("doc_id", "item_id")
    hits = graph.read_positions(references, nodes, GRAPH_K, "item_id").select(F.abs("node").alias("id")).join(nodes.select("id", "seq"), "id")
    return chains.true_multiplicity(hits.select(F.col("seq").alias("node")), nodes, GRAPH_K)


@query(
    f"""WITH {SQL}, {_kmers(K)}, c AS (SELECT kmer, count(*) AS n FROM canon GROUP BY kmer),
    ref AS (SELECT translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq FROM benchmark WHERE text IS NOT NULL),
    t AS (SELECT DISTINCT {_canonical(f'substr(seq, CAST(p + 1 AS BIGINT), {K})')} AS kmer, true AS real FROM (SELECT seq, unnest(range(0, length(seq) - {K - 1})) AS p FROM ref)),
    b AS (SELECT coalesce(real, false) AS real, coalesce(n > 1, false) AS kept FROM c FULL JOIN t USING (kmer)),
    s AS (SELECT count(*) FILTER (real AND kept) AS tp, count(*) FILTER (NOT real AND kept) AS fp, count(*) FILTER (NOT real AND NOT kept) AS tn, count(*) FILTER (real AND NOT kept) AS fn FROM b)
    SELECT round(tp / nullif(tp + fn, 0), 9) AS sensitivity, round(tn / nullif(tn + fp, 0), 9) AS specificity FROM s"""
)
def kmer_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well "seen twice" tells the k-mers of the benchmark from others."""
    counts = kmers.count_kmers(reads(spark, sf_dir), K)
    real = sequence.explode_kmers(dna(spark, sf_dir, "benchmark", "item_id"), K).select(sequence.canonical(F.col("kmer")).alias("kmer")).distinct().withColumn("real", F.lit(True))
    both = counts.join(real, "kmer", "full").select(F.coalesce("real", F.lit(False)).alias("real"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("kept"))
    cases = {"tp": "real and kept", "fp": "not real and kept", "tn": "not real and not kept", "fn": "real and not kept"}
    found = kmers.rates(both.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in cases.items()]))
    return found.select(*[F.round(c, 9).alias(c) for c in ("sensitivity", "specificity")])


_TIP_LONGEST = 60
_BASE = "greatest(r[e] + CASE WHEN substr(a, i + 1, 1) = substr(b, i + e - 2, 1) THEN 1 ELSE -1 END, r[e + 1] - 3)"
_ALIGNED = f"""{_CYCLES}, small AS (SELECT * FROM sided WHERE avg <= 2 AND n <= {_TIP_LONGEST}),
certain AS (SELECT seq FROM small WHERE n_left = 1 AND n_right = 1 AND (seq IN (SELECT src FROM node_arcs WHERE src = dst AND src_strand = dst_strand) OR seq IN (SELECT src FROM cycles))
    UNION SELECT seq FROM small WHERE least(n_left, n_right) = 0 AND n_left + n_right <> 1),
ways AS (SELECT * FROM node_arcs WHERE src NOT IN (SELECT seq FROM certain) AND dst NOT IN (SELECT seq FROM certain)),
tips AS (SELECT seq, avg FROM small WHERE seq NOT IN (SELECT seq FROM certain) AND seq IN (SELECT src FROM ways GROUP BY src HAVING count(*) = 1)),
beside AS (SELECT t.seq AS tip, t.avg, x.dst, x.dst_strand, y.src AS other, CASE WHEN x.src_strand = 1 THEN t.seq ELSE {_RC.format('t.seq')} END AS ts, CASE WHEN y.src_strand = 1 THEN y.src ELSE {_RC.format('y.src')} END AS os, least(length(ts), length(os)) AS m
    FROM tips t JOIN ways x ON x.src = t.seq JOIN ways y ON y.dst = x.dst AND y.dst_strand = x.dst_strand AND y.src <> t.seq),
texts AS (SELECT tip, avg, dst, dst_strand, other, left(right(ts, m), m - {GRAPH_K - 1}) AS a, left(right(os, m), m - {GRAPH_K - 1}) AS b FROM beside),
cells AS (SELECT a, b, CAST(0 AS BIGINT) AS i, CAST([NULL, NULL, 0, -3, -6] AS INTEGER[]) AS r FROM (SELECT DISTINCT a, b FROM texts WHERE length(a) >= {GRAPH_K})
    UNION ALL SELECT a, b, i + 1, list_transform(range(1, 6), lambda d: CASE WHEN i + d - 2 BETWEEN 0 AND length(a) THEN list_max(list_transform(range(1, d + 1), lambda e: CASE WHEN i + e - 2 >= 0 THEN {_BASE} - 3 * (d - e) END)) END) FROM cells WHERE i < length(a)),
alike AS (SELECT t.* FROM texts t LEFT JOIN cells c ON t.a = c.a AND t.b = c.b AND c.i = length(c.a) WHERE length(t.a) < {GRAPH_K} OR c.r[3] > 0),
turns AS (SELECT dst, dst_strand, tip, list(other) AS others, row_number() OVER (PARTITION BY dst, dst_strand ORDER BY avg, tip) AS nth FROM alike GROUP BY dst, dst_strand, tip, avg),
passed AS (SELECT DISTINCT dst, dst_strand, CAST(0 AS BIGINT) AS nth, CAST([] AS VARCHAR[]) AS gone FROM turns
    UNION ALL SELECT t.dst, t.dst_strand, t.nth, CASE WHEN len(list_filter(t.others, lambda x: NOT list_contains(p.gone, x))) > 0 THEN list_append(p.gone, t.tip) ELSE p.gone END FROM passed p JOIN turns t ON t.dst = p.dst AND t.dst_strand = p.dst_strand AND t.nth = p.nth + 1)"""


@query(f"WITH RECURSIVE {_NODES}, {_ALIGNED} SELECT seq, CAST(kmer_cov AS BIGINT) AS kmer_cov FROM nodes WHERE seq IN (SELECT seq FROM certain UNION SELECT unnest(gone) FROM passed)")
def aligned_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tips that one sequential pass by alignment with what is beside them takes away."""
    nodes, arcs = _graph(spark, sf_dir)
    return nodes.join(graph.aligned_tips(nodes, arcs, GRAPH_K, 2.0, _TIP_LONGEST), "id").select("seq", "kmer_cov")


_FITTED_GRAPH = f"""{_NODES}, hist AS (SELECT 1 AS one, n AS cov, count(*) AS n_kmers FROM counts GROUP BY n), {_mixture('hist', 'one')}, {_CUTOFF.format('one')},
model AS (SELECT fitted.*, cutoff, avg_cov FROM fitted JOIN cutoffs USING (one), (SELECT CAST(sum(kmer_cov) AS DOUBLE) / sum(n) AS avg_cov FROM sided WHERE avg > 2 AND length(seq) + 1 > 31))"""
_MULTIPLICITY = "CASE WHEN {0} < cutoff THEN 0 ELSE greatest(1, round({0} / avg_cov)) END"


def _observed(x: str, m: str) -> str:
    return f"CASE WHEN {m} = 0 THEN {_part(x, 0)} + {_part(x, 1)} WHEN {m} = 1 THEN {_part(x, 2)} WHEN {m} = 2 THEN {_part(x, 3)} ELSE {_part(x, 2, m)} END"


@query(
    f"""WITH RECURSIVE {_FITTED_GRAPH},
    judged AS (SELECT a.*, {_MULTIPLICITY.format('cov')} AS m FROM node_arcs a, model),
    sums AS (SELECT src, src_strand, count(*) AS ways, sum(greatest(m, 1)) AS s, count(*) FILTER (m = 0) AS weak, sum(CASE WHEN m = 0 THEN {_observed('cov', '0')} - ({_observed('cov', '1')}) ELSE 0 END) AS g FROM judged, model GROUP BY src, src_strand),
    open AS (SELECT src, src_strand, g, s, floor(avg) AS x, {_MULTIPLICITY.format('avg')} AS nm FROM sums JOIN sided ON src = seq, model WHERE ways > 1 AND weak > 0),
    gains AS (SELECT src, src_strand, g + {_observed('x', 'nm')} - ({_observed('x', 's')}) AS gain FROM open, model WHERE nm > 0)
    SELECT src, src_strand, dst, dst_strand, round(gain, 4) AS gain FROM judged JOIN gains USING (src, src_strand) WHERE m = 0 AND gain >= 5"""
)
def unlikely_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs that the fitted spectrum of the low-complexity reads speaks against."""
    low = _low_reads(spark, sf_dir)
    nodes, arcs = graph.build(low, GRAPH_K)
    bins = kmers.count_kmers(low, GRAPH_K).groupBy(F.lit(1).alias("one"), F.col("n").alias("cov")).agg(F.count("*").alias("n_kmers"))
    fit = spectrum.summary(spectrum.fit(spectrum.with_coverage(bins, "one"), "one")).join(graph.node_average(nodes))  # one row each
    found = _arcs_by_sequence(nodes, flow.unlikely_arcs(nodes, arcs, cut(fit.select("mean", "variance", "mass", "cutoff", "avg_cov"))))
    return found.select("src", "src_strand", "dst", "dst_strand", F.round("gain", 4).alias("gain"))


@query(
    f"""WITH RECURSIVE {_NODES}, a AS (SELECT CAST(sum(kmer_cov) AS DOUBLE) / sum(n) AS a FROM sided WHERE avg > 2 AND length(seq) + 1 > 31),
    counted AS (SELECT seq, n, avg, CASE WHEN avg < 2 THEN 0 ELSE greatest(1, round(avg / a)) END AS m FROM sided, a),
    known AS (SELECT seq, m, avg >= 2 AND n >= 8 AND m BETWEEN 1 AND 4 AS sure FROM counted),
    ways AS (SELECT r.src, r.src_strand, r.dst, r.dst_strand, cov, s.m, s.m = d.m AND d.sure AS same, substr(CASE WHEN dst_strand = 1 THEN dst ELSE {_RC.format('dst')} END, {GRAPH_K}, 1) AS letter FROM node_arcs r JOIN known s ON r.src = s.seq AND s.sure JOIN known d ON r.dst = d.seq),
    kept AS (SELECT src, src_strand, min(letter) FILTER (same) AS trusted FROM ways GROUP BY src, src_strand, m HAVING count(*) > 1 AND count(*) >= m)
    SELECT src, src_strand, dst, dst_strand FROM ways JOIN kept USING (src, src_strand) WHERE letter <> trusted AND cov < 2 QUALIFY row_number() OVER (PARTITION BY src, src_strand ORDER BY letter) = 1"""
)
def chimeric_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak ways out of nodes that another way leads on from to a node which occurs as often."""
    nodes, arcs = _graph(spark, sf_dir)
    counted = nodes.join(F.broadcast(graph.node_average(nodes)))  # one row
    known = counted.withColumn("multiplicity", graph.expected_multiplicity(F.col("avg_cov"), graph.average_coverage(), F.lit(2.0)))
    return _arcs_by_sequence(nodes, flow.chimeric_links(known, arcs, 2.0, 8, GRAPH_K)).select("src", "src_strand", "dst", "dst_strand")


@query()
def cleaned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes after the whole cleaning schedule."""
    return graph.clean(*_graph(spark, sf_dir), GRAPH_K, 2.0, 2 * GRAPH_K)[0].select("seq", "n", "kmer_cov")


@query(f"WITH RECURSIVE {_NODES} SELECT CAST(sum(n) AS BIGINT) AS n_kmers FROM nodes")
def graph_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0].agg(F.sum("n").alias("n_kmers"))


@query(
    f"""WITH RECURSIVE {_NODES}, {_PLACES}, started AS (SELECT node AS seq, count(*) FILTER (pos = 0) AS s FROM positions GROUP BY node),
    ranked AS (SELECT n, s, row_number() OVER (ORDER BY n DESC, seq) AS nth, sum(n) OVER (ORDER BY n DESC, seq) - n AS before FROM nodes JOIN started USING (seq)),
    chosen AS (SELECT s / n AS rate FROM ranked WHERE nth <= 100 AND (nth <= 30 OR before < 0.05 * (SELECT sum(n) FROM nodes)))
    SELECT round(avg(rate), 9) AS mean, round(var_samp(rate), 9) AS variance FROM chosen"""
)
def read_start_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties of length are broken by the sequence."""
    low = _low_reads(spark, sf_dir)
    nodes = graph.unitigs(low, GRAPH_K)
    started = graph.started(low, nodes, GRAPH_K)
    rows = nodes.join(started.select(F.col("node").alias("id"), "read_start_cov"), "id").select(F.col("seq").alias("id"), "n", "read_start_cov")
    return graph.read_start_statistics(rows).select(F.round("mean", 9).alias("mean"), F.round("variance", 9).alias("variance"))


@query(
    f"""WITH RECURSIVE {_NODES}, {_PLACES},
    located AS (SELECT *, length(node) - {GRAPH_K - 1} AS n FROM positions),
    lagged AS (SELECT *, lag(pos) OVER w AS p, lag(node) OVER w AS a, lag(strand) OVER w AS a_strand, lag(node_pos) OVER w AS a_pos, lag(n) OVER w AS a_n FROM located WINDOW w AS (PARTITION BY pair_id, mate ORDER BY pos)),
    turned AS (SELECT *, CASE WHEN p = pos - 1 AND ((a = node AND a_strand = strand AND node_pos = a_pos + 1)
        OR (a_pos = a_n - 1 AND node_pos = 0 AND EXISTS (SELECT 1 FROM node_arcs x WHERE x.src = a AND x.src_strand = a_strand AND x.dst = node AND x.dst_strand = strand))) THEN 0 ELSE 1 END AS new FROM lagged),
    runs AS (SELECT *, sum(new) OVER (PARTITION BY pair_id, mate ORDER BY pos) AS run FROM turned)
    SELECT pair_id, mate, min(pos) AS first, max(pos) AS last, CAST(count(*) FILTER (node_pos = 0 OR new = 1) AS INTEGER) AS n_nodes FROM runs GROUP BY pair_id, mate, run"""
)
def seed_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of each low-complexity read that the graph holds, with the number of nodes they pass."""
    low = _low_reads(spark, sf_dir)
    nodes, arcs = graph.build(low, GRAPH_K)
    found = graph.node_seeds(graph.read_positions(low, nodes, GRAPH_K, "pair_id", "mate"), arcs, "pair_id", "mate")
    return found.select("pair_id", "mate", "first", "last", F.size("chain").alias("n_nodes"))


# paths: lengths count k-mers; nodes are named by their sequence and strand

_ORIENTED = f"""oriented AS (SELECT seq, 1 AS strand, seq AS s, n, kmer_cov, n_right AS n_out, n_left AS n_in FROM sided UNION ALL SELECT seq, -1, {_RC.format('seq')}, n, kmer_cov, n_left, n_right FROM sided)"""
_LONGEST = GRAPH_K + 1


@query(
    f"""WITH RECURSIVE {_NODES}, {_ORIENTED},
    step AS (SELECT src, src_strand, dst, dst_strand, cov, n, substr(s, {GRAPH_K}) AS more, n_out, n_in, kmer_cov FROM node_arcs JOIN oriented ON dst = seq AND dst_strand = strand WHERE dst <> src OR dst_strand <> src_strand),
    branch AS (SELECT src, src_strand FROM node_arcs GROUP BY src, src_strand HAVING count(*) > 1),
    ways AS (SELECT src, src_strand, dst AS color, dst_strand AS color_strand, dst AS node, dst_strand AS strand, n AS len, more AS letters, [(dst, dst_strand)] AS path FROM step JOIN branch USING (src, src_strand)
        UNION ALL SELECT w.src, w.src_strand, color, color_strand, t.dst, t.dst_strand, len + n, min(letters || more), arg_min(list_append(path, (t.dst, t.dst_strand)), letters || more)
        FROM ways w JOIN step t ON w.node = t.src AND w.strand = t.src_strand WHERE len <= {_LONGEST} AND (t.dst <> w.src OR t.dst_strand <> w.src_strand) GROUP BY w.src, w.src_strand, color, color_strand, t.dst, t.dst_strand, len + n),
    best AS (SELECT src, src_strand, color, color_strand, node, strand, arg_min(letters, (len, letters)) AS letters, arg_min(path, (len, letters)) AS path FROM ways GROUP BY src, src_strand, color, color_strand, node, strand QUALIFY count(*) OVER (PARTITION BY src, src_strand, node, strand) > 1),
    way AS (SELECT *, row_number() OVER () AS id, coalesce(path[-2][1], src) AS fs, coalesce(path[-2][2], src_strand) AS fss FROM best),
    place AS (SELECT id, i, p[1] AS seq, p[2] AS strand FROM (SELECT id, unnest(range(1, len(path))) AS i, unnest(path[:-2]) AS p FROM way WHERE len(path) > 1)),
    inner_nodes AS (SELECT id, i, n, kmer_cov, n_out, n_in FROM place JOIN oriented USING (seq, strand)),
    cuts AS (SELECT id, len(path) - 1 AS m, coalesce(max(i) FILTER (n_out <> 1), 0) + 1 AS first, coalesce(min(i) FILTER (n_in <> 1) - 1, len(path) - 1) AS last FROM way LEFT JOIN inner_nodes USING (id) GROUP BY id, len(path)),
    own AS (SELECT id, CAST(sum(kmer_cov) AS BIGINT) / CAST(sum(n) AS BIGINT) AS cov FROM inner_nodes JOIN cuts USING (id) WHERE i BETWEEN first AND last GROUP BY id),
    w AS (SELECT way.*, own.cov, CASE WHEN last = m THEN f.cov END AS final, CASE WHEN first = 1 THEN b.cov END AS begin,
        right(o.s, {GRAPH_K - 1}) || left(letters, length(letters) - length(way.node) + {GRAPH_K - 1}) AS spelled
        FROM way JOIN cuts USING (id) LEFT JOIN own USING (id) JOIN oriented o ON way.src = o.seq AND way.src_strand = o.strand
        JOIN node_arcs f ON f.src = fs AND f.src_strand = fss AND f.dst = way.node AND f.dst_strand = way.strand JOIN node_arcs b ON b.src = way.src AND b.src_strand = way.src_strand AND b.dst = color AND b.dst_strand = color_strand),
    named AS (SELECT * REPLACE ({_canonical('spelled')} AS spelled) FROM w),
    meets AS (SELECT a.src, a.src_strand, a.node AS dst, a.strand AS dst_strand, a.spelled AS sa, b.spelled AS sb, a.cov AS ca, b.cov AS cb, a.final AS fa, b.final AS fb, a.begin AS ba, b.begin AS bb
        FROM named a JOIN named b ON a.src = b.src AND a.src_strand = b.src_strand AND a.node = b.node AND a.strand = b.strand AND a.id < b.id WHERE a.fs <> b.fs OR a.fss <> b.fss),
    judged AS (SELECT *, CASE WHEN ca IS NOT NULL AND cb IS NOT NULL AND least(ca, cb) <= 2 THEN 'NODES' WHEN least(fa, fb) <= 2 THEN 'FINAL' WHEN least(ba, bb) <= 2 THEN 'FIRST' END AS lost FROM meets),
    valued AS (SELECT *, CASE lost WHEN 'NODES' THEN ca WHEN 'FINAL' THEN fa ELSE ba END AS x, CASE lost WHEN 'NODES' THEN cb WHEN 'FINAL' THEN fb ELSE bb END AS y FROM judged WHERE lost IS NOT NULL)
    SELECT src, src_strand, dst, dst_strand, lost, CASE WHEN goes THEN sb ELSE sa END AS kept, CASE WHEN goes THEN sa ELSE sb END AS gone
    FROM (SELECT *, CASE WHEN x = y THEN sa > sb ELSE coalesce(x < y, y IS NULL) END AS goes FROM valued)"""
)
def parallel_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways between the same two nodes, branches inside included, and what a pass of bubble removal takes of the weaker one."""
    nodes, arcs = _graph(spark, sf_dir)
    found = paths.parallel_paths(nodes, arcs, GRAPH_K, 2.0, _LONGEST)
    return _arcs_by_sequence(nodes, found).select("src", "src_strand", "dst", "dst_strand", "lost", "kept", "gone")


# the references of the benchmark against the graph of the low-complexity reads

_BREAKS = f"""{_NODES}, {_PLACES.replace('positions AS', 'read_places AS')},
wanted AS (SELECT item_id, seq AS ref, length(seq) - {GRAPH_K} AS stop FROM (SELECT item_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL) WHERE length(seq) >= {GRAPH_K}),
windows AS (SELECT item_id, CAST(p AS INTEGER) AS pos, substr(ref, CAST(p + 1 AS BIGINT), {GRAPH_K}) AS kmer FROM (SELECT item_id, ref, unnest(range(0, stop + 1)) AS p FROM wanted)),
held AS (SELECT item_id, pos, places.seq AS node, strand, node_pos, length(places.seq) - {GRAPH_K - 1} AS n FROM windows JOIN places USING (kmer)),
lagged AS (SELECT *, lag(pos) OVER w AS p, lag(node) OVER w AS a, lag(strand) OVER w AS a_strand, lag(node_pos) OVER w AS a_pos, lag(n) OVER w AS a_n FROM held WINDOW w AS (PARTITION BY item_id ORDER BY pos)),
turned AS (SELECT *, CASE WHEN p = pos - 1 AND ((a = node AND a_strand = strand AND node_pos = a_pos + 1)
    OR (a_pos = a_n - 1 AND node_pos = 0 AND EXISTS (SELECT 1 FROM node_arcs x WHERE x.src = a AND x.src_strand = a_strand AND x.dst = node AND x.dst_strand = strand))) THEN 0 ELSE 1 END AS new FROM lagged),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY item_id ORDER BY pos) AS run FROM turned),
contigs AS (SELECT item_id, run, min(pos) AS first, max(pos) AS last, arg_min((node, strand, node_pos, n), pos) AS a, arg_max((node, strand, node_pos, n), pos) AS b FROM numbered GROUP BY item_id, run),
gaps AS (SELECT item_id, lag(last) OVER w + 1 AS first, first - 1 AS last, lag(b) OVER w AS b, a FROM contigs WINDOW w AS (PARTITION BY item_id ORDER BY run)),
asked AS (SELECT *, greatest(100, 2 * (last - first + 1)) AS most FROM gaps WHERE first IS NOT NULL),
num AS MATERIALIZED (SELECT seq, n, row_number() OVER (ORDER BY seq) AS id FROM sided),
step AS MATERIALIZED (SELECT s.id * src_strand AS node, d.id * dst_strand AS next, d.n FROM node_arcs JOIN num s ON src = s.seq JOIN num d ON dst = d.seq),
both_ways AS MATERIALIZED (SELECT item_id, first, row_number() OVER (ORDER BY item_id, first) * way AS key, way, most, way * b[2] * x.id AS src, CASE WHEN way = 1 THEN b[3] ELSE b[4] - 1 - b[3] END AS sp, b[4] AS sn, way * a[2] * y.id AS dst, CASE WHEN way = 1 THEN a[3] ELSE a[4] - 1 - a[3] END AS dp
    FROM asked JOIN num x ON b[1] = x.seq JOIN num y ON a[1] = y.seq, (VALUES (1), (-1)) w(way)),
reach AS (SELECT key, src AS node, sn - sp AS dist, dst, most - dp AS room FROM both_ways WHERE sn - sp <= most - dp AND NOT (src = dst AND sp <= dp AND dp - sp <= most)
    UNION SELECT key, next, dist + n, dst, room FROM reach JOIN step USING (node) WHERE dist + n <= room),
met AS (SELECT key, dp - sp AS distance FROM both_ways WHERE src = dst AND sp <= dp AND dp - sp <= most
    UNION ALL SELECT key, min(dist) + (SELECT dp FROM both_ways w WHERE w.key = r.key) FROM reach r JOIN step USING (node) WHERE next = dst GROUP BY key),
shortest AS (SELECT item_id, first, coalesce(min(distance) FILTER (way = 1), min(distance)) AS distance FROM met JOIN both_ways USING (key) GROUP BY item_id, first),
outer_ends AS (SELECT item_id, stop, min(first) AS low, max(last) AS high FROM wanted LEFT JOIN contigs USING (item_id) GROUP BY item_id, stop)"""


@query(
    f"""WITH RECURSIVE {_BREAKS}
    SELECT item_id, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, 'CONTIG' AS kind, CAST(NULL AS BIGINT) AS distance FROM contigs
    UNION ALL SELECT item_id, first, last, CASE WHEN distance IS NULL THEN 'BREAK' WHEN last < first THEN 'INSERTION' WHEN a[1] = b[1] AND a[2] = b[2] AND a[3] = b[3] THEN 'DELETION' ELSE 'PARALLEL' END, distance FROM asked LEFT JOIN shortest USING (item_id, first)
    UNION ALL SELECT item_id, 0, low - 1, 'DELETION', NULL FROM outer_ends WHERE low > 0 UNION ALL SELECT item_id, high + 1, stop, 'DELETION', NULL FROM outer_ends WHERE high < stop
    UNION ALL SELECT item_id, 0, stop, 'DELETION', NULL FROM outer_ends WHERE low IS NULL"""
)
def break_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references as runs that the graph of the low-complexity reads holds and breaks of four kinds."""
    nodes, arcs = _graph(spark, sf_dir)
    references = dna(spark, sf_dir, "benchmark", "item_id").withColumnRenamed("doc_id", "item_id")
    return paths.annotated_breaks(references, nodes, arcs, GRAPH_K, "item_id").select("item_id", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"), "kind", "distance")


# exact matches of the references of the benchmark with the nodes of the low-complexity reads

_LEAST = 11
_MATCHES = f"""{_NODES},
refs AS (SELECT item_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS ref FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
here AS (SELECT item_id, CAST(p AS INTEGER) AS pos, substr(ref, CAST(p + 1 AS BIGINT), {_LEAST}) AS word FROM (SELECT item_id, ref, unnest(range(0, length(ref) - {_LEAST - 1})) AS p FROM refs)),
there AS (SELECT seq, strand, n, CAST(p AS INTEGER) AS node_pos, substr(s, CAST(p + 1 AS BIGINT), {_LEAST}) AS word FROM (SELECT seq, strand, n, s, unnest(range(0, length(s) - {_LEAST - 1})) AS p
    FROM (SELECT seq, 1 AS strand, n, seq AS s FROM nodes UNION ALL SELECT seq, -1, n, {_RC.format('seq')} FROM nodes))),
met AS (SELECT item_id, seq, strand, n, node_pos, pos, pos - row_number() OVER (PARTITION BY item_id, seq, strand, node_pos - pos ORDER BY pos) AS run FROM here JOIN there USING (word)),
found AS (SELECT item_id, seq, strand, n, min(node_pos) AS nf, min(pos) AS rf, count(*) + {_LEAST - 1} AS len FROM met GROUP BY item_id, seq, strand, n, node_pos - pos, run),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY len DESC) AS nth FROM found),
asked AS (SELECT item_id, greatest({_LEAST}, least({GRAPH_K - 1}, coalesce(max(len) FILTER (nth = 100), {_LEAST}))) AS asked FROM ranked GROUP BY item_id),
fit AS (SELECT f.* FROM found f JOIN asked USING (item_id) JOIN refs USING (item_id) WHERE len >= asked AND nf < n AND rf < length(ref) - {GRAPH_K - 1}),
parted AS (SELECT *, CASE WHEN nf - rf = lag(nf - rf) OVER w THEN 0 ELSE 1 END AS new FROM fit WINDOW w AS (PARTITION BY item_id, seq, strand ORDER BY nf, rf)),
seeded AS (SELECT *, sum(new) OVER (PARTITION BY item_id, seq, strand ORDER BY nf, rf) AS seed FROM parted),
merged AS (SELECT item_id, seq, strand, min(nf) AS node_first, min(rf) AS first, arg_max(rf + len, nf) AS stop FROM seeded GROUP BY item_id, seq, strand, seed)"""


@query(
    f"""WITH RECURSIVE {_MATCHES}, top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY stop - first DESC, first, node_first, seq, strand DESC) AS rank FROM merged)
    SELECT item_id, seq AS node, CAST(strand AS INTEGER) AS strand, node_first, first, CAST(stop - least({GRAPH_K - 1}, stop - first - 1) AS INTEGER) AS stop, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 10"""
)
def exact_match_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten longest seeds of each reference, from matches whose least length shrinks until there are a hundred."""
    references = dna(spark, sf_dir, "benchmark", "item_id").withColumnRenamed("doc_id", "item_id")
    found = matches.exact_seeds(references, _graph(spark, sf_dir)[0], GRAPH_K, "item_id", least=_LEAST)
    return found.select("item_id", F.col("node_seq").alias("node"), F.signum("node").cast("int").alias("strand"), "node_first", "first", F.col("end").cast("int").alias("stop"), "rank")


# the ends of reads, aligned to the paths that go on from their longest run in the graph of k-mers seen twice; the SQL goes
# letter by letter over k-mers, the query node by node

_B, _T = graph_alignment.BAND, graph_alignment.LEAST_TENTHS
_ALIGNMENT = f"""{SQL}, {_LOW}, {_kmers(GRAPH_K, 'lowreads')}, {_ARCS},
solid AS (SELECT src, dst FROM arcs WHERE cov >= 2), good AS (SELECT kmer FROM canon GROUP BY kmer HAVING count(*) >= 2),
held AS (SELECT pair_id, mate, seq, pos, kmer, lag(pos) OVER w AS p, lag(kmer) OVER w AS before FROM kmers WHERE {_canonical('kmer')} IN (SELECT kmer FROM good) WINDOW w AS (PARTITION BY pair_id, mate ORDER BY pos)),
turned AS (SELECT h.*, CASE WHEN p = pos - 1 AND s.src IS NOT NULL THEN 0 ELSE 1 END AS new FROM held h LEFT JOIN solid s ON h.before = s.src AND h.kmer = s.dst),
runs AS (SELECT *, sum(new) OVER (PARTITION BY pair_id, mate ORDER BY pos) AS run FROM turned),
seeds AS (SELECT pair_id, mate, any_value(seq) AS seq, min(pos) AS first, max(pos) AS last, arg_min(kmer, pos) AS a, arg_max(kmer, pos) AS b FROM runs GROUP BY pair_id, mate, run
    QUALIFY row_number() OVER (PARTITION BY pair_id, mate ORDER BY last - first DESC, first) = 1),
ends AS (SELECT pair_id, mate, 'L' AS side, {_RC.format("substr(seq, 1, first)")} AS pattern, {_RC.format('a')} AS kmer FROM seeds UNION ALL SELECT pair_id, mate, 'R', substr(seq, last + {GRAPH_K + 1}), b FROM seeds),
states AS (SELECT pair_id, mate, side, pattern, kmer, 0 AS g, d, -3 * d AS s, '' AS lo, '' AS hi FROM (SELECT *, unnest(range(0, {_B + 1})) AS d FROM ends WHERE pattern <> '')
    UNION ALL SELECT pair_id, mate, side, pattern, kmer, g, d, s, min(lo), max(hi) FROM (
        SELECT *, max(s) OVER (PARTITION BY pair_id, mate, side, kmer, d) AS top FROM (
            SELECT pair_id, mate, side, pattern, dst AS kmer, g + 1 AS g, d - del + e AS d, s - 3 * e + CASE WHEN del = 1 THEN -3 WHEN substr(pattern, g + 1 + d, 1) = right(dst, 1) THEN 1 ELSE -1 END AS s, lo || right(dst, 1) AS lo, hi || right(dst, 1) AS hi
            FROM states JOIN solid ON kmer = src, (VALUES (0), (1)) x(del), (SELECT CAST(unnest(range(0, {2 * _B + 1})) AS INTEGER) AS e) y
            WHERE g + d < length(pattern) AND d - del >= -{_B} AND d - del + e <= {_B} AND g + 1 + d - del + e BETWEEN 0 AND length(pattern) AND (del = 1 OR g + 1 + d >= 1))
        WHERE 10 * (s + length(pattern) - g - d) >= {_T} * length(pattern))
    WHERE s = top GROUP BY pair_id, mate, side, pattern, kmer, g, d, s),
ended AS (SELECT pair_id, mate, side, max(s) AS score, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, max(s) OVER (PARTITION BY pair_id, mate, side) AS best FROM states WHERE g + d = length(pattern) AND 10 * s >= {_T} * length(pattern)) WHERE s = best GROUP BY pair_id, mate, side),
sides AS (SELECT e.pair_id, e.mate, e.side, coalesce(score, 0) AS score, CASE WHEN pattern = '' THEN 1 WHEN lo IS NULL THEN 4 WHEN lo = hi THEN 1 ELSE 2 END AS rank, CASE WHEN lo = hi THEN lo ELSE pattern END AS letters FROM ends e LEFT JOIN ended USING (pair_id, mate, side))"""


@query(
    f"""WITH RECURSIVE {_ALIGNMENT} SELECT s.pair_id, s.mate, ['OPTIMAL', 'MULTIPLE', 'EXHAUSTED', 'NONE'][greatest(l.rank, r.rank)] AS status, CAST(last - first + {GRAPH_K} + l.score + r.score AS INTEGER) AS score,
    {_RC.format('l.letters')} || substr(seq, first + 1, last - first + {GRAPH_K}) || r.letters AS corrected
    FROM seeds s JOIN sides l ON s.pair_id = l.pair_id AND s.mate = l.mate AND l.side = 'L' JOIN sides r ON s.pair_id = r.pair_id AND s.mate = r.mate AND r.side = 'R'"""
)
def graph_alignment_of_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The low-complexity reads with their ends replaced by the one path of the graph that fits them best."""
    low = _low_reads(spark, sf_dir)
    nodes, arcs = graph_alignment.solid_graph(low, GRAPH_K, 2)
    return graph_alignment.correct(low, nodes, arcs, GRAPH_K, ["pair_id", "mate"]).drop("visits")


# the references of the benchmark, cut into runs that documents hold and runs that they do not

_REF = f"""ref AS (SELECT item_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM benchmark WHERE text IS NOT NULL),
places AS (SELECT item_id, CAST(p AS INTEGER) AS pos, {_canonical(f'substr(seq, CAST(p + 1 AS BIGINT), {GRAPH_K})')} AS kmer FROM (SELECT item_id, seq, unnest(range(0, length(seq) - {GRAPH_K} + 1)) AS p FROM ref)),
held AS (SELECT DISTINCT kmer FROM canon), hit AS (SELECT p.item_id, p.pos, h.kmer IS NOT NULL AS there FROM places p LEFT JOIN held h USING (kmer)),
turn AS (SELECT *, CASE WHEN there IS DISTINCT FROM lag(there) OVER (PARTITION BY item_id ORDER BY pos) THEN 1 ELSE 0 END AS t FROM hit),
runs AS (SELECT *, sum(t) OVER (PARTITION BY item_id ORDER BY pos) AS run FROM turn)"""


@query(f"WITH {SQL}, {_kmers(GRAPH_K)}, {_REF} SELECT item_id, min(pos) AS first, max(pos) AS last, CASE WHEN there THEN 'CONTIG' ELSE 'BREAK' END AS kind FROM runs GROUP BY item_id, run, there")
def ref_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = dna(spark, sf_dir, "benchmark", "item_id").withColumnRenamed("doc_id", "item_id")
    return chains.segments(reference, kmers.count_kmers(reads(spark, sf_dir), GRAPH_K), GRAPH_K, "item_id")


# chains: the suppliers of an order's lines, negative on even lines

_CHAINS = "chains AS (SELECT l_orderkey AS id, list(CAST(CASE WHEN l_linenumber % 2 = 0 THEN -l_suppkey ELSE l_suppkey END AS INTEGER) ORDER BY l_linenumber, l_suppkey) AS chain FROM lineitem GROUP BY l_orderkey)"
_TURN = "list_reverse(list_transform({0}, lambda x: -x))"


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    signed = F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_suppkey")).otherwise(F.col("l_suppkey")).cast("int")
    ordered = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", signed.alias("x")))).alias("c"))
    return ordered.select("id", F.transform("c", lambda x: x["x"]).alias("chain"))


@query(f"WITH {_CHAINS} SELECT array_to_string(least(chain, {_TURN.format('chain')}), ',') AS chain, count(*) AS n FROM chains GROUP BY 1")
def chain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.counted(_chains(spark, sf_dir)).select(F.array_join(F.transform("chain", lambda x: x.cast("string")), ",").alias("chain"), "n")


@query(
    f"""WITH {_CHAINS}, mates AS (SELECT a.chain AS c1, b.chain AS c2, least(a.chain, {_TURN.format('a.chain')}) AS k1, least(b.chain, {_TURN.format('b.chain')}) AS k2 FROM chains a JOIN chains b ON b.id = a.id + 1 WHERE a.id % 2 = 1)
    SELECT array_to_string(k1, ',') AS chain1, c1 <> k1 AS turned1, array_to_string(k2, ',') AS chain2, c2 = k2 AS turned2, count(*) AS n FROM mates GROUP BY k1, c1 <> k1, k2, c2 = k2"""
)
def paired_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of two orders in a row as the chains of two mates."""
    every = _chains(spark, sf_dir)
    second = every.select((F.col("id") - 1).alias("id"), F.col("chain").alias("chain2"))
    found = chains.paired_counts(every.filter("id % 2 = 1").withColumnRenamed("chain", "chain1").join(second, "id"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select(text("chain1"), "turned1", text("chain2"), "turned2", "n")


@query(
    f"""WITH RECURSIVE {_NODES}, {_PLACES}, kept AS (SELECT pair_id, mate, node, CASE WHEN strand = 1 THEN node_pos ELSE length(node) - {GRAPH_K} - node_pos END AS p FROM positions),
    sizes AS (SELECT max(p) - min(p) + {GRAPH_K} AS x FROM kept GROUP BY pair_id, node HAVING count(DISTINCT mate) = 2),
    ranked AS (SELECT x, row_number() OVER (ORDER BY x) AS r, count(*) OVER () AS n FROM sizes), inner_half AS (SELECT x FROM ranked WHERE r > n // 4 AND r <= n - n // 4),
    m AS (SELECT count(*) AS n, round(avg(x)) AS mean FROM inner_half)
    SELECT n, mean, (SELECT round(sqrt(sum((x - mean) * (x - mean)) / max(n))) FROM inner_half, m) AS deviation FROM m"""
)
def insert_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the sizes of the pairs whose mates share a node, without the outer quarters."""
    low = _low_reads(spark, sf_dir)
    positions = graph.read_positions(low, graph.unitigs(low, GRAPH_K), GRAPH_K, "pair_id", "mate")
    return chains.trimmed_moments(chains.insert_sizes(positions, GRAPH_K), "size")


_SUBS = f"""ways AS (SELECT id, chain FROM chains UNION ALL SELECT id, {_TURN.format('chain')} FROM chains),
tips AS (SELECT chain, unnest(range(2, len(chain) + 1)) AS e FROM ways),
sub AS (SELECT chain, e, unnest(range(1, least(e, 16))) AS o FROM tips),
contexts AS (SELECT CAST(o AS INTEGER) AS "order", array_to_string(chain[e - o : e - 1], ',') AS context, chain[e] AS next, count(*) AS freq FROM sub GROUP BY ALL)"""


@query(f"WITH {_CHAINS}, {_SUBS} SELECT * FROM contexts")
def markov_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chains.contexts(_chains(spark, sf_dir))
    return found.select("order", F.array_join(F.transform("context", lambda x: x.cast("string")), ",").alias("context"), "next", "freq")


@query(
    f"""WITH {_CHAINS}, arc AS (SELECT DISTINCT -l_suppkey AS s FROM lineitem WHERE l_linenumber = 2), step AS (SELECT id, unnest(chain) AS x FROM chains)
    SELECT id, bool_and(x > 0 OR x IN (SELECT s FROM arc)) AS valid FROM step GROUP BY id"""
)
def chain_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative nodes are valid if a second line has them."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_linenumber = 2")
    return chains.valid_nodes(_chains(spark, sf_dir), lines.select((-F.col("l_suppkey")).cast("int").alias("node")))


_WANTED = "wanted AS (SELECT DISTINCT chain[1:2] AS sub FROM chains WHERE len(chain) = 2)"


@query(
    f"""WITH {_CHAINS}, {_WANTED}, places AS (SELECT id, chain, unnest(range(1, len(chain))) AS p FROM chains)
    SELECT DISTINCT id, CAST(p - 1 AS INTEGER) AS at, array_to_string(sub, ',') AS sub FROM places JOIN wanted ON chain[p : p + 1] = sub OR chain[p : p + 1] = {_TURN.format('sub')}"""
)
def chain_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the chains of two nodes occur in all chains, on either strand."""
    every = _chains(spark, sf_dir)
    found = chains.occurrences(every, every.filter("size(chain) = 2").select(F.col("chain").alias("sub")).distinct())
    return found.select("id", "at", F.array_join(F.transform("sub", lambda x: x.cast("string")), ",").alias("sub"))


_LENGTHS = """parts AS (SELECT *, string_split(context, ',') AS nodes FROM contexts),
total AS (SELECT "order", context, nodes, next, freq, CAST(31 + list_sum(list_transform(nodes, lambda x: abs(CAST(x AS INTEGER)) % 9 + 1)) + abs(next) % 9 + 1 AS BIGINT) AS length FROM parts),
hoped AS (SELECT *, 30.0 / 100.0 * greatest(100.0 - length + 1, 0.0) * pow(0.99, length) AS expected FROM total),
decided AS (SELECT *, NOT (freq < expected AND expected >= 5 AND ((-1.0) - (freq * ln(nullif(expected, 0)) - expected)) / ln(10.0) > 1) AS accepted FROM hoped)"""


def _text(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts with last, length and expected; a node's length is the remainder of its number by 9, plus 1."""
    lengths = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").cast("int").alias("node")).distinct().withColumn("n", (F.col("node") % 9 + 1).cast("long"))
    found = chains.contexts_by_last(chains.measured(_chains(spark, sf_dir), lengths), k=31)
    return found.withColumn("expected", chains.expected_coverage(30.0, 100.0, "length"))


@query(f'WITH {_CHAINS}, {_SUBS}, {_LENGTHS} SELECT "order", context, next, freq, length, round(expected, 9) AS expected FROM hoped')
def markov_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of contexts and how often each is expected."""
    return _expected(spark, sf_dir).select("order", _text("context").alias("context"), "next", "freq", "length", F.round("expected", 9).alias("expected"))


@query(f'WITH {_CHAINS}, {_SUBS}, {_LENGTHS} SELECT "order", context, next, freq, round(expected, 9) AS expected, accepted FROM decided')
def markov_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which steps are seen too seldom for what their length lets expect."""
    return chains.decided(_expected(spark, sf_dir)).select("order", _text("context").alias("context"), "next", "freq", F.round("expected", 9).alias("expected"), "accepted")


@query(
    f"""WITH {_CHAINS}, {_SUBS}, {_LENGTHS}, single AS (SELECT "order", context FROM decided GROUP BY ALL HAVING count(*) FILTER (accepted) = 1),
    ends AS (SELECT "order", context, nodes, unnest(range(1, "order")) AS n FROM (SELECT DISTINCT "order", context, nodes FROM decided)),
    gone AS (SELECT DISTINCT e."order", e.context FROM ends e JOIN single s ON array_to_string(nodes[e."order" - n + 1 :], ',') = s.context)
    SELECT "order", context, next, freq, accepted FROM decided WHERE ("order", context) NOT IN (SELECT ("order", context) FROM gone)"""
)
def propagated_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions without the contexts that a shorter one with a single accepted step decides already."""
    left = chains.propagated(chains.decided(_expected(spark, sf_dir)))
    return left.select("order", _text("context").alias("context"), "next", "freq", "accepted")


@query(
    f"""WITH {_CHAINS}, {_SUBS}, {_LENGTHS}, ends AS (SELECT id, o, array_to_string(chain[len(chain) - o + 1 :], ',') AS context FROM (SELECT id, chain, unnest(range(1, least(len(chain), 15) + 1)) AS o FROM chains)),
    known AS (SELECT id, o, next FROM ends e JOIN decided d ON e.context = d.context AND accepted QUALIFY o = max(o) OVER (PARTITION BY id))
    SELECT id, string_agg(DISTINCT CAST(next AS VARCHAR), ',' ORDER BY CAST(next AS VARCHAR)) AS next FROM known GROUP BY id"""
)
def allowed_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nodes may follow each chain by the longest context that it ends with."""
    found = chains.allowed_next(_chains(spark, sf_dir), chains.decided(_expected(spark, sf_dir)))
    return found.select("id", F.array_join(F.array_sort(F.transform("next", lambda x: x.cast("string"))), ",").alias("next"))


@query(
    f"""WITH {_CHAINS}, step AS (SELECT id, chain[p] AS src, chain[p + 1] AS dst FROM (SELECT id, chain, unnest(range(1, len(chain))) AS p FROM chains)),
    arc AS (SELECT src, dst FROM (SELECT src, dst FROM step UNION ALL SELECT -dst, -src FROM step) GROUP BY ALL HAVING count(*) > 1)
    SELECT id, coalesce(bool_and(arc.src IS NOT NULL) FILTER (step.src IS NOT NULL), true) AS valid FROM chains LEFT JOIN step USING (id) LEFT JOIN arc ON step.src = arc.src AND step.dst = arc.dst GROUP BY id"""
)
def chain_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each step of a chain is an arc; arcs are the steps seen twice or more, on either strand."""
    every = _chains(spark, sf_dir)
    steps = chains.subchains(every, 2).select("id", "sub").filter("size(sub) = 2")
    arcs = steps.groupBy(F.get("sub", F.lit(0)).alias("src"), F.get("sub", F.lit(1)).alias("dst")).agg(F.count("*").alias("n")).filter("n > 1")
    return graph.chain_valid(every, arcs)


# similarity networks

#: Copies of documents make reads of up to some ten places; the window of this coverage holds k-mers seen 3 to 13 times.
_PLAN = pipeline.Config(pattern=PATTERN, coverage=100.0)
_WINDOW = similarity.first_window(_PLAN.read_length, _PLAN.k, _PLAN.coverage)
_CANDIDATES = f"""n AS (SELECT kmer, count(*) AS cov FROM canon GROUP BY kmer HAVING count(*) > {_WINDOW[0]} AND count(*) < {_WINDOW[2]}),
lowest AS (SELECT pair_id, min(cov) AS cov FROM canon JOIN n USING (kmer) GROUP BY pair_id),
widths AS (SELECT {_WINDOW[1]} + unnest(range(0, {int(_WINDOW[2])})) AS high), enough AS (SELECT high FROM widths WHERE high >= {_WINDOW[2]} OR (SELECT count(*) FROM lowest WHERE cov < high) > 0.98 * (SELECT count(DISTINCT pair_id) FROM lowreads)),
m AS (SELECT DISTINCT pair_id, kmer FROM canon JOIN n USING (kmer) WHERE cov < (SELECT min(high) FROM enough))"""


@query(f"WITH {SQL}, {_LOW}, {_kmers(31, 'lowreads')}, {_CANDIDATES} SELECT DISTINCT x.pair_id AS a, y.pair_id AS b FROM m x JOIN m y ON x.kmer = y.kmer AND x.pair_id < y.pair_id")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.candidates(_low_reads(spark, sf_dir), _PLAN)


@query()
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = _low(spark, sf_dir)
    return similarity.similarities(pipeline.candidates(pipeline.reads_of(low), _PLAN), low, 100)


@query()
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the low-complexity pairs by consensus over clustering runs."""
    low = _low(spark, sf_dir)
    edges = similarity.similarities(pipeline.candidates(pipeline.reads_of(low), _PLAN), low, 100)
    return pipeline.clusters(low, edges, _PLAN)


@query()
def corrected_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline end to end: every read once, corrected where its cluster allows it."""
    return pipeline.run(pairs(spark, sf_dir), _PLAN)


# weighted graphs

_EDGES = "edges AS (SELECT CAST(l_suppkey AS BIGINT) AS src, CAST(l_partkey + 10000000 AS BIGINT) AS dst, CAST(sum(l_quantity) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2)"
_BOTH = "directed AS (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges), part AS (SELECT DISTINCT src AS node, src % 7 AS community FROM directed)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return community.merge_edges(lines.select(F.col("l_suppkey").cast("long").alias("src"), (F.col("l_partkey") + 10_000_000).cast("long").alias("dst"), F.col("l_quantity").cast("double").alias("w")))


def _partition(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("community", F.col("node") % 7)


@query(f"WITH {_EDGES} SELECT * FROM edges")
def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(f"WITH {_EDGES}, {_BOTH} SELECT src AS node, sum(w) AS degree, 0.0::DOUBLE AS loop, count(*) AS n_neighbours FROM directed GROUP BY src")
def weighted_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.degrees(_edges(spark, sf_dir))


@query(f"WITH {_EDGES}, {_BOTH} SELECT src AS node, community, sum(w) AS w FROM directed JOIN part ON dst = node GROUP BY src, community")
def neighbour_comm_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return community.neighbour_weights(edges, _partition(edges))


@query(f"WITH {_EDGES} SELECT least(src % 7, dst % 7) AS src, greatest(src % 7, dst % 7) AS dst, sum(CASE WHEN src % 7 = dst % 7 THEN 2 * w ELSE w END) AS w FROM edges GROUP BY 1, 2")
def coarsen_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return community.coarsen(edges, _partition(edges))


_SUMS = """s AS (SELECT a.community, sum(CASE WHEN a.community = b.community THEN w ELSE 0 END) AS i, sum(w) AS t FROM {0} JOIN part a ON src = a.node JOIN part b ON dst = b.node GROUP BY 1),
z AS (SELECT community, count(*)::DOUBLE AS s FROM part GROUP BY 1), g AS (SELECT sum(w) AS m2, max(w) AS top FROM {0}), h AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT community)::DOUBLE AS kappa FROM part)"""
_FORMS = {
    "modularity": "sum(i - t * t / m2) / m2",
    "zahn": "(sum(2 * i - top * s * s) + n * n * top - m2) / (n * n * top)",
    "owzad": "(sum(i - 0.5 * s * s * top) + 0.5 * (n * n * top - m2)) / (n * n * top)",
    "goldberg": "sum(i / (2 * s)) / (n * top)",
    "devind": "(sum(i - 2 * t * s / n) + sum(s * s) * m2 / (n * n)) / m2",
    "devuni": "(sum(i) - sum(s * s) * m2 / (n * n)) / m2",
    "shimalik": "(sum(CASE WHEN t > 0 THEN i / t ELSE 0 END) - kappa) / n",
    "balmod": "sum(2 * i - t * t / m2 - s * s * top + (n * s * top - t) * (n * s * top - t) / (n * n * top - m2)) / (n * n * top)",
}
_HEAVY = """d AS (SELECT src AS node, count(*) AS d FROM directed GROUP BY 1),
heavy AS (SELECT src, dst, {0} AS w, {1} AS part FROM (SELECT src, dst, 2.0 * w / (x.d + y.d) AS e FROM directed JOIN d x ON src = x.node JOIN d y ON dst = y.node))"""


def _quality(name: str) -> None:
    @query()
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges = _edges(spark, sf_dir)
        return community.quality(edges, _partition(edges), name).select(F.round("quality", 9).alias("quality"))

    del _queries["f"]
    _queries[f"quality_{name}"] = f
    if name in _FORMS:
        sums, form = _SUMS.format("directed"), _FORMS[name]
    elif name == "condorcet":
        sums, form = f"{_HEAVY.format('2.0 * e', '-e')}, q AS (SELECT sum(part) AS p FROM heavy), {_SUMS.format('heavy')}", "(sum(i) + (SELECT p FROM q)) / (n * n)"
    else:
        sums, form = f"{_HEAVY.format('e', 'e * e')}, q AS (SELECT sum(part) AS p FROM heavy), {_SUMS.format('heavy')}", "(sum(2 * i / s) - (SELECT p FROM q) - kappa) / (n * n * top)"
    _sql[f"quality_{name}"] = f"WITH {_EDGES}, {_BOTH}, {sums} SELECT round({form}, 9) AS quality FROM z JOIN s USING (community), g, h GROUP BY m2, top, n, kappa"


for _name in community.QUALITIES:
    _quality(_name)


@query()
def louvain_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.louvain(_edges(spark, sf_dir))


@query(f"WITH {_EDGES}, n AS (SELECT count(*) AS n FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) SELECT n AS n_nodes, n AS n_placed, CAST(0 AS BIGINT) AS n_wrong_names, true AS rising, true AS better_than_alone FROM n")
def louvain_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every level: all nodes once, communities named by their smallest node, no level worse than the last."""
    edges = cut(_edges(spark, sf_dir))
    levels = community.louvain(edges)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    per_level = levels.groupBy("level").agg(F.count("*").alias("rows"), F.count_distinct("node").alias("nodes"))
    named = levels.groupBy("level", "community").agg(F.min("node").alias("low")).agg(F.count_if(F.col("low") != F.col("community")).alias("n_wrong_names"))
    depth = levels.agg(F.max("level")).first()[0] or 0
    values = [community.quality(edges, levels.filter(F.col("level") == k).select("node", "community"), "modularity") for k in range(1, depth + 1)]
    values = [community.quality(edges, nodes.select("node", F.col("node").alias("community")), "modularity"), *values]
    ranked = values[0].withColumn("k", F.lit(0))
    for k, one in enumerate(values[1:], 1):
        ranked = ranked.unionByName(one.withColumn("k", F.lit(k)))  # a row a level
    ends = ranked.agg(F.array_sort(F.collect_list(F.struct("k", "quality"))).alias("q"))
    steps = F.transform(F.sequence(F.lit(1), F.size("q") - 1), lambda k: F.get("q", k)["quality"] >= F.get("q", k - 1)["quality"] - 1e-9)
    checks = ends.select(F.forall(steps, lambda x: x).alias("rising"), (F.element_at("q", -1)["quality"] > F.get("q", F.lit(0))["quality"]).alias("better_than_alone"))
    # one row each
    placed = per_level.agg(F.when(F.max("rows") == F.max("nodes"), F.min("nodes")).otherwise(-1).alias("n_placed"))
    return nodes.agg(F.count("*").alias("n_nodes")).join(F.broadcast(placed)).join(F.broadcast(named)).join(F.broadcast(checks))


@query()
def hierarchy_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.renumbered(community.flatten(community.louvain(_edges(spark, sf_dir))))


@query(
    f"""WITH RECURSIVE {_EDGES}, heavy AS (SELECT src, dst FROM edges WHERE w >= 95), b AS (SELECT src, dst FROM heavy UNION SELECT dst, src FROM heavy),
    reach AS (SELECT src AS node, src AS other FROM b UNION SELECT r.node, b.dst FROM reach r JOIN b ON r.other = b.src)
    SELECT node, min(other) AS component FROM reach GROUP BY node"""
)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.iterate import connected_components as components

    heavy = _edges(spark, sf_dir).filter("w >= 95")
    return components(heavy.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), heavy)


@query(f"WITH {_EDGES} SELECT CAST(r AS INTEGER) AS run, src, dst, round(w, 2) AS sim FROM edges, range(0, 20) t(r) WHERE w > 10 + r * 0.5")
def similarity_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.ladder(_edges(spark, sf_dir).withColumnRenamed("w", "sim"))


# labels: customers by nation and segment

_LABELS = "labels AS (SELECT CAST(c_custkey AS BIGINT) AS pair_id, CAST(1 + c_nationkey * 40 + c_custkey % 40 AS BIGINT) AS cluster_id FROM customer), sizes AS (SELECT cluster_id, count(*) AS n FROM labels GROUP BY 1), accepted AS (SELECT pair_id, CASE WHEN n BETWEEN 10 AND 299 THEN cluster_id ELSE 0 END AS cluster_id FROM labels JOIN sizes USING (cluster_id))"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return consensus.accepted_clusters(customer.select(F.col("c_custkey").cast("long").alias("pair_id"), (1 + F.col("c_nationkey") * 40 + F.col("c_custkey") % 40).cast("long").alias("cluster_id")))


@query(f"WITH {_LABELS} SELECT * FROM accepted")
def cluster_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)


@query(f"WITH {_LABELS}, k AS (SELECT cluster_id, count(*) AS n FROM accepted WHERE cluster_id > 0 GROUP BY 1) SELECT count(*) AS n_clusters, CAST(sum(n * n) AS DOUBLE) / sum(n) AS mean_size, (SELECT median(n) FROM accepted JOIN k USING (cluster_id)) AS median_size FROM k")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.cluster_statistics(_labels(spark, sf_dir))


@query(f"WITH {_LABELS}, o AS (SELECT CAST(o_custkey AS BIGINT) AS src, CAST(o_custkey + 1000 AS BIGINT) AS dst, CAST(o_totalprice AS DOUBLE) AS sim FROM orders) SELECT a.cluster_id, src, dst, sim FROM o JOIN accepted a ON src = a.pair_id JOIN accepted b ON dst = b.pair_id AND a.cluster_id = b.cluster_id WHERE a.cluster_id > 0")
def intra_cluster_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("long").alias("src"), (F.col("o_custkey") + 1000).cast("long").alias("dst"), F.col("o_totalprice").cast("double").alias("sim"))
    return consensus.intra_cluster(edges, _labels(spark, sf_dir))


@query(
    """WITH runs AS (SELECT l_linenumber AS run, CAST(l_suppkey AS BIGINT) AS node, min(l_orderkey) AS community FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), p AS (SELECT run, node, community % 11 AS community FROM runs)
    SELECT a.node AS i, b.node AS j, count(*) AS weight FROM p a JOIN p b ON a.run = b.run AND a.community = b.community AND a.node < b.node GROUP BY 1, 2"""
)
def coclustering_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over the suppliers: the remainder of the first order on whose n-th line they are."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_linenumber <= 3")
    runs = lines.groupBy(F.col("l_linenumber").alias("run"), F.col("l_suppkey").cast("long").alias("node")).agg((F.min("l_orderkey") % 11).alias("community"))
    return consensus.coclustering(runs)
