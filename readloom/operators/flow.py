"""Arcs that the coverage of their nodes speaks against: by likelihood under a fitted spectrum, and by multiplicities that
agree without them.

Every pass judges all nodes, on both strands, on the graph as it was before the pass; what is found goes on both strands.
Nothing but joins and sums over arcs: a node has at most four ways out, so no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spectrum
from .graph import average_coverage, expected_multiplicity
from .iterate import cut

#: By how much the natural logarithm of the likelihood must rise for arcs to go.
LEAST_GAIN = 5.0


def _part(x: Column, j: int) -> Column:
    return F.ln(F.get("mass", F.lit(j))) + spectrum.log_negative_binomial(x, F.get("mean", F.lit(j)), F.get("variance", F.lit(j)))


def log_observed(cov: Column, multiplicity: Column) -> Column:
    """How likely a coverage, cut to an integer, is for something that occurs so often in the genome, under the columns
    mean, variance and mass of a fit; an error (0) answers for all components of errors, and beyond the fitted
    components the first true one is stretched."""
    x = F.floor(cov).cast("double")
    errors = _part(x, 0)
    for j in range(1, spectrum.ERRORS):
        errors = errors + _part(x, j)
    known = F.when(multiplicity == 0, errors)
    for m in range(1, spectrum.TRUE + 1):
        known = known.when(multiplicity == m, _part(x, spectrum.ERRORS + m - 1))
    first = F.lit(spectrum.ERRORS)
    stretched = F.ln(F.get("mass", first)) + spectrum.log_negative_binomial(x, multiplicity * F.get("mean", first), multiplicity * F.get("variance", first))
    return known.otherwise(stretched)


def _oriented(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode(F.array(F.col("id"), -F.col("id"))).alias("src"), *[c for c in nodes.columns if c != "id"])


def _both_strands(found: DataFrame) -> DataFrame:
    turned = F.array(F.struct("src", "dst"), F.struct((-F.col("dst")).alias("src"), (-F.col("src")).alias("dst")))
    return found.select(F.explode(turned).alias("a")).select("a.src", "a.dst").distinct()


def unlikely_arcs(nodes: DataFrame, arc: DataFrame, fit: DataFrame) -> DataFrame:
    """src, dst, gain: the arcs that fall below the cutoff at nodes which are likelier without them.

    A node and its two ways or more out have multiplicities by coverage (0 below the cutoff). Where these do not add up,
    or one is 0, the node is judged as it stands (arcs of 0 counting as 1, the node as their sum) and by its own
    multiplicity without the arcs of 0; gain is the difference of the log-likelihoods, and at ``LEAST_GAIN`` the arcs go.
    ``fit`` is one row: mean, variance, mass, cutoff and avg_cov. A fit without components, or nulls in it, takes nothing.
    """
    model = F.broadcast(fit.select("mean", "variance", "mass", F.col("cutoff").cast("double").alias("cutoff"), "avg_cov"))  # one row
    sized = _oriented(nodes.select("id", average_coverage().alias("node_cov")))
    m = lambda c: expected_multiplicity(F.col("avg_cov"), F.col(c), F.col("cutoff"))
    judged = arc.select("src", "dst", "cov").join(model).withColumns({"arc_m": m("cov")})
    # what an arc of 0 adds if it is wrong and not once there
    gain = F.when(F.col("arc_m") == 0, log_observed(F.col("cov"), F.lit(0)) - log_observed(F.col("cov"), F.lit(1))).otherwise(0.0)
    out = judged.withColumn("gain", gain).groupBy("src").agg(F.count("*").alias("ways"), F.sum(F.greatest("arc_m", F.lit(1))).alias("sum_m"), F.count_if(F.col("arc_m") == 0).alias("weak"), F.sum("gain").alias("arcs_gain"))
    open_ = out.filter("ways > 1 and weak > 0").join(sized, "src").join(model).withColumn("node_m", m("node_cov")).filter("node_m > 0")
    whole = F.col("arcs_gain") + log_observed(F.col("node_cov"), F.col("node_m")) - log_observed(F.col("node_cov"), F.col("sum_m"))
    gone = open_.select("src", whole.alias("gain")).filter(F.col("gain") >= LEAST_GAIN)
    return judged.filter("arc_m = 0").select("src", "dst").join(gone, "src").select("src", "dst", "gain")


def without_arcs(nodes: DataFrame, arc: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the arcs ``gone`` (src, dst), on either strand, and without the nodes that these led to, if
    nothing leads there any more."""
    left = cut(arc.join(_both_strands(gone), ["src", "dst"], "left_anti").select("src", "dst", "cov"))
    lost = gone.select(F.abs("dst").alias("id")).distinct().join(left.select(F.abs("src").alias("id")).distinct(), "id", "left_anti")
    return nodes.join(lost, "id", "left_anti").select(*nodes.columns), left


def correct_by_likelihood(nodes: DataFrame, arc: DataFrame, fit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passes of ``unlikely_arcs`` until none is found."""
    while (gone := cut(unlikely_arcs(nodes, arc, fit).select("src", "dst"))).limit(1).count():
        nodes, arc = without_arcs(nodes, arc, gone)
        nodes = cut(nodes)
    return nodes, arc


def reliable(cutoff: float, longest: int, most: int = 4) -> Column:
    """Whether a node (n, kmer_cov, multiplicity) is covered and long enough to be believed, and occurs 1 to ``most`` times."""
    return (average_coverage() >= cutoff) & (F.col("n") >= longest) & F.col("multiplicity").between(1, most)


def chimeric_links(nodes: DataFrame, arc: DataFrame, cutoff: float, longest: int, k: int) -> DataFrame:
    """src, dst, trusted: one weak arc a node, where another one leads on to a node that occurs as often.

    Of a reliable node with two ways out or more, and as many as its multiplicity, the first (by the letter that an arc
    adds) to a reliable node of the same multiplicity is trusted; the first other one covered below the cutoff is the
    chimera. ``nodes`` has id, seq, n, kmer_cov and multiplicity; one whose multiplicity is null is not reliable.
    """
    letter = F.when(F.col("src") > 0, F.substring("seq", k, 1)).otherwise(F.translate(F.substring(F.col("seq"), F.length("seq") - k + 1, F.lit(1)), "ACGT", "TGCA"))
    ends = _oriented(nodes.select("id", "seq", "multiplicity", F.coalesce(reliable(cutoff, longest), F.lit(False)).alias("sure")))
    targets = ends.select(F.col("src").alias("dst"), letter.alias("letter"), F.col("multiplicity").alias("dst_m"), F.col("sure").alias("dst_sure"))
    ways = arc.join(ends.filter("sure").select("src", "multiplicity"), "src").join(targets, "dst")
    same = F.col("dst_sure") & (F.col("dst_m") == F.col("multiplicity"))
    sides = ways.groupBy("src", "multiplicity").agg(F.count("*").alias("ways"), F.min_by("dst", F.when(same, F.col("letter"))).alias("trusted"))
    kept = sides.filter("ways > 1 and ways >= multiplicity and trusted is not null").select("src", "trusted")
    weak = ways.join(kept, "src").filter((F.col("dst") != F.col("trusted")) & (F.col("cov") < cutoff))
    return weak.groupBy("src", "trusted").agg(F.min_by("dst", "letter").alias("dst")).select("src", "dst", "trusted")


def remove_chimeras(nodes: DataFrame, arc: DataFrame, cutoff: float, longest: int, k: int) -> DataFrame:
    """The arcs that are left after passes of ``chimeric_links`` until none is found."""
    while (gone := cut(chimeric_links(nodes, arc, cutoff, longest, k).select("src", "dst"))).limit(1).count():
        arc = cut(arc.join(_both_strands(gone), ["src", "dst"], "left_anti").select("src", "dst", "cov"))
    return arc
