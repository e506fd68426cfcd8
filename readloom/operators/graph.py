"""De Bruijn graphs as tables: oriented arcs, unitigs by pointer doubling, coverage, and the predicates of cleaning.

Nodes have 64-bit ids, signed by strand, so no sequence is ever a key: k-mers by their letters in base 4, unitigs by a hash
of their sequence. Joining along unique links is the same operation for k-mers and for nodes after a cleaning pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignment import banded_scores
from ..functions.sequence import canonical, explode_kmers, reverse_complement
from .iterate import cut
from .stretches import placed_codes, stretches, ways, with_members

#: Gaps allowed between a tip and what is beside it.
TIP_BAND = 2


def arcs(reads: DataFrame, k: int) -> DataFrame:
    """src, dst, cov: k-mers that follow each other in a read, on both strands."""
    edge = explode_kmers(reads.select("seq"), k + 1).select(F.explode(F.array(F.col("kmer"), reverse_complement(F.col("kmer")))).alias("e"))
    return edge.groupBy("e").agg(F.count("*").alias("cov")).select(F.expr(f"left(e, {k})").alias("src"), F.expr(f"right(e, {k})").alias("dst"), "cov")


def unique_links(arc: DataFrame, other: Callable[[Column], Column] = reverse_complement) -> DataFrame:
    """src, dst of arcs that are the only way out of src and the only way into dst, without loops and hairpins; ``other``
    gives a node's name on the other strand."""
    out = arc.groupBy("src").agg(F.count("*").alias("n_out"), F.min("dst").alias("dst")).filter("n_out = 1")
    into = arc.groupBy("dst").agg(F.count("*").alias("n_in")).filter("n_in = 1")
    return out.join(into, "dst").filter((F.col("src") != F.col("dst")) & (F.col("dst") != other(F.col("src")))).select("src", "dst")


def kmer_code(kmer: Column, k: int) -> Column:
    """A signed 64-bit name of a k-mer: positive for the smaller of both strands, its negative for the other.

    Up to 31 letters it is the k-mer itself in base 4 (plus one), beyond that a hash of 63 bits.
    """
    own = canonical(kmer)
    code = F.conv(F.translate(own, "ACGT", "0123"), 4, 10).cast("long") + 1 if k <= 31 else node_id(own)
    return F.when(kmer == own, code).otherwise(-code)


def node_id(seq: Column) -> Column:
    """A positive 63-bit name of a node, from its sequence on the strand that is kept."""
    return F.shiftrightunsigned(F.xxhash64(seq), 1) + 1


def _doubled(at: DataFrame) -> DataFrame:
    up = at.select(F.col("node").alias("top"), F.col("top").alias("top2"), F.col("steps").alias("more"), F.col("low").alias("low2"), F.col("open").alias("open2"))
    return at.join(up, "top").select("node", F.col("top2").alias("top"), (F.col("steps") + F.col("more")).alias("steps"), F.greatest("low", "low2").alias("low"), (F.col("open") & F.col("open2")).alias("open"))


def _walk(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the nodes on paths node, top and steps, by pointer doubling: the first node of the path and how far it is. Of the
    nodes on cycles node and low, the cycle's largest node.

    Every doubling reaches the top from more nodes of a path, so when no more do, the rest lies on cycles, and only that
    part goes on, until its largest nodes have gone round.
    """
    at = nodes.join(links.select(F.col("dst").alias("node"), F.col("src").alias("before")), "node", "left")
    at = cut(at.select("node", F.coalesce("before", "node").alias("top"), F.col("before").isNotNull().cast("long").alias("steps"), F.greatest("node", F.coalesce("before", "node")).alias("low"), F.col("before").isNotNull().alias("open")))
    before, left = -1, at.filter("open").count()
    while left and left != before:
        at = cut(_doubled(_doubled(at)))  # two doublings between cuts
        before, left = left, at.filter("open").count()
    paths, rings = at.filter("not open").select("node", "top", "steps"), at.filter("open")
    if left:
        known = -1
        while (sums := rings.agg(F.sum(F.col("low").cast("decimal(38,0)"))).first()[0]) != known:
            known, rings = sums, cut(_doubled(_doubled(rings)))
    return paths, rings.select("node", "low")


def _opened(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, top and steps of all nodes, and the first nodes (dst) of cycles, each opened before its largest node."""
    walked, cycles = _walk(nodes, links)
    rings = cut(cycles.select(F.col("low").alias("dst")).distinct())
    if rings.limit(1).count():
        inside = cycles.select("node")
        opened, _ = _walk(inside, links.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(rings, "dst", "left_anti").select("src", "dst"))
        walked = walked.unionByName(opened)
    return walked, rings


def concatenate(nodes: DataFrame, arc: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, seq, n, kmer_cov) joined along their unique links, and the arcs (src, dst, cov) between what comes out.

    Ids are signed, the negative one being the other strand; ``arc`` has both strands. A path is kept once, on the strand
    whose sequence is smaller; a cycle is opened before its largest id and kept on the strand that has the larger one.
    Coverages and lengths add up. ``members`` of the new nodes are the old ids in order.
    """
    links = cut(unique_links(arc, lambda x: -x))
    both = nodes.select(F.explode(F.array(F.col("id"), -F.col("id"))).alias("node"))
    walked, rings = _opened(both, links)
    own = nodes.select("id", "seq", "n", "kmer_cov")
    placed = walked.select("node", "top", "steps", F.abs("node").alias("id")).join(own, "id")
    oriented = F.when(F.col("node") > 0, F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    path = placed.select("top", F.struct("steps", "node", oriented.alias("seq"), "n", "kmer_cov").alias("x")).groupBy("top").agg(F.array_sort(F.collect_list("x")).alias("p"))
    seq = _spelled(k)
    out = path.select("top", seq.alias("seq"), F.transform("p", lambda x: x["node"]).alias("members"), _total("n").alias("n"), _total("kmer_cov").alias("kmer_cov"))
    ring = out.join(rings.select(F.col("dst").alias("top"), F.lit(True).alias("ring")), "top", "left")
    kept = F.when(F.col("ring"), F.array_max("members") + F.array_min("members") >= 0).otherwise(F.col("seq") <= reverse_complement(F.col("seq")))
    found = cut(ring.filter(kept).select(node_id(F.col("seq")).alias("id"), "seq", "n", "kmer_cov", "members"))
    return found, cut(_between(found, arc))


def _between(found: DataFrame, arc: DataFrame) -> DataFrame:
    """The arcs (src, dst, cov) that lead from a last to a first member of ``found``, with the names of ``found``."""
    first, last = F.element_at("members", 1), F.element_at("members", -1)
    named = found.select(F.explode(F.array(F.struct(last.alias("end"), F.col("id").alias("name")), F.struct((-first).alias("end"), (-F.col("id")).alias("name")))).alias("t")).select("t.end", "t.name")
    # what an arc leads to ends, on the other strand, where it begins: one shuffled table serves both joins
    tail, head = named.select(F.col("end").alias("src"), F.col("name").alias("a")), named.select(F.col("end").alias("back"), F.col("name").alias("b"))
    return arc.join(tail, "src").withColumn("back", -F.col("dst")).join(head, "back").select(F.col("a").alias("src"), (-F.col("b")).alias("dst"), "cov")


def _spelled(k: int) -> Column:
    """The letters of a path ``p`` of nodes, which share k - 1 letters with the next."""
    return F.concat(F.col("p")[0]["seq"], F.array_join(F.transform("p", lambda x: F.when(x["steps"] > 0, F.substring(x["seq"], F.lit(k), F.length(x["seq"]))).otherwise("")), ""))


def _total(name: str) -> Column:
    return F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x[name])


def build(reads: DataFrame, k: int, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """The graph of ``reads``: nodes (id, seq, n, kmer_cov, members) and arcs (src, dst, cov) of both strands, both cut. K-mers
    and arcs have to occur ``least`` times.

    For odd k up to 31 k-mers are joined to stretches inside reads first, and only stretches are walked over the graph.
    """
    if k % 2 and k <= 31:
        return _from_stretches(cut(stretches(reads, k, least)), k)
    counts = explode_kmers(reads.select("seq"), k).groupBy(canonical(F.col("kmer")).alias("seq")).agg(F.count("*").alias("kmer_cov")).filter(F.col("kmer_cov") >= least)
    kmers = cut(counts.select(kmer_code(F.col("seq"), k).alias("id"), "seq", F.lit(1).cast("long").alias("n"), "kmer_cov"))
    coded = arcs(reads, k).filter(F.col("cov") >= least).select(kmer_code(F.col("src"), k).alias("src"), kmer_code(F.col("dst"), k).alias("dst"), "cov")
    return concatenate(kmers, cut(coded), k)


def _from_stretches(parts: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """What ``concatenate`` makes of the k-mers, from their ``stretches``."""
    parts = parts.withColumn("id", F.abs("first"))
    n_ways = lambda counts: F.size(F.filter(counts, lambda c: c > 0))
    ends = F.array(F.struct(F.col("first").alias("dst"), F.col("id").alias("b"), n_ways("before").alias("n_in")), F.struct((-F.col("last")).alias("dst"), (-F.col("id")).alias("b"), n_ways("after").alias("n_in")))
    into = parts.select(F.explode(ends).alias("e")).select("e.*").filter("n_in = 1").select("dst", "b")
    single = (n_ways("before") == 1) | (n_ways("after") == 1)
    out = ways(parts.filter(single), k).filter("only and abs(src) <> abs(dst)").select("a", "dst")
    links = cut(out.join(into, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    walked, rings = _opened(links.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), links)
    on_path = cut(walked.groupBy(F.abs("node").alias("id")).agg(F.collect_list(F.struct("node", "top", "steps")).alias("at")))  # both strands, two at most
    # stretches without a single way at either end lie alone and are not joined
    known = parts.filter(single).join(on_path, "id", "left")
    turned = F.col("node") < 0
    oriented = F.when(turned, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    left, right = F.when(turned, F.reverse("after")).otherwise(F.col("before")), F.when(turned, F.reverse("before")).otherwise(F.col("after"))
    # of what a ring holds the largest k-mer, where it will be opened, decides
    largest = F.struct(F.abs("top_code").alias("size"), "top_cov").alias("largest")
    placed = known.filter("at is not null").withColumnRenamed("top", "top_code").select("*", F.explode("at").alias("x")).select("seq", "n", "kmer_cov", "top_code", "top_cov", "before", "after", "x.*")
    path = placed.select("top", F.struct("steps", oriented.alias("seq"), "n", "kmer_cov", largest, left.alias("before"), right.alias("after")).alias("x")).groupBy("top").agg(F.array_sort(F.collect_list("x")).alias("p"))
    spelled = path.select("top", _spelled(k).alias("seq"), _total("n").alias("n"), _total("kmer_cov").alias("kmer_cov"), F.array_max(F.transform("p", lambda x: x["largest"]))["top_cov"].alias("top_cov"), F.element_at("p", 1)["before"].alias("before"), F.element_at("p", -1)["after"].alias("after"))
    fields = ["seq", "n", "kmer_cov", "top_cov", "before", "after", "ring"]
    ringed = spelled.join(rings.select(F.col("dst").alias("top"), F.lit(True).alias("r")), "top", "left").withColumn("ring", F.coalesce("r", F.lit(False))).select(*fields)
    other = reverse_complement(F.col("seq"))
    back = F.col("seq") > other
    apart = parts.filter(~single).select("seq", "n", "kmer_cov", "before", "after").unionByName(known.filter("at is null").select("seq", "n", "kmer_cov", "before", "after"))
    alone = apart.select(F.least("seq", other).alias("seq"), "n", "kmer_cov", F.lit(None).cast("long").alias("top_cov"), F.when(back, F.reverse("after")).otherwise(F.col("before")).alias("before"), F.when(back, F.reverse("before")).otherwise(F.col("after")).alias("after"), F.lit(False).alias("ring"))
    whole = with_members(ringed.filter(F.col("ring") | (F.col("seq") <= other)).unionByName(alone), k)
    kept = whole.filter(~F.col("ring") | (F.array_max("members") + F.array_min("members") >= 0))
    found = cut(kept.select(node_id(F.col("seq")).alias("id"), "seq", "n", "kmer_cov", "members", F.when(F.col("ring"), F.col("top_cov")).alias("closing"), "before", "after", "ring"))
    first, last = F.element_at("members", 1), F.element_at("members", -1)
    # what leaves a node is known by its name already; a ring is closed by one arc
    closed = found.filter("closing is not null").select(F.explode(F.array(F.struct(F.col("id").alias("a"), last.alias("src"), first.alias("dst"), F.col("closing").alias("cov")), F.struct((-F.col("id")).alias("a"), (-first).alias("src"), (-last).alias("dst"), F.col("closing").alias("cov")))).alias("c")).select("c.*")
    way = ways(found.filter("closing is null"), k).select("a", "src", "dst", "cov").unionByName(closed)
    # an arc and its other strand lie between the same nodes, so one of them is enough to join and to write
    head = found.select(F.explode(F.array(F.struct(first.alias("dst"), F.col("id").alias("b")), F.struct((-last).alias("dst"), (-F.col("id")).alias("b")))).alias("t")).select("t.dst", "t.b")
    half = cut(way.filter("src <= -dst").select("a", "dst", "cov").join(head, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "cov"))
    strands = F.when(F.col("src") == -F.col("dst"), F.array(F.struct("src", "dst"))).otherwise(F.array(F.struct("src", "dst"), F.struct((-F.col("dst")).alias("src"), (-F.col("src")).alias("dst"))))
    return found.select("id", "seq", "n", "kmer_cov", "members"), half.select(F.explode(strands).alias("s"), "cov").select("s.src", "s.dst", "cov")


def unitigs(reads: DataFrame, k: int) -> DataFrame:
    """id, seq, n, kmer_cov, members (codes of its k-mers, in order) of each maximal unique path, once for both strands."""
    return build(reads, k)[0]


def kmer_index(nodes: DataFrame) -> DataFrame:
    """code (of a k-mer on the node's strand), node, node_pos, from the ``members`` of ``build``. The other strand's code is
    the negative one, its node the negative one, its place counted from the other end."""
    return nodes.select(F.col("id").alias("node"), "n", F.posexplode("members").alias("node_pos", "code"))


def read_positions(reads: DataFrame, nodes: DataFrame, k: int, *keys: str) -> DataFrame:
    """keys, pos, node (signed), node_pos, node_n: where each k-mer of each read lies, on the read's strand."""
    placed = placed_codes(reads, k, *keys) if k <= 31 else explode_kmers(reads.select(*keys, "seq"), k).select(*keys, "pos", kmer_code(F.col("kmer"), k).alias("code"))
    index = kmer_index(nodes).select(F.abs("code").alias("key"), F.signum("code").cast("int").alias("sign"), "node", "node_pos", F.col("n").alias("node_n"))
    same = F.signum("code").cast("int") == F.col("sign")
    found = placed.withColumn("key", F.abs("code")).join(index, "key")
    return found.select(*keys, "pos", F.when(same, F.col("node")).otherwise(-F.col("node")).alias("node"), F.when(same, F.col("node_pos")).otherwise(F.col("node_n") - 1 - F.col("node_pos")).cast("int").alias("node_pos"), "node_n")


def coverage(positions: DataFrame) -> DataFrame:
    """node, kmer_cov, read_start_cov, both strands together."""
    return positions.groupBy(F.abs("node").alias("node")).agg(F.count("*").alias("kmer_cov"), F.count_if(F.col("pos") == 0).alias("read_start_cov"))


def started(reads: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, kmer_cov, read_start_cov, as ``coverage`` gives them for the positions of the reads that ``nodes`` are made of:
    their k-mers are counted in the nodes already, so only the first k-mers of reads are looked up."""
    first = reads.select("seq").filter(F.length("seq") >= k).groupBy(F.left("seq", F.lit(k)).alias("seq")).agg(F.count("*").alias("times"))
    starts = read_positions(first, nodes.select("id", "n", "members"), k, "times").groupBy(F.abs("node").alias("id")).agg(F.sum("times").alias("read_start_cov"))
    return nodes.select("id", "kmer_cov").join(starts, "id", "left").fillna(0, ["read_start_cov"]).withColumnRenamed("id", "node")


def average_coverage() -> Column:
    return F.col("kmer_cov") / F.col("n")


def node_average(nodes: DataFrame, least: float = 2.0, longest: int = 31) -> DataFrame:
    """avg_cov over nodes covered more than ``least`` and of ``longest`` letters or more: all their k-mers over all their
    lengths."""
    good = nodes.filter((average_coverage() > least) & (F.length("seq") + 1 > longest))
    return good.agg((F.sum("kmer_cov") / F.sum("n")).alias("avg_cov"))


def poisson_pdf(k: Column, mean: float) -> Column:
    """exp(k ln mean - mean - ln k!), the factorial summed as logarithms."""
    log_factorial = F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double")))
    return F.exp(k * F.ln(F.lit(float(mean))) - mean - log_factorial)


def initial_cutoff(mean: float = 2.0, p: float = 0.01) -> int:
    """First count from the mean on that a Poisson of that mean gives less than p."""
    import math

    c = math.ceil(mean)
    while c < 10 * mean and math.exp(c * math.log(mean) - mean - math.lgamma(c + 1)) >= p:
        c += 1
    return c


def initial_coverage(nodes: DataFrame, mean: float = 2.0, p: float = 0.01) -> DataFrame:
    """estimate: k-mers over lengths of the nodes at or above the cutoff; twice the mean if there are none."""
    good = nodes.filter(average_coverage() >= initial_cutoff(mean, p))
    return good.agg(F.coalesce(F.sum("kmer_cov") / F.sum("n"), F.lit(2 * mean)).alias("estimate"))


def expected_multiplicity(avg: Column, cov: Column, cutoff: Column) -> Column:
    return F.when(cov < cutoff, F.lit(0)).otherwise(F.greatest(F.lit(1), F.round(cov / avg))).cast("int")


def sides(nodes: DataFrame, arc: DataFrame) -> DataFrame:
    """``nodes`` with n_right and n_left, the arcs that leave a node on its own and on the other strand."""
    d = arc.groupBy(F.abs("src").alias("id")).agg(F.count_if(F.col("src") > 0).alias("n_right"), F.count_if(F.col("src") < 0).alias("n_left"))
    return nodes.join(d, "id", "left").fillna(0, ["n_right", "n_left"])


def self_loops(sided: DataFrame, arc: DataFrame) -> DataFrame:
    """Nodes with one way in and one out, which is an arc to themselves."""
    loops = arc.filter("src = dst").select(F.abs("src").alias("id")).distinct()
    return sided.filter("n_right = 1 and n_left = 1").join(loops, "id", "left_semi")


def dead_ends(sided: DataFrame) -> DataFrame:
    return sided.filter("n_right = 0 or n_left = 0")


def two_cycles(arc: DataFrame) -> DataFrame:
    """src, dst: arcs between two nodes that have an arc back."""
    one = arc.filter("src <> dst and src <> -dst").select("src", "dst")
    return one.join(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])


def drop_nodes(nodes: DataFrame, arc: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes in ``gone`` (id)."""
    key = gone.select("id").distinct()
    left = arc.withColumns({"a": F.abs("src"), "b": F.abs("dst")}).join(key.withColumnRenamed("id", "a"), "a", "left_anti").join(key.withColumnRenamed("id", "b"), "b", "left_anti")
    return nodes.join(key, "id", "left_anti").select(*nodes.columns), left.select("src", "dst", "cov")


def _measured(nodes: DataFrame, arc: DataFrame) -> DataFrame:
    return cut(sides(nodes.select("id", "n", "kmer_cov"), arc).withColumn("avg", average_coverage()))


def certain_tips(low: DataFrame, arc: DataFrame) -> DataFrame:
    """id of the nodes of ``low`` (id, n_left, n_right) that go whatever is beside them: loops and the first of two nodes in a
    cycle, with one way in and one out; dead ends that are isolated or have two ways or more at their other end."""
    through = low.filter("n_right = 1 and n_left = 1")
    cycles = two_cycles(arc).select(F.abs("src").alias("id")).distinct()
    free = dead_ends(low).filter("n_right + n_left <> 1").select("id")
    return self_loops(through, arc).select("id").union(through.join(cycles, "id", "left_semi").select("id")).union(free).distinct()


def tips(nodes: DataFrame, arc: DataFrame, cutoff: float, longest: int) -> DataFrame:
    """id of the low (covered up to ``cutoff``), short (up to ``longest`` k-mers) nodes that one pass takes away: those of
    ``certain_tips``, and dead ends that lead to a node that a better covered one leads to as well.

    Every pass sees the graph as it was before the pass, so of two tips at one place the better covered one stays, and of
    equal ones all.
    """
    sided = _measured(nodes, arc)
    low = sided.filter((F.col("avg") <= cutoff) & (F.col("n") <= longest))
    one = dead_ends(low).filter("n_right + n_left = 1").select("id", "avg")
    into = arc.withColumn("id", F.abs("src")).join(one, "id").select("id", "dst", "avg")
    rival = arc.withColumn("other", F.abs("src")).join(sided.select(F.col("id").alias("other"), F.col("avg").alias("rival_avg")), "other").select("dst", "other", "rival_avg")
    # the best of what leads to a place decides for all tips there
    best = rival.join(into.select("dst").distinct(), "dst", "left_semi").groupBy("dst").agg(F.max("rival_avg").alias("best"))
    beaten = into.join(best, "dst").filter("avg < best").select("id")
    return cut(certain_tips(low, arc).union(beaten).distinct())


def _suffix_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            scores = banded_scores(part.column("a").to_pylist(), part.column("b").to_pylist(), TIP_BAND)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("dst", "tip", "other", "avg", "name")] + [pa.array(scores > 0)], ["dst", "tip", "other", "avg", "name", "alike"])


def aligned_tips(nodes: DataFrame, arc: DataFrame, k: int, cutoff: float, longest: int) -> DataFrame:
    """id of the low, short nodes that a sequential pass takes away: first those of ``certain_tips``, then, least covered
    (and smallest sequence) first, each dead end with one way out whose letters are alike to those of another node
    that still leads to the same place.

    Of both the last letters are compared, as many as the shorter one has and without the k - 1 that they share; they are
    alike if fewer than k are left or if an alignment with up to two gaps scores above 0. A tip has one place, so places
    do not touch each other: each holds at most four nodes, and its tips are gone through in one row.
    """
    sided = _measured(nodes, arc)
    certain = cut(certain_tips(sided.filter((F.col("avg") <= cutoff) & (F.col("n") <= longest)), arc))
    kept, arcs_left = drop_nodes(nodes.select("id", "seq", "n", "kmer_cov"), arc, certain)
    ways = cut(arcs_left)
    low = sides(kept.withColumn("avg", average_coverage()), ways).filter((F.col("avg") <= cutoff) & (F.col("n") <= longest) & (F.col("n_right") + F.col("n_left") == 1))
    oriented = lambda node: F.when(F.col(node) > 0, F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    into = ways.select("dst", F.col("src").alias("tip"), F.abs("src").alias("id")).join(low.select("id", "seq", "avg"), "id").select("dst", "tip", "avg", F.col("seq").alias("name"), oriented("tip").alias("x"))
    others = ways.select("dst", F.col("src").alias("other"), F.abs("src").alias("id")).join(into.select("dst").distinct(), "dst", "left_semi").join(kept.select("id", "seq"), "id")
    beside = into.join(others.select("dst", "other", oriented("other").alias("y")), "dst").filter("tip <> other")
    m = F.least(F.length("x"), F.length("y"))
    tail = lambda c: F.left(F.right(c, m), m - (k - 1))
    texts = cut(beside.select("dst", "tip", "other", "avg", "name", tail(F.col("x")).alias("a"), tail(F.col("y")).alias("b")))
    near = texts.filter(F.length("a") < k).select("dst", "tip", "other", "avg", "name", F.lit(True).alias("alike"))
    scored = texts.filter(F.length("a") >= k).mapInArrow(_suffix_scores, "dst long, tip long, other long, avg double, name string, alike boolean")
    rivals = near.unionByName(scored).filter("alike").groupBy("dst", "tip", "avg", "name").agg(F.collect_set("other").alias("others"))
    place = rivals.groupBy("dst").agg(F.array_sort(F.collect_list(F.struct("avg", "name", "tip", "others"))).alias("tips"))
    none = F.array().cast("array<long>")
    gone = F.aggregate("tips", none, lambda out, t: F.when(F.size(F.array_except(t["others"], out)) > 0, F.concat(out, F.array(t["tip"]))).otherwise(out))
    return cut(certain.union(place.select(F.explode(gone).alias("tip")).select(F.abs("tip").alias("id"))).distinct())


def clip_tips(nodes: DataFrame, arc: DataFrame, cutoff: float, longest: int) -> tuple[DataFrame, DataFrame]:
    """One pass of ``tips`` over the whole graph."""
    return drop_nodes(nodes, arc, tips(nodes, arc, cutoff, longest))


def bubbles(nodes: DataFrame, arc: DataFrame, cutoff: float, longest: int) -> DataFrame:
    """id of low, short nodes on a parallel path: one way in and one out, from and to the same nodes as a better covered one.

    Paths without branches are one node each after ``concatenate``, so nodes with equal ends are what has to be compared.
    """
    sided = sides(nodes.select("id", "n", "kmer_cov"), arc).withColumn("avg", average_coverage()).filter("n_right = 1 and n_left = 1")
    out = arc.filter("src > 0").select(F.col("src").alias("id"), F.col("dst").alias("after"))
    back = arc.filter("src < 0").select((-F.col("src")).alias("id"), (-F.col("dst")).alias("before"))
    ended = sided.join(out, "id").join(back, "id").filter("abs(before) <> id and abs(after) <> id")
    # a path and its other strand have the same ends
    turned = (F.col("before") > -F.col("after")) | ((F.col("before") == -F.col("after")) & (F.col("id") < 0))
    ends = cut(ended.select("id", "n", "avg", F.when(turned, -F.col("after")).otherwise(F.col("before")).alias("a"), F.when(turned, -F.col("before")).otherwise(F.col("after")).alias("b")))
    best = ends.groupBy("a", "b").agg(F.max(F.struct("avg", "id")).alias("best"))
    return ends.join(best, ["a", "b"]).filter((F.col("id") != F.col("best.id")) & (F.col("avg") <= cutoff) & (F.col("n") <= longest)).select("id")


def clean(nodes: DataFrame, arc: DataFrame, k: int, cutoff: float, read_length: int) -> tuple[DataFrame, DataFrame]:
    """The cleaning schedule: tips and then bubbles, each until none is left, then one pass over parallel paths that branch
    inside, all again until nothing changes and with paths joined after every pass, under a coverage cutoff that rises by 1 up to ``cutoff`` and a length that rises by k / 2 up to ``read_length``."""
    from .paths import cut_parallel_paths  # which builds on this module

    level, longest = 1.0, k + 1
    while True:
        changed = True
        while changed:
            changed = False
            for find in (partial(aligned_tips, k=k), bubbles):
                while (gone := cut(find(nodes, arc, cutoff=level, longest=longest))).limit(1).count():
                    nodes, arc = concatenate(*drop_nodes(nodes, arc, gone), k)
                    changed = True
            nodes, arc, n = cut_parallel_paths(nodes, arc, k, level, longest)
            if n:
                nodes, arc = concatenate(nodes, arc, k)
                changed = True
        if level >= cutoff and longest >= read_length - k:
            return nodes, arc
        level, longest = min(level + 1, cutoff), min(longest + k // 2, read_length)


def chain_valid(chains: DataFrame, arc: DataFrame) -> DataFrame:
    """id, valid: whether every step of ``chain`` (array of nodes) is an arc; ``chains`` has id, ``arc`` has src and dst."""
    step = chains.select("id", F.explode_outer(F.when(F.size("chain") > 1, F.transform(F.sequence(F.lit(0), F.size("chain") - 2), lambda i: F.struct(F.get("chain", i).alias("src"), F.get("chain", i + 1).alias("dst"))))).alias("s"))
    known = arc.select("src", "dst").distinct().withColumn("there", F.lit(True))
    return step.select("id", "s.src", "s.dst").join(known, ["src", "dst"], "left").groupBy("id").agg(F.bool_and(F.col("src").isNull() | F.coalesce("there", F.lit(False))).alias("valid"))


def read_start_statistics(nodes: DataFrame, least: int = 30, most: int = 100, share: float = 0.05) -> DataFrame:
    """mean and variance (of a sample) of read starts per k-mer over the longest nodes (id, n, read_start_cov): at least
    ``least`` of them, then as many as it takes to hold ``share`` of all k-mers, at most ``most``.

    Only the ``most`` longest are ordered, so the window sees a bounded number of rows.
    """
    total = nodes.agg(F.sum("n").alias("total"))
    top = nodes.orderBy(F.desc("n"), "id").limit(most)
    order = Window.orderBy(F.desc("n"), "id")
    ranked = top.withColumns({"at": F.row_number().over(order), "before": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    chosen = ranked.join(F.broadcast(total)).filter((F.col("at") <= least) | (F.col("before") < share * F.col("total")))  # total is one row
    return chosen.agg(F.avg(F.col("read_start_cov") / F.col("n")).alias("mean"), F.var_samp(F.col("read_start_cov") / F.col("n")).alias("variance"))


def multiplicity_by_score(nodes: DataFrame, mean: float, most: int = 10, close: float = 3.5, sure: float = 3.0) -> DataFrame:
    """``nodes`` (id, n, read_start_cov) with multiplicity: the m up to ``most`` whose expected number of read starts,
    m * mean * n with the spread of a Poisson count, is nearest in standard scores, and below ``close``; 0 if m improved
    more than once on the way, or if the score is not below ``sure``."""
    grid = F.sequence(F.lit(1), F.lit(most))
    scored = nodes.withColumn("z", F.transform(grid, lambda m: F.abs(F.col("read_start_cov") - m * mean * F.col("n")) / F.sqrt(m * mean * F.col("n"))))
    first = F.struct(F.lit(0).alias("m"), F.lit(float(close)).alias("z"), F.lit(0).alias("times"))
    better = lambda s, m: F.when(F.get("z", m - 1) < s["z"], F.struct(m.alias("m"), F.get("z", m - 1).alias("z"), (s["times"] + 1).alias("times"))).otherwise(s)
    kept = scored.withColumn("best", F.aggregate(grid, first, better))
    sure_one = (F.col("best.times") == 1) & (F.col("best.z") < sure)
    return kept.withColumn("multiplicity", F.when(sure_one, F.col("best.m")).otherwise(0)).drop("z", "best")


def consecutive(positions: DataFrame, arc: DataFrame, *keys: str) -> DataFrame:
    """``positions`` (keys, pos, node, node_pos, node_n) with ``follows``: whether a k-mer goes on where the one before it in
    its read ended, in the same node or over an arc from a node's end to a node's start."""
    order = Window.partitionBy(*keys).orderBy("pos")
    lagged = positions.withColumns({"p": F.lag("pos").over(order), "a": F.lag("node").over(order), "a_pos": F.lag("node_pos").over(order), "a_n": F.lag("node_n").over(order)})
    known = arc.select(F.col("src").alias("a"), F.col("dst").alias("node"), F.lit(True).alias("arc")).distinct()
    beside = lagged.join(known, ["a", "node"], "left")
    inside = (F.col("a") == F.col("node")) & (F.col("node_pos") == F.col("a_pos") + 1)
    across = F.coalesce("arc", F.lit(False)) & (F.col("a_pos") == F.col("a_n") - 1) & (F.col("node_pos") == 0)
    return beside.withColumn("follows", F.coalesce((F.col("p") == F.col("pos") - 1) & (inside | across), F.lit(False))).select(*positions.columns, "follows")


def node_seeds(positions: DataFrame, arc: DataFrame, *keys: str) -> DataFrame:
    """keys, first, last, chain: the maximal runs of read positions that follow each other in the graph, and their nodes."""
    order = Window.partitionBy(*keys).orderBy("pos")
    runs = consecutive(positions, arc, *keys).withColumn("run", F.sum((~F.col("follows")).cast("int")).over(order))
    first = (F.col("node_pos") == 0) | ~F.col("follows")
    entered = F.array_sort(F.collect_list(F.when(first, F.struct("pos", "node"))))
    return runs.groupBy(*keys, "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.transform(entered, lambda x: x["node"]).alias("chain")).drop("run")


def reversed_positions(positions: DataFrame, last: str) -> DataFrame:
    """``positions`` of the read's other strand: nodes are negated, places counted from the other end; ``last`` is the column
    with the read's last k-mer position."""
    return positions.withColumns({"pos": F.col(last) - F.col("pos"), "node": -F.col("node"), "node_pos": F.col("node_n") - 1 - F.col("node_pos")})
