"""Chains of signed nodes: counts, sub-chains, variable-order Markov contexts, and runs of a reference that a graph holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import canonical, canonical_chain, explode_kmers, rc_chain
from .iterate import cut

LONGEST = 15
#: Steps are judged only where so many are expected, and given up by so many powers of ten.
LEAST_EXPECTED, LEAST_LOG = 5.0, 1.0


def counted(chains: DataFrame) -> DataFrame:
    """chain (the smaller of both directions), n; ``chains`` has chain."""
    return chains.groupBy(canonical_chain(F.col("chain")).alias("chain")).agg(F.count("*").alias("n"))


def subchains(chains: DataFrame, longest: int = LONGEST + 1) -> DataFrame:
    """id, sub: every run of 2 to ``longest`` nodes, in both directions."""
    both = chains.select("id", F.explode(F.array(F.col("chain"), rc_chain(F.col("chain")))).alias("c")).filter("size(c) > 1")
    ends = both.select("id", "c", F.explode(F.sequence(F.lit(2), F.size("c"))).alias("e"))
    sizes = ends.select("id", "c", "e", F.explode(F.sequence(F.lit(2), F.least(F.col("e"), F.lit(longest)))).alias("n"))
    return sizes.select("id", F.slice("c", F.col("e") - F.col("n") + 1, F.col("n")).alias("sub"))


def measured(chains: DataFrame, lengths: DataFrame) -> DataFrame:
    """``chains`` (id, each once, and chain) with sizes, the k-mers of each node; ``lengths`` has node (positive) and n, and a
    node that it lacks has none."""
    step = chains.select("id", F.posexplode("chain").alias("at", "x")).withColumn("node", F.abs("x"))
    sized = step.join(lengths.select("node", "n"), "node", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "x", F.coalesce("n", F.lit(0)).cast("long").alias("n")))).alias("c"))
    return sized.select("id", F.transform("c", lambda y: y["x"]).alias("chain"), F.transform("c", lambda y: y["n"]).alias("sizes"))


def contexts_by_last(chains: DataFrame, longest: int = LONGEST, k: int = 0) -> DataFrame:
    """last, order, context, next, freq as ``contexts`` has them, dealt by the last node of the context, and if ``chains`` has
    sizes also length: k plus the k-mers of all nodes of the context and of the next one.

    All contexts that end at one place of a chain share their last node, and so do the contexts that a context ends with. So
    what is shuffled is one row for each place, which is spread out behind the shuffle, and what is grouped by last and
    context from there on is shuffled no more.
    """
    sized = "sizes" in chains.columns
    ways = [F.struct(F.col("chain").alias("c"), *([F.col("sizes").alias("s")] if sized else [])), F.struct(rc_chain(F.col("chain")).alias("c"), *([F.reverse("sizes").alias("s")] if sized else []))]
    both = chains.filter("size(chain) > 1").select(F.explode(F.array(*ways)).alias("w")).select("w.*")
    ends = both.select("*", F.explode(F.sequence(F.lit(2), F.size("c"))).alias("e"))
    first, n = F.greatest(F.lit(1), F.col("e") - longest), F.least(F.col("e"), F.lit(longest + 1))
    tails = ends.select(F.get("c", F.col("e") - 2).alias("last"), *[F.slice(x, first, n).alias(x) for x in ("c", "s")[: 1 + sized]]).repartition("last")
    sizes = tails.select("*", F.explode(F.sequence(F.lit(2), F.size("c"))).alias("m"))
    total = [F.aggregate(F.slice("s", -F.col("m"), F.col("m")), F.lit(k).cast("long"), lambda a, x: a + x).alias("length")] if sized else []
    sub = sizes.select("last", (F.col("m") - 1).alias("order"), F.slice("c", -F.col("m"), F.col("m")).alias("sub"), *total)
    counts = sub.groupBy("last", "order", "sub").agg(F.count("*").alias("freq"), *([F.max("length").alias("length")] if sized else []))
    return counts.select("last", "order", F.slice("sub", F.lit(1), F.col("order")).alias("context"), F.element_at("sub", -1).alias("next"), "freq", *(["length"] if sized else []))


def contexts(chains: DataFrame, longest: int = LONGEST) -> DataFrame:
    """order, context, next, freq: how often a node follows a context of 1 to ``longest`` nodes, in both directions."""
    return contexts_by_last(chains.select("chain"), longest).drop("last")


def decided(found: DataFrame) -> DataFrame:
    """``found`` (freq, expected) with ``accepted``: false where seeing it so seldom is ten times likelier for an error
    that happens once than for what is expected. The factorials of both Poisson densities cancel."""
    log_odds = (-1.0 - (F.col("freq") * F.ln("expected") - F.col("expected"))) / F.ln(F.lit(10.0))
    rejected = (F.col("freq") < F.col("expected")) & (F.col("expected") >= LEAST_EXPECTED) & (log_odds > LEAST_LOG)
    return found.withColumn("accepted", ~rejected)


def expected_coverage(coverage: float, average: float, length: str):
    """How often a context of ``length`` bases is seen whole in a read, a hundredth of the bases being wrong."""
    return coverage / average * F.greatest(F.lit(average) - F.col(length) + 1, F.lit(0.0)) * F.pow(F.lit(0.99), F.col(length))


def allowed_next(chains: DataFrame, decisions: DataFrame) -> DataFrame:
    """id, next: of the contexts that a chain ends with, the longest one with an accepted step decides which nodes may
    follow. ``decisions`` has order, context, next, accepted.

    The longest one is found first, from names of contexts only; the nodes that may follow it are joined last, so they are
    not shuffled with the chains, of which many may end with one context.
    """
    accepted = _by_last(decisions.filter("accepted")).groupBy("last", "context").agg(F.array_sort(F.collect_set("next")).alias("next"))
    known = cut(accepted.select("context", "next"))
    orders = F.sequence(F.lit(1), F.least(F.size("chain"), F.lit(LONGEST)))
    ends = chains.filter("size(chain) > 0").select("id", F.explode(F.transform(orders, lambda n: F.slice("chain", -n, n))).alias("context"))
    there = ends.join(known.select("context").hint("merge"), "context", "left_semi")
    best = there.groupBy("id").agg(F.max_by("context", F.size("context")).alias("context"))
    return best.join(known.hint("merge"), "context").select("id", "next")


def valid_nodes(chains: DataFrame, known: DataFrame) -> DataFrame:
    """id, valid: whether every negative node of a chain is among ``known`` (node)."""
    step = chains.select("id", F.explode("chain").alias("node"))
    there = known.distinct().withColumn("there", F.lit(True))
    return step.join(there, "node", "left").groupBy("id").agg(F.bool_and((F.col("node") > 0) | F.coalesce("there", F.lit(False))).alias("valid"))


def segments(reference: DataFrame, held: DataFrame, k: int, key: str) -> DataFrame:
    """key, first, last, kind: maximal runs of k-mers of a reference (key, seq) that ``held`` (kmer) has (CONTIG) or lacks
    (BREAK)."""
    placed = explode_kmers(reference.select(key, "seq"), k).select(key, "pos", canonical(F.col("kmer")).alias("kmer"))
    hit = placed.join(held.select("kmer", F.lit(True).alias("there")), "kmer", "left").select(key, "pos", F.coalesce("there", F.lit(False)).alias("there"))
    order = Window.partitionBy(key).orderBy("pos")
    turn = hit.withColumn("turn", (~F.col("there").eqNullSafe(F.lag("there").over(order))).cast("int"))
    run = turn.withColumn("run", F.sum("turn").over(order))
    ends = run.groupBy(key, "run", "there").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return ends.select(key, "first", "last", F.when(F.col("there"), "CONTIG").otherwise("BREAK").alias("kind"))


def break_kinds(found: DataFrame, key: str) -> DataFrame:
    """``found`` with a break at either end of its reference named DELETION, as nothing beyond it is known."""
    order = Window.partitionBy(key).orderBy("first")
    inner = F.lag("kind").over(order).isNotNull() & F.lead("kind").over(order).isNotNull()
    return found.withColumn("kind", F.when((F.col("kind") == "BREAK") & ~inner, "DELETION").otherwise(F.col("kind")))


def true_multiplicity(positions: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, multiplicity: k-mers of a reference that lie in the node, over its own; ``nodes`` has seq."""
    hits = positions.groupBy("node").agg(F.count("*").alias("hits"))
    sized = nodes.select(F.col("seq").alias("node"), (F.length("seq") - k + 1).alias("n"))
    return sized.join(hits, "node", "left").select("node", F.round(F.coalesce("hits", F.lit(0)) / F.col("n")).cast("int").alias("multiplicity"))


def seeds(positions: DataFrame, *keys: str) -> DataFrame:
    """keys, node, strand, diagonal, first, last: runs of read positions that stay on one diagonal of one node."""
    diagonal = positions.withColumn("diagonal", F.col("node_pos") - F.col("pos"))
    return diagonal.groupBy(*keys, "node", "strand", "diagonal").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"))


def occurrences(chains: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, at, sub: where a chain of ``wanted`` (sub), on either strand, occurs in ``chains`` (id, chain), found by its first
    node and compared whole; places are counted from 0."""
    both = wanted.select("sub", F.explode(F.array_distinct(F.array(F.col("sub"), rc_chain(F.col("sub"))))).alias("way")).filter("size(way) > 0")
    placed = chains.select("id", "chain", F.posexplode("chain").alias("at", "node"))
    hit = placed.join(both.withColumn("node", F.element_at("way", 1)), "node").filter(F.slice("chain", F.col("at") + 1, F.size("way")) == F.col("way"))
    return hit.select("id", "at", "sub").distinct()


def context_lengths(found: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """``found`` (order, context, next, freq) with length: k plus the k-mers of all nodes of the context and of the next
    one; ``lengths`` has node (positive) and n."""
    keyed = found.withColumn("key", F.xxhash64("order", "context", "next"))
    node = keyed.select("key", F.explode(F.concat("context", F.array("next"))).alias("node")).withColumn("node", F.abs("node"))
    total = node.join(lengths.select("node", "n").hint("merge"), "node").groupBy("key").agg((F.sum("n") + k).alias("length"))
    return keyed.join(total.hint("merge"), "key").drop("key")  # a row for each context, too many to broadcast


def _by_last(decisions: DataFrame) -> DataFrame:
    """``decisions`` with last, the last node of the context, dealt by it if they are not already."""
    return decisions if "last" in decisions.columns else decisions.withColumn("last", F.element_at("context", -1)).repartition("last")


def propagated(decisions: DataFrame) -> DataFrame:
    """``decisions`` (order, context, next, accepted) without the contexts that end with a shorter one which has a single
    accepted next node: they cannot decide otherwise.

    A context and all that it ends with have one last node. Rows are dealt by it once; what is asked for and what there is
    then meet in groups of one name, a window and not a join, so nothing is broadcast and nothing is shuffled again.
    """
    names = [c for c in decisions.columns if c != "last"]
    rest = [c for c in names if c not in ("order", "context")]
    whole = _by_last(decisions).groupBy("last", "order", "context").agg(F.collect_list(F.struct(*rest)).alias("steps"), (F.count_if("accepted") == 1).alias("single"))
    # its own name comes with its steps, the names of what it ends with come without
    ends = F.transform(F.sequence(F.lit(1), F.col("order")), lambda n: F.struct(F.slice("context", -n, n).alias("name"), (n == F.col("order")).alias("own")))
    asked = whole.select("*", F.explode(ends).alias("x")).select("last", "order", "context", "x.name", "x.own", (F.col("x.own") & F.col("single")).alias("single"), F.when(F.col("x.own"), F.col("steps")).alias("steps"))
    met = asked.withColumn("single", F.bool_or("single").over(Window.partitionBy("last", "name")))
    left = met.groupBy("last", "order", "context").agg(F.bool_or(F.col("single") & ~F.col("own")).alias("gone"), F.first("steps", ignorenulls=True).alias("steps"))
    return left.filter(~F.col("gone")).select("order", "context", F.explode("steps").alias("x")).select("order", "context", "x.*").select(*names)


def paired_counts(pairs: DataFrame) -> DataFrame:
    """chain1, turned1, chain2, turned2, n: how often the chains of two mates (chain1, chain2) occur together, each as the
    smaller of both directions and whether it was turned for that. Mates face each other, so the second is turned if it is
    the smaller one already."""
    own = [F.col(c) == canonical_chain(F.col(c)) for c in ("chain1", "chain2")]
    named = pairs.select(canonical_chain(F.col("chain1")).alias("chain1"), (~own[0]).alias("turned1"), canonical_chain(F.col("chain2")).alias("chain2"), own[1].alias("turned2"))
    return named.groupBy("chain1", "turned1", "chain2", "turned2").agg(F.count("*").alias("n"))


def insert_sizes(positions: DataFrame, k: int) -> DataFrame:
    """pair_id, node, size: for each node that k-mers of both mates lie in, the bases from the first to the last of them.
    ``positions`` has pair_id, mate, node (signed), node_pos and node_n."""
    kept = F.when(F.col("node") > 0, F.col("node_pos")).otherwise(F.col("node_n") - 1 - F.col("node_pos"))
    both = positions.groupBy("pair_id", F.abs("node").alias("node")).agg(F.count_distinct("mate").alias("mates"), (F.max(kept) - F.min(kept) + k).alias("size"))
    return both.filter("mates = 2").select("pair_id", "node", "size")


def trimmed_moments(values: DataFrame, name: str) -> DataFrame:
    """mean and deviation (rounded to integers) of what is left of a column of integers without its lowest and highest
    quarter, and how many these are.

    The quarters are cut from counts of values, a row for each distinct one, so no value is sorted.
    """
    counts = values.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("x")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("x"))  # a row for each distinct value
    whole = counts.agg(F.sum("n").alias("all")).select("all", F.floor(F.col("all") / 4).alias("cut"))
    placed = counts.withColumn("upto", upto).join(F.broadcast(whole))  # one row
    left = F.greatest(F.lit(0), F.least("upto", F.col("all") - F.col("cut")) - F.greatest(F.col("upto") - F.col("n"), F.col("cut")))
    kept = placed.withColumn("left", left)
    mean = kept.agg(F.sum("left").alias("n"), F.round(F.sum(F.col("x") * F.col("left")) / F.nullif(F.sum("left"), F.lit(0))).alias("mean"))
    off = kept.join(F.broadcast(mean.select("mean", F.col("n").alias("m"))))  # one row
    spread = off.agg(F.round(F.sqrt(F.sum(F.col("left") * (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean"))) / F.nullif(F.max("m"), F.lit(0)))).alias("deviation"))
    return mean.join(F.broadcast(spread)).select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("mean").cast("double").alias("mean"), F.col("deviation").cast("double").alias("deviation"))
