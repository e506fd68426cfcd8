"""Community detection: edge tables, ten quality functions, Louvain, hierarchies.

An undirected edge is one row (src <= dst, w). n is the number of nodes, m2 the sum of weighted degrees (a loop counts
once), and of a community: inside the weight of its inner edges twice (loops once), total the degrees of its nodes, size
their number.

Several networks (``runs``) may stand in one table, whose nodes are then named by ``keyed``; they do not touch, and each has
constants of its own.
"""

from __future__ import annotations

import random
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import connected_components, cut


#: Edges of small components that are solved in one group, about.
DEALT = 1 << 16
#: Edges of a component that is solved in one task; so many take its worker some 1,100 MB.
HELD = 1 << 22


def keyed(node: Column, run: Column, runs: int) -> Column:
    """The name of a node in the network ``run`` (from 0) of ``runs``; names keep the order of nodes."""
    return node * runs + run


def run_of(key: Column, runs: int) -> Column:
    return F.pmod(key, F.lit(runs)).cast("int")


def unkeyed(df: DataFrame, runs: int, *keys: str) -> DataFrame:
    """``df`` with run, and with its columns ``keys`` as nodes again."""
    first = df.withColumn("run", run_of(F.col(keys[0]), runs))
    return first.withColumns({c: F.call_function("div", F.col(c) - F.col("run"), F.lit(runs)) for c in keys})


def _by_run(df: DataFrame, key: str, runs: int, *columns: Column) -> DataFrame:
    """``columns`` summed up over all of ``df``, or over each run (column run) if there are several."""
    return df.agg(*columns) if runs == 1 else df.groupBy(run_of(F.col(key), runs).alias("run")).agg(*columns)


def _beside(df: DataFrame, sums: DataFrame, runs: int) -> DataFrame:
    return df.join(F.broadcast(sums)) if runs == 1 else df.join(F.broadcast(sums), "run")  # a row a run


def merge_edges(edges: DataFrame) -> DataFrame:
    """Edges between the same two nodes become one, with the sum of their weights."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "w").union(edges.filter("src <> dst").select("dst", "src", "w"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree, loop, n_neighbours."""
    return symmetric(edges).groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)).alias("loop"), F.count("*").alias("n_neighbours"))


def neighbour_weights(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """node, community, w: the weight of each node's edges into each community (loops left out)."""
    where = partition.select(F.col("node").alias("dst"), "community")
    return symmetric(edges).filter("src <> dst").join(where, "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("w").alias("w"))


def coarsen(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """The graph of communities; an inner edge becomes loop weight twice, as both of its ends lie inside."""
    a = partition.select(F.col("node").alias("src"), F.col("community").alias("ca"))
    b = partition.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    both = edges.join(a, "src").join(b, "dst")
    w = F.when((F.col("ca") == F.col("cb")) & (F.col("src") != F.col("dst")), 2 * F.col("w")).otherwise(F.col("w"))
    return both.groupBy(F.least("ca", "cb").alias("src"), F.greatest("ca", "cb").alias("dst")).agg(F.sum(w).alias("w"))


def reweighted(edges: DataFrame, way: str) -> DataFrame:
    """Edges of both directions with the weights that two of the quality functions work on, and ``part``, what each adds
    to their constant. ``profile``: 2w / (d + d'). ``condorcet``: 4w / (d + d') less the halved loops over the degrees."""
    d = degrees(edges)
    both = symmetric(edges).join(d.select(F.col("node").alias("src"), F.col("n_neighbours").alias("d1"), F.col("loop").alias("l1")), "src")
    both = both.join(d.select(F.col("node").alias("dst"), F.col("n_neighbours").alias("d2"), F.col("loop").alias("l2")), "dst")
    even = 2.0 * F.col("w") / (F.col("d1") + F.col("d2"))
    loops = F.col("l1") / (2.0 * F.col("d1")) + F.col("l2") / (2.0 * F.col("d2"))
    if way == "profile":
        return both.select("src", "dst", even.alias("w"), (even * even).alias("part"))
    return both.select("src", "dst", (2.0 * even - loops).alias("w"), (loops - even).alias("part"))


def _communities(directed: DataFrame, partition: DataFrame) -> DataFrame:
    """community, inside, total, size of a table of edges in both directions."""
    a = partition.select(F.col("node").alias("src"), F.col("community").alias("ca"))
    b = partition.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    sums = directed.join(a, "src").join(b, "dst").groupBy(F.col("ca").alias("community")).agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("total"))
    size = partition.groupBy("community").agg(F.count("*").cast("double").alias("size"))
    return size.join(sums, "community", "left").fillna(0.0, ["inside", "total"])


def _scalars(edges: DataFrame, partition: DataFrame, runs: int = 1) -> DataFrame:
    m2 = _by_run(symmetric(edges), "src", runs, F.sum("w").alias("m2"), F.max("w").alias("top"))
    return _beside(m2, _counted(partition, runs), runs)


def _counted(partition: DataFrame, runs: int) -> DataFrame:
    return _by_run(partition, "node", runs, F.count("*").cast("double").alias("n"), F.countDistinct("community").cast("double").alias("kappa"))


QUALITIES = ("modularity", "zahn", "owzad", "goldberg", "condorcet", "devind", "devuni", "profile", "shimalik", "balmod")


def quality(edges: DataFrame, partition: DataFrame, name: str, alpha: float = 0.5, runs: int = 1) -> DataFrame:
    """One row with ``quality``: how good a partition (node, community) of a graph is; of several runs, run and quality of
    each that has edges."""
    label = ["run"] if runs > 1 else []
    i, t, s = F.col("inside"), F.col("total"), F.col("size")
    m2, top, n, kappa = F.col("m2"), F.col("top"), F.col("n"), F.col("kappa")
    if name in ("condorcet", "profile"):
        heavy = reweighted(edges, name)
        c = _by_run(_communities(heavy, partition), "community", runs, F.sum("inside").alias("inside"), F.sum(2.0 * i / s).alias("dense"))
        whole = _beside(_beside(_by_run(heavy, "src", runs, F.sum("part").alias("part"), F.max("w").alias("top")), c, runs), _counted(partition, runs), runs)
        value = (i + F.col("part")) / (n * n) if name == "condorcet" else (F.col("dense") - F.col("part") - kappa) / (n * n * top)
        return whole.select(*label, value.alias("quality"))
    c = _communities(symmetric(edges), partition)
    c = _beside(c.withColumn("run", run_of(F.col("community"), runs)) if runs > 1 else c, _scalars(edges, partition, runs), runs)
    term, after = {
        "modularity": (i - t * t / m2, lambda x: x / m2),
        "zahn": (2.0 * i - top * s * s, lambda x: (x + n * n * top - m2) / (n * n * top)),
        "owzad": (i - alpha * s * s * top, lambda x: (x + alpha * (n * n * top - m2)) / (n * n * top)),
        "goldberg": (i / (2.0 * s), lambda x: x / (n * top)),
        "devind": (i - 2.0 * t * s / n + s * s * m2 / (n * n), lambda x: x / m2),
        "devuni": (i - s * s * m2 / (n * n), lambda x: x / m2),
        "shimalik": (F.when(t > 0, i / t).otherwise(0.0), lambda x: (x - kappa) / n),
        "balmod": (2.0 * i - t * t / m2 - s * s * top + (n * s * top - t) * (n * s * top - t) / (n * n * top - m2), lambda x: x / (n * n * top)),
    }[name]
    return c.groupBy(*label, "m2", "top", "n", "kappa").agg(F.sum(term).alias("x")).select(*label, after(F.col("x")).alias("quality"))


def _gainer(name: str, g: dict, alpha: float) -> Callable[[float, float, float, float, float, float, float], float]:
    """What a lone node gains by joining a community, of link (their weight), deg, loop, wu (of the node), inside, total, size."""
    n, m2, top = g["n"], g["m2"], g["top"]

    def balmod(link, deg, loop, wu, inside, total, size):
        return 2 * link - deg * total / m2 - wu * size * top + (n * wu * top - deg) * (n * size * top - total) / (n * n * top - m2)

    def goldberg(link, deg, loop, wu, inside, total, size):
        return (inside + 2 * link + loop) / (2 * (size + wu)) - (inside / (2 * size) if size else 0.0)

    def profile(link, deg, loop, wu, inside, total, size):
        return (inside + 2 * link + loop) / (size + wu) - (inside / size if size else 0.5)

    def shimalik(link, deg, loop, wu, inside, total, size):
        return ((inside + 2 * link + loop) / (total + deg) if total + deg else 0.0) - (inside / total if total else 1.0)

    return {
        "modularity": lambda link, deg, loop, wu, inside, total, size: link - total * deg / m2,
        "zahn": lambda link, deg, loop, wu, inside, total, size: 2 * link - wu * size * top,
        "owzad": lambda link, deg, loop, wu, inside, total, size: link - alpha * wu * size * top,
        "goldberg": goldberg,
        "condorcet": lambda link, deg, loop, wu, inside, total, size: link,
        "devind": lambda link, deg, loop, wu, inside, total, size: link - (total * wu + deg * size) / n + m2 * wu * size / (n * n),
        "devuni": lambda link, deg, loop, wu, inside, total, size: link - m2 * wu * size / (n * n),
        "profile": profile,
        "shimalik": shimalik,
        "balmod": balmod,
    }[name]


def _gain(name: str, link: float, deg: float, loop: float, wu: float, inside: float, total: float, size: float, g: dict, alpha: float) -> float:
    return _gainer(name, g, alpha)(link, deg, loop, wu, inside, total, size)


def _packed(kind: str, values: np.ndarray) -> array:
    """Numbers without an object each, which plain loops read faster than those of numpy."""
    return array(kind, np.ascontiguousarray(values, {"i": np.int32, "d": np.float64}[kind]).tobytes())


def _louvain_levels(src: np.ndarray, dst: np.ndarray, w: np.ndarray, name: str, g: dict, seed: int, alpha: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The nodes of one component and, for each level, their communities; a node that gains nowhere goes back with its own
    links. Edges are kept in arrays; with the rows they came in that is some 250 bytes each at most, while a level begins."""
    draw, gain = random.Random(seed), _gainer(name, g, alpha)
    nodes, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = ends[: len(src)].astype(np.int32), ends[len(src) :].astype(np.int32)
    n = len(nodes)
    home, low, weight, levels = np.arange(n), np.arange(n), np.ones(n), []  # low: the smallest node of what is a node now
    while True:
        apart = a != b
        one, other, both = np.concatenate([a[apart], b[apart]]), np.concatenate([b[apart], a[apart]]), np.concatenate([w[apart], w[apart]])
        order = np.lexsort((other, one))
        begin = _packed("i", np.searchsorted(one[order], np.arange(n + 1)))
        near, links_of = _packed("i", other[order]), _packed("d", both[order])
        loops = np.bincount(a[~apart], w[~apart], n)
        deg, loop, heft = _packed("d", np.bincount(one, both, n) + loops), _packed("d", loops), _packed("d", weight)
        del apart, one, other, both, order
        at = _packed("i", np.arange(n))
        inside, total, size = loop[:], deg[:], heft[:]
        order, moved_at_all = at[:], False
        draw.shuffle(order)
        while True:
            moved = 0
            for v in order:
                own, d, turns, wu = at[v], deg[v], loop[v], heft[v]
                links, first, end = {own: 0.0}, begin[v], begin[v + 1]
                for u, x in zip(near[first:end], links_of[first:end], strict=True):
                    c = at[u]
                    links[c] = links[c] + x if c in links else x
                inside[own] -= 2 * links[own] + turns
                total[own] -= d
                size[own] -= wu
                best, most = own, 0.0
                for c, link in links.items():
                    x = gain(link, d, turns, wu, inside[c], total[c], size[c])
                    if x > most + 1e-12:
                        best, most = c, x
                inside[best] += 2 * links[best] + turns
                total[best] += d
                size[best] += wu
                if best != own:
                    at[v] = best
                    moved += 1
            moved_at_all |= moved > 0
            if not moved:
                break
        if not moved_at_all:
            return nodes, levels or [nodes]
        now = np.frombuffer(at, np.int32)
        smallest = np.full(n, n)
        np.minimum.at(smallest, now, np.arange(n))
        kept, now = np.unique(smallest[now], return_inverse=True)
        low, home, n = low[kept], now[home], len(kept)
        levels.append(nodes[low[home]])
        weight = np.bincount(now, weight, n)
        x, y = now[a], now[b]
        key, place = np.unique(np.minimum(x, y) * n + np.maximum(x, y), return_inverse=True)
        w = np.bincount(place, np.where((x == y) & (a != b), 2 * w, w))
        a, b = (key // n).astype(np.int32), (key % n).astype(np.int32)


def louvain(edges: DataFrame, name: str = "modularity", seed: int = 1, alpha: float = 0.5, largest: int = HELD, runs: int = 1) -> DataFrame:
    """node, level, community (its smallest node) for any of the qualities, until no node can gain.

    Connected components of up to ``largest`` edges are optimised each inside a task, node by node, with the constants of the
    whole graph; larger ones by rounds of joins, see ``joined_louvain``. Both move nodes by the same gains. Condorcet and
    profile do so on reweighted edges, which may be negative. Several runs have their components found and solved together,
    run r with ``seed`` + r; only components for rounds of joins are gone through run by run.
    """
    merged = cut(merge_edges(edges))
    if name in ("condorcet", "profile"):
        merged = cut(reweighted(merged, name).filter("src <= dst").select("src", "dst", "w"))
    nodes = merged.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    where = cut(connected_components(nodes, merged))
    stats = {r["run"] if runs > 1 else 0: r for r in _scalars(merged, nodes.withColumn("community", F.lit(0)), runs).collect()}  # a row a run
    constants = {run: {x: r[x] if r["m2"] else 1.0 for x in ("n", "m2", "top")} for run, r in stats.items()}
    placed = merged.join(where.withColumnRenamed("node", "src"), "src").select("component", "src", "dst", "w")
    counts = cut(placed.groupBy("component").agg(F.count("*").alias("m")))
    alone, big = counts.filter((F.col("m") > DEALT) & (F.col("m") <= largest)), counts.filter(F.col("m") > largest)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["component", "src", "dst"])
        of, src, dst, w = (rows[c].to_numpy() for c in ("component", "src", "dst", "w"))
        begins, out = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)], []
        for i, j in zip(begins[:-1], begins[1:], strict=True):
            component = int(of[i])
            run = component % runs
            names, levels = _louvain_levels(src[i:j], dst[i:j], w[i:j], name, constants[run], (seed + run) * 1_000_003 + component // runs, alpha)
            out += [(names, np.full(len(names), k), level) for k, level in enumerate(levels, 1)]
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("node", "level", "community"), zip(*out, strict=True), strict=True)})

    def solve_all(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if rows := list(parts):
            yield solve(pd.concat(rows))

    # most components are tiny: some share a group, which holds about DEALT edges; a number of parts that is asked for is not
    # merged to a few tasks
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(parts, -(-placed.count() // DEALT))
    small = counts.filter(F.col("m") <= min(largest, DEALT)).select("component")
    dealt = placed.join(small, "component", "left_semi").withColumn("dealt", F.pmod(F.xxhash64("component"), F.lit(groups)))
    found = dealt.repartition(parts, "dealt").groupBy("dealt").applyInPandas(solve, "node long, level int, community long")
    if n_alone := alone.count():  # each has a task of its own; there is one for DEALT edges at most
        numbered = alone.select("component", (F.row_number().over(Window.orderBy("component")) - 1).alias("number"))
        whole = placed.join(F.broadcast(numbered), "component").repartitionById(n_alone, "number").drop("number")
        found = found.unionByName(whole.mapInPandas(solve_all, "node long, level int, community long"))
    for run in sorted(r[0] for r in big.select(run_of(F.col("component"), runs)).distinct().collect()):
        rest = placed.filter(run_of(F.col("component"), runs) == run).join(big.select("component"), "component", "left_semi").select("src", "dst", "w")
        found = found.unionByName(joined_louvain(rest, name, constants[run], seed + run, alpha))
    return cut(found)  # what is made of the levels reads them more than once


#: What counts as a gain beside the rounding of sums.
_TINY = 1e-9


def _worth(name: str, inside: Column, total: Column, size: Column, g: dict, alpha: float) -> Column:
    """What a community adds to a quality, up to factors and constants of the whole graph; 0 for an empty one."""
    n, m2, top = (F.lit(float(g[x])) for x in ("n", "m2", "top"))
    spare = g["n"] ** 2 * g["top"] - g["m2"]
    value = {
        "modularity": lambda: (inside - total * total / m2) / 2,
        "zahn": lambda: inside - top * size * size / 2,
        "owzad": lambda: (inside - alpha * size * size * top) / 2,
        "goldberg": lambda: inside / (2 * size),
        "condorcet": lambda: inside / 2,
        "devind": lambda: (inside - 2 * total * size / n + size * size * m2 / (n * n)) / 2,
        "devuni": lambda: (inside - size * size * m2 / (n * n)) / 2,
        "profile": lambda: inside / size - 0.5,
        "shimalik": lambda: F.when(total > 0, inside / total).otherwise(0.0) - 1,
        "balmod": lambda: inside - total * total / (2 * m2) - size * size * top / 2 + (n * size * top - total) * (n * size * top - total) / (2 * spare or 1.0),
    }[name]()
    return F.when(size > 0.5, value).otherwise(0.0)


def _links(both: DataFrame, at: DataFrame) -> DataFrame:
    """node, community, link, old: the weight of each node's edges into each community (loops left out), and its own one."""
    link = both.filter("src <> dst").join(at.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("w").alias("link"))
    return cut(link.join(at.withColumnRenamed("community", "old"), "node"))


def _sums(links: DataFrame, own: DataFrame, at: DataFrame, worth: Callable[[Column, Column, Column], Column]) -> tuple[DataFrame, float]:
    """community, inside, total, size, and what all are worth, from the ``links`` of all nodes; ``own`` has each node's size,
    degree and loop."""
    inner = links.filter("community = old").groupBy("community").agg(F.sum("link").alias("inner"))
    node = own.join(at, "node").groupBy("community").agg(F.sum("size").alias("size"), F.sum("degree").alias("total"), F.sum("loop").alias("loops"))
    sums = cut(node.join(inner, "community", "left").select("community", (F.col("loops") + F.coalesce("inner", F.lit(0.0))).alias("inside"), "total", "size"))
    return sums, sums.agg(F.sum(worth(F.col("inside"), F.col("total"), F.col("size")))).first()[0] or 0.0


def _moves(links: DataFrame, own: DataFrame, at: DataFrame, sums: DataFrame, worth: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """node, old, new, gain, up of the best move of every node that gains by one: what its new community is worth more with it
    than without it, less the same of the old one; up: whether the new community is the heavier one."""
    here = at.withColumnRenamed("community", "old")
    inner = links.filter("community = old").select("node", F.col("link").alias("own_link"))
    old = sums.select(F.col("community").alias("old"), F.col("inside").alias("i"), F.col("total").alias("t"), F.col("size").alias("s"))
    node = own.join(here, "node").join(inner, "node", "left").join(old, "old").withColumn("own_link", F.coalesce("own_link", F.lit(0.0)))
    loss = worth(F.col("i"), F.col("t"), F.col("s")) - worth(F.col("i") - 2 * F.col("own_link") - F.col("loop"), F.col("t") - F.col("degree"), F.col("s") - F.col("own_size"))
    node = node.withColumnRenamed("size", "own_size").select("node", "degree", "loop", "own_size", F.col("t").alias("left"), loss.alias("loss"))
    ahead = links.filter("community <> old").join(node, "node").join(sums, "community")
    i, t, s = F.col("inside"), F.col("total"), F.col("size")
    gain = worth(i + 2 * F.col("link") + F.col("loop"), t + F.col("degree"), s + F.col("own_size")) - worth(i, t, s) - F.col("loss")
    up = F.when(t == F.col("left"), F.col("community") < F.col("old")).otherwise(t > F.col("left"))
    best = ahead.select("node", "old", F.struct(gain.alias("gain"), (-F.col("community")).alias("new"), up.alias("up")).alias("m")).groupBy("node", "old").agg(F.max("m").alias("m"))
    return cut(best.select("node", "old", (-F.col("m.new")).alias("new"), "m.gain", "m.up").filter(F.col("gain") > _TINY))


def joined_louvain(edges: DataFrame, name: str, g: dict, seed: int = 1, alpha: float = 0.5) -> DataFrame:
    """node, level, community (its smallest node) by rounds of joins over the whole graph, for any quality.

    In a round every node finds its best move. All that go to a heavier community move at once or, in every other round, all
    that go from one half of the communities, picked by hash, to the other half: what nodes are drawn to does not leave
    meanwhile. If neither raises the quality, as moves meet in one community, those move that are the best of all that touch
    their old or their new community: they share no community, so their gains hold together and add up. So the quality rises
    in every round, and a level ends when no node can gain. Then communities become nodes, until a level moves nothing.
    """
    worth = lambda i, t, s: _worth(name, i, t, s, g, alpha)
    nodes = cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    home, size = nodes.withColumn("community", F.col("node")), nodes.withColumn("size", F.lit(1.0))
    found, level = None, 0
    while True:
        level += 1
        both = cut(symmetric(edges))
        own = cut(both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)).alias("loop")).join(size, "node"))
        at = own.select("node", F.col("node").alias("community"))
        links = _links(both, at)
        sums, value = _sums(links, own, at, worth)
        turn, moved = 0, False
        while True:
            moves, turn = _moves(links, own, at, sums, worth), turn + 1
            side = lambda c: F.pmod(F.xxhash64(c, F.lit(seed + turn)), F.lit(2))  # noqa: B023, E731
            across = side("old") < side("new")
            n = moves.agg(F.count("*").alias("all"), F.count_if("up").alias("rising"), F.count_if(across).alias("across")).first()
            if not n["all"]:
                break
            touched = moves.select(F.explode(F.array("old", "new")).alias("c"), F.struct("gain", F.xxhash64("node", F.lit(seed)), "node").alias("m")).groupBy("c").agg(F.max("m").alias("m"))
            best = touched.groupBy(F.col("m.node").alias("node")).agg(F.count("*").alias("n")).filter("n = 2").select("node")
            ways = [way for way, some in ((moves.filter("up"), n["rising"]), (moves.filter(across), n["across"])) if some]
            for some in (*(ways if turn % 2 else ways[::-1]), moves.join(best, "node", "left_semi")):
                there = cut(at.join(some.select("node", "new"), "node", "left").select("node", F.coalesce("new", "community").alias("community")))
                new_links = _links(both, there)
                new_sums, new_value = _sums(new_links, own, there, worth)
                if raised := new_value > value + _TINY:
                    at, links, sums, value, moved = there, new_links, new_sums, new_value, True
                    break
            if not raised:  # what is left to gain is below the rounding of sums
                break
        if not moved:
            return home.select("node", F.lit(1).alias("level"), "community") if found is None else found
        low = at.groupBy("community").agg(F.min("node").alias("low"))
        at = cut(at.join(low, "community").select("node", F.col("low").alias("community")))
        home = cut(home.join(at.select(F.col("node").alias("community"), F.col("community").alias("up")), "community").select("node", F.col("up").alias("community")))
        part = home.select("node", F.lit(level).alias("level"), "community")
        found = part if found is None else found.unionByName(part)
        edges = cut(coarsen(edges, at))
        size = size.join(at, "node").groupBy(F.col("community").alias("node")).agg(F.sum("size").alias("size"))


def flatten(levels: DataFrame, level: int | None = None) -> DataFrame:
    """node, community at a level; without one, at each node's deepest."""
    if level is not None:
        return levels.filter(F.col("level") == level).select("node", "community")
    return levels.groupBy("node").agg(F.max(F.struct("level", "community")).alias("x")).select("node", "x.community")


def renumbered(partition: DataFrame) -> DataFrame:
    """Communities numbered from 0 in the order of their smallest node.

    They are dealt by ranges of these nodes; the ranges' counts, a row each, give where each range's numbers begin.
    """
    first = partition.groupBy("community").agg(F.min("node").alias("low"))
    dealt = cut(first.repartitionByRange("low").withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    begins = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))  # one row a partition
    number = (F.row_number().over(Window.partitionBy("part").orderBy("low")) - 1 + F.col("begin")).cast("long")
    return partition.join(dealt.join(begins, "part").select("community", number.alias("number")), "community").select("node", F.col("number").alias("community"))


def comembership(partition: DataFrame) -> DataFrame:
    """i, j (i < j) of nodes in one community."""
    a, b = partition.select(F.col("node").alias("i"), "community"), partition.select(F.col("node").alias("j"), "community")
    return a.join(b, "community").filter("i < j").select("i", "j")


def ratio(x: Column, y: Column) -> Column:
    return F.when(y != 0, x / y)
