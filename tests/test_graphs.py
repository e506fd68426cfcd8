"""Graphs, clustering, consensus and correction against naive versions on small made-up inputs."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from readloom.operators import chains, community, consensus, correction, graph, stretches
from readloom.operators.iterate import connected_components
from readloom.plans import pipeline


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def made_reads(seed, genome=300, reads=60, length=50, errors=0.0):
    rng = random.Random(seed)
    whole = "".join(rng.choices("ACGT", k=genome))
    out = []
    for _ in range(reads):
        at = rng.randint(0, genome - length)
        read = "".join(rng.choice("ACGT") if rng.random() < errors else c for c in whole[at : at + length])
        out.append(rc(read) if rng.random() < 0.5 else read)
    return whole, out


def naive_unitigs(reads, k):
    count, out, into = Counter(), defaultdict(set), defaultdict(set)
    for r in reads:
        for s in (r, rc(r)):
            for i in range(len(s) - k + 1):
                count[s[i : i + k]] += 1
                if i + k < len(s):
                    out[s[i : i + k]].add(s[i + 1 : i + k + 1])
                    into[s[i + 1 : i + k + 1]].add(s[i : i + k])

    def after(x):
        if len(out[x]) == 1:
            (y,) = out[x]
            if len(into[y]) == 1 and y not in (x, rc(x)):
                return y

    linked = {y for x in list(count) if (y := after(x))}
    found, used = [], set()
    # starts of paths, then cycles from their largest k-mer, those that are smaller than their other strand being the larger ones
    for x in sorted(count, key=lambda x: (x not in linked, x <= rc(x), x if x <= rc(x) else rc(x).translate(str.maketrans("ACGT", "TGCA"))), reverse=True):
        if x in used:
            continue
        path = [x]
        used.add(x)
        while (y := after(path[-1])) and y not in used:
            path.append(y)
            used.add(y)
        seq = path[0] + "".join(p[-1] for p in path[1:])
        if seq <= rc(seq):
            found.append((seq, sum(count[p] for p in path)))
    return sorted(found)


@pytest.mark.parametrize(("seed", "errors"), [(1, 0.0), (2, 0.02)])
def test_unitigs_against_walks(spark, seed, errors):
    _, reads = made_reads(seed, errors=errors)
    frame = spark.createDataFrame([(r,) for r in reads], "seq string")
    nodes = graph.unitigs(frame, 11)
    assert sorted((r["seq"], r["kmer_cov"]) for r in nodes.collect()) == naive_unitigs(reads, 11)


def test_a_cycle_is_one_node(spark):
    ring = "ACGGTTCAGA"
    frame = spark.createDataFrame([((ring * 3)[:25],)], "seq string")
    found = graph.unitigs(frame, 5).collect()
    assert len(found) == 1 and len(found[0]["seq"]) == len(ring) + 4


@pytest.mark.parametrize("k", [11, 5])
def test_stretches_give_the_graph_of_single_kmers(spark, monkeypatch, k):
    """Rings, hairpins, other letters, nulls and both strands; the walk over the graph sees stretches, not k-mers."""
    rng = random.Random(3)
    reads = ["A" * 15, "AC" * 12, "", None, "ACGNNACGTACGTTGCANACGATTCGAGTCA", "\u00e9ACGATTCAGATCAGAT", "AACCGGTT" * 3]
    for _ in range(6):
        ring = "".join(rng.choices("ACGT", k=rng.randint(20, 60)))
        reads += [(ring * 4)[i : i + rng.randint(12, 40)] for i in range(0, len(ring) + 20, rng.randint(3, 9))] + made_reads(rng.random(), 150, 12, 40)[1]
    frame = spark.createDataFrame([(r if r is None or rng.random() < 0.5 else rc(r),) for r in reads], "seq string")
    count = frame.transform(lambda d: graph.explode_kmers(d, k)).groupBy(graph.canonical(F.col("kmer")).alias("seq")).agg(F.count("*").alias("kmer_cov"))
    single = count.select(graph.kmer_code(F.col("seq"), k).alias("id"), "seq", F.lit(1).cast("long").alias("n"), "kmer_cov")
    coded = graph.arcs(frame, k).select(graph.kmer_code(F.col("src"), k).alias("src"), graph.kmer_code(F.col("dst"), k).alias("dst"), "cov")
    walked, walk = [], graph._walk
    monkeypatch.setattr(graph, "_walk", lambda nodes, links: walked.append(nodes.count()) or walk(nodes, links))
    found, wanted = graph.build(frame, k), graph.concatenate(single, coded, k)
    for mine, other in zip(found, wanted, strict=True):
        assert sorted(map(str, mine.collect())) == sorted(map(str, other.select(mine.columns).collect()))
    assert k == 5 or walked[0] < single.count()


def test_places_count_letters(spark):
    frame = spark.createDataFrame([(1, "\u00e9ACGTN"), (2, None), (3, "TTTNACG")], "id long, seq string")
    found = stretches.placed_codes(frame, 3, "id").collect()
    assert sorted(map(tuple, found)) == [(1, 1, 7), (1, 2, -7), (3, 0, -1), (3, 4, 7)]


def test_cleaning_removes_errors_and_keeps_the_genome(spark):
    """Tips of single errors at read ends and bubbles of errors inside go; what is left is the genome."""
    rng = random.Random(8)
    genome = "".join(rng.choices("ACGT", k=400))
    reads = [genome[i : i + 60] for i in range(0, 341, 4) for _ in range(2)]
    flip = {"A": "C", "C": "G", "G": "T", "T": "A"}
    for start, at in ((40, 30), (180, 25), (290, 58)):  # two bubbles and a tip
        r = genome[start : start + 60]
        reads.append(r[:at] + flip[r[at]] + r[at + 1 :])
    frame = spark.createDataFrame([(r,) for r in reads], "seq string")
    nodes, arc = graph.build(frame, 15)
    assert nodes.count() > 3
    nodes, arc = graph.clean(nodes, arc, 15, 2.0, 30)
    assert [r["seq"] for r in nodes.collect()] in ([genome], [rc(genome)]) and arc.count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)]
    top = list(range(61))

    def root(x):
        return x if top[x] == x else root(top[x])

    for a, b in edges:
        top[max(root(a), root(b))] = min(root(a), root(b))
    nodes = spark.range(61).withColumnRenamed("id", "node")
    found = connected_components(nodes, spark.createDataFrame(edges, "src long, dst long"))
    assert {r["node"]: r["component"] for r in found.collect()} == {x: root(x) for x in range(61)}


def cliques(n, size):
    edges = [(c * size + i, c * size + j, 1.0) for c in range(n) for i in range(size) for j in range(i)]
    return edges + [(c * size, ((c + 1) % n) * size, 1.0) for c in range(n)]


@pytest.mark.parametrize("name", ["modularity", "balmod", "devind", "owzad"])
def test_louvain_finds_cliques(spark, name):
    edges = spark.createDataFrame(cliques(6, 6), "src long, dst long, w double")
    found = community.flatten(community.louvain(edges, name))
    groups = defaultdict(set)
    for r in found.collect():
        groups[r["community"]].add(r["node"])
    assert sorted(map(sorted, groups.values())) == [list(range(c * 6, c * 6 + 6)) for c in range(6)]
    again = community.flatten(community.louvain(edges, name))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect()))


def test_rounds_of_joins_find_cliques_too(spark):
    edges = community.merge_edges(spark.createDataFrame(cliques(4, 6), "src long, dst long, w double"))
    found = community.flatten(community.louvain(edges, largest=1))
    assert community.quality(edges, found, "modularity").first()["quality"] > 0.5


def test_stable_core(spark):
    rows = [(a, b, 5) for a in range(12) for b in range(a + 1, 12)] + [(20, 21, 5)]
    nodes = spark.range(24).withColumnRenamed("id", "node")
    found = {r["node"]: r["cluster_id"] for r in consensus.stable_core(nodes, spark.createDataFrame(rows, "i long, j long, weight long"), 12.0, 5).collect()}
    assert {found[k] for k in range(12)} == {1} and len(found) == 24
    assert len({found[k] for k in range(12, 24)}) == 12


def test_coclustering_counts_classes_and_shuffles_no_pairs(spark, monkeypatch):
    rng = random.Random(11)
    # few communities, so classes of many nodes, which lie in several blocks; one run lacks nodes, one has a null
    rows = [(run, node, rng.randrange(3)) for run in range(3) for node in range(90) if run < 2 or node % 4] + [(3, node, node) for node in range(5)] + [(4, 1, None), (4, 2, None)]
    frame = spark.createDataFrame(rows, "run int, node long, community long")
    wanted = Counter((a, b) for r, a, c in rows for s, b, d in rows if r == s and c is not None and c == d and a < b)
    for block in (256, 2):
        monkeypatch.setattr(consensus, "BLOCK", block)
        found = consensus.coclustering(frame)
        assert Counter({(r["i"], r["j"]): r["weight"] for r in found.collect()}) == wanted and found.count() == len(wanted)
        grouped = found._jdf.queryExecution().optimizedPlan().toString().split("Generate explode(nodes_b")[0]
        assert "Aggregate" not in grouped
    assert consensus.coclustering(frame.limit(0)).count() == 0


def test_size_bounds_grow():
    bounds = consensus.size_bounds(30, 20)
    assert bounds[0] == (19, 40) and len(bounds) == 20
    assert all(a[1] <= b[1] and a[0] >= b[0] for a, b in zip(bounds, bounds[1:]))


def test_labels_and_statistics(spark):
    rows = [(k, 1) for k in range(10)] + [(100 + k, 2) for k in range(9)] + [(1000 + k, 3) for k in range(300)]
    found = consensus.accepted_clusters(spark.createDataFrame(rows, "pair_id long, cluster_id long"))
    assert Counter(r["cluster_id"] for r in found.collect()) == {1: 10, 0: 309}
    assert tuple(consensus.cluster_statistics(found).first()) == (1, 10.0, 10.0)
    assert tuple(consensus.cluster_statistics(found.filter("cluster_id = 0")).first()) == (0, None, None)


def test_contexts_and_back_off(spark):
    rows = spark.createDataFrame([(k, [1, 2, 3]) for k in range(30)] + [(99, [1, 2, 4])], "id long, chain array<int>")
    found = chains.contexts(rows, 3)
    counts = {(tuple(r["context"]), r["next"]): r["freq"] for r in found.collect()}
    assert counts[(1, 2), 3] == 30 and counts[(2,), 4] == 1 and counts[(-3, -2), -1] == 30
    decided = chains.decided(found.selectExpr("*", "20.0D AS expected"))
    gone = {(tuple(r["context"]), r["next"]) for r in decided.filter("not accepted").collect()}
    assert ((1, 2), 4) in gone and ((1, 2), 3) not in gone
    ends = spark.createDataFrame([(1, [1, 2]), (2, [7, 2]), (3, [8])], "id long, chain array<int>")
    assert {r["id"]: list(r["next"]) for r in chains.allowed_next(ends, decided).collect()} == {1: [3], 2: [3]}


def test_correction_mends_errors():
    whole, reads = made_reads(9, genome=200, reads=120, length=80, errors=0.01)
    found = correction.correct_reads(reads, 15, 3.0)
    assert all(len(f[0]) == len(r) for f, r in zip(found, reads, strict=True))
    right = lambda s: s in whole or s in rc(whole)
    before, after = sum(map(right, reads)), sum(right(f[0]) for f in found)
    assert after > before and after >= 0.9 * len(reads)
    assert correction.correct_reads(["ACG", ""], 15, 1.0) == [("ACG", False, 0), ("", False, 0)]


def test_pipeline_keeps_every_read(spark):
    rng = random.Random(8)
    rows, pair = [], 0
    for place in range(2):
        whole = "".join(rng.choices("ACGT", k=60)) + "A" * 9 + "".join(rng.choices("CGT", k=120))
        for _ in range(30):
            at = rng.randint(0, 12)
            rows.append((pair, whole[at : at + 90], rc(whole[90:])[:90]))
            pair += 1
    rows += [(pair + k, "".join(rng.choices("CGT", k=90)), "".join(rng.choices("CGT", k=90))) for k in range(5)]
    frame = spark.createDataFrame(rows, "pair_id long, seq1 string, seq2 string")
    # thirty pairs of each place: at this coverage the window holds k-mers seen 16 to 49 times
    config = pipeline.Config(pattern="AAAAAAAAA", coverage=250.0, k=21, read_length=90, runs=3)
    low = frame.filter("pair_id < 60")
    linked = pipeline.candidates(pipeline.reads_of(low), config)
    assert linked.count() > 100 and linked.filter("a < 30 and b >= 30").count() == 0
    found = pipeline.run(frame, config).collect()
    assert sorted((r["pair_id"], r["mate"]) for r in found) == sorted((p, m) for p, *_ in rows for m in (1, 2))
    assert all(len(r["seq"]) == 90 for r in found)


def test_multiplicity_by_score(spark):
    rows = [(1, 100, 50), (2, 100, 100), (3, 100, 155), (4, 10, 40), (5, 1000, 0)]
    found = {r["id"]: r["multiplicity"] for r in graph.multiplicity_by_score(spark.createDataFrame(rows, "id long, n long, read_start_cov long"), 0.5).collect()}

    def naive(n, starts):
        best, z, times = 0, 3.5, 0
        for m in range(1, 11):
            score = abs(starts - m * 0.5 * n) / (m * 0.5 * n) ** 0.5
            if score < z:
                best, z, times = m, score, times + 1
        return best if times == 1 and z < 3 else 0

    assert found == {i: naive(n, s) for i, n, s in rows} and found[1] == 1


def test_single_survivors_settle_longer_contexts(spark):
    rows = [(1, [1], 2, True), (1, [1], 3, False), (1, [4], 2, True), (1, [4], 5, True), (2, [7, 1], 2, True), (2, [7, 1], 3, True), (2, [7, 4], 2, True), (3, [1, 7, 4], 5, True)]
    found = chains.propagated(spark.createDataFrame(rows, "order int, context array<int>, next int, accepted boolean")).collect()
    # [7, 1] ends with [1], which has one next node left; [7, 4] has one itself and settles [1, 7, 4]
    assert sorted((r["context"], r["next"]) for r in found) == [([1], 2), ([1], 3), ([4], 2), ([4], 5), ([7, 4], 2)]


def test_contexts_are_not_broadcast(spark):
    rows = spark.createDataFrame([(k, [k % 7, k % 5, 8, k % 3]) for k in range(60)], "id long, chain array<int>")
    lengths = spark.createDataFrame([(n, 2) for n in range(9)], "node int, n long")
    decided = chains.decided(chains.context_lengths(chains.contexts(rows, 3), lengths, 31).withColumn("expected", F.lit(6.0)))
    for found in (chains.propagated(decided), chains.allowed_next(rows, decided.select("order", "context", "next", "accepted").localCheckpoint())):
        assert found.collect()
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_positions_of_the_other_strand(spark):
    frame = spark.createDataFrame([(0, 5, 2, 10, 3)], "pos int, node long, node_pos int, node_n long, last int")
    assert tuple(graph.reversed_positions(frame, "last").first())[:3] == (3, -5, 7)


def test_louvain_by_profile_keeps_cliques(spark):
    edges = community.merge_edges(spark.createDataFrame(cliques(6, 6), "src long, dst long, w double"))
    found = community.flatten(community.louvain(edges, "profile"))
    assert found.select("community").distinct().count() in (6, 7)


def test_louvain_keeps_nodes_of_negative_edges(spark):
    edges = spark.createDataFrame([(1, 1, 9.0), (1, 2, 1.0), (3, 4, 5.0)], "src long, dst long, w double")
    for largest in (0, 100):
        found = community.louvain(edges, "condorcet", largest=largest).filter("level = 1")
        assert sorted(r["node"] for r in found.collect()) == [1, 2, 3, 4]


@pytest.fixture(scope="module")
def knots(spark):
    """Groups of nodes that are tied more closely inside, with weights, loops and two components."""
    rng = random.Random(8)
    edges = [(0, 0, 2.0), (41, 41, 1.0)]
    for a in range(48):
        for b in range(a):
            if (a < 40) == (b < 40) and rng.random() < (0.7 if a // 8 == b // 8 else 0.06):
                edges.append((a, b, float(rng.randint(1, 4))))
    return spark.createDataFrame(edges, "src long, dst long, w double").cache()


def test_gains_of_joins_are_those_of_single_moves(spark):
    """For every quality: worth with a node less worth without it ranks communities as the gain of a single move does."""
    rng = random.Random(3)
    g = {"n": 30.0, "m2": 400.0, "top": 6.0}
    rows = [(float(rng.randint(0, 40)), float(rng.randint(40, 90)), float(rng.randint(1, 9)), float(rng.randint(0, 9)), float(rng.randint(9, 30)), float(rng.randint(0, 5)), float(rng.randint(1, 3))) for _ in range(40)]
    frame = spark.createDataFrame(rows, "inside double, total double, size double, link double, deg double, loop double, wu double")
    c = F.col
    for name in community.QUALITIES:
        worth = lambda i, t, s: community._worth(name, i, t, s, g, 0.5)  # noqa: B023, E731
        gain = worth(c("inside") + 2 * c("link") + c("loop"), c("total") + c("deg"), c("size") + c("wu")) - worth(c("inside"), c("total"), c("size")) - worth(c("loop"), c("deg"), c("wu"))
        for r in frame.withColumn("gain", gain).collect():
            single = lambda i, t, s: community._gain(name, 0.0 if s == 0 else r["link"], r["deg"], r["loop"], r["wu"], i, t, s, g, 0.5)  # noqa: B023, E731
            assert abs(r["gain"] - (single(r["inside"], r["total"], r["size"]) - single(0.0, 0.0, 0.0))) < 1e-9, name


@pytest.mark.parametrize("name", ["condorcet", "shimalik"])
def test_louvain_by_joins_is_as_good_as_node_by_node(spark, knots, name):
    merged = community.merge_edges(knots)
    nodes = {r["node"] for r in merged.selectExpr("explode(array(src, dst)) AS node").collect()}
    value = lambda part: community.quality(merged, part, name).first()["quality"]
    ends = {}
    for largest in (0, 10**9):
        levels = community.louvain(knots, name, largest=largest).cache()
        seen = defaultdict(dict)
        for r in levels.collect():
            assert r["node"] not in seen[r["level"]]
            seen[r["level"]][r["node"]] = r["community"]
        for part in seen.values():
            groups = defaultdict(set)
            for node, c in part.items():
                groups[c].add(node)
            assert all(c == min(g) for c, g in groups.items())
        assert set(seen[1]) == nodes
        ends[largest] = value(community.flatten(levels))
        if largest == 0:
            values = [value(levels.filter(f"level = {k}").select("node", "community")) for k in sorted(seen)]
            assert all(b >= a - 1e-9 for a, b in zip(values, values[1:], strict=False)) and set(map(len, seen.values())) == {len(nodes)}
    alone = value(spark.createDataFrame([(v, v) for v in nodes], "node long, community long"))
    assert ends[0] >= ends[10**9] - 0.05 * abs(ends[10**9] - alone) and ends[0] >= alone - 1e-9


def test_leaves_join_their_hubs_in_one_round(spark, monkeypatch):
    edges = [(hub, 100 + 40 * hub + leaf, 2.0) for hub in range(5) for leaf in range(40)] + [(hub, (hub + 1) % 5, 1.0) for hub in range(5)]
    rounds, moves = [], community._moves
    monkeypatch.setattr(community, "_moves", lambda *a: rounds.append(1) or moves(*a))
    found = community.flatten(community.louvain(spark.createDataFrame(edges, "src long, dst long, w double"), largest=0))
    assert {r["node"]: r["community"] for r in found.collect()} == {v: hub for hub in range(5) for v in (hub, *range(100 + 40 * hub, 140 + 40 * hub))}
    assert len(rounds) <= 3  # all leaves move, none is left to, and so it is for the hubs


def test_communities_are_numbered_by_their_smallest_node(spark):
    part = spark.createDataFrame([(n, 100 - n // 3) for n in range(50)], "node long, community long").repartition(7)
    assert {r["node"]: r["community"] for r in community.renumbered(part).collect()} == {n: n // 3 for n in range(50)}


def test_trimmed_moments_against_a_sorted_list(spark):
    rng = random.Random(4)
    for n in (0, 1, 3, 4, 57, 200):
        values = [rng.choice([rng.randint(90, 110), rng.randint(0, 500)]) for _ in range(n)]
        found = chains.trimmed_moments(spark.createDataFrame([(v,) for v in [*values, None]], "size int"), "size").first()
        half = sorted(values)[n // 4 : n - n // 4]
        if not half:
            assert tuple(found) == (0, None, None)
            continue
        mean = int(sum(half) / len(half) + 0.5)
        assert tuple(found) == (len(half), mean, int((sum((v - mean) ** 2 for v in half) / len(half)) ** 0.5 + 0.5))


def test_insert_sizes_and_paired_chains(spark):
    # mates on both strands of node 7, which holds 30 k-mers, and a pair on different nodes
    rows = [(1, 1, 7, 2, 30), (1, 1, 7, 3, 30), (1, 2, -7, 9, 30), (2, 1, 7, 0, 30), (2, 2, 8, 0, 5), (3, 1, -8, 4, 5), (3, 2, -8, 1, 5)]
    found = chains.insert_sizes(spark.createDataFrame(rows, "pair_id long, mate int, node long, node_pos int, node_n long"), 11)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 7, 20 - 2 + 11), (3, 8, 3 + 11)]
    pairs = spark.createDataFrame([([1, 2], [3, 4]), ([-2, -1], [-4, -3]), ([-2, -1], [-4, -3]), ([5], [-5])], "chain1 array<int>, chain2 array<int>")
    counted = {(tuple(r["chain1"]), r["turned1"], tuple(r["chain2"]), r["turned2"]): r["n"] for r in chains.paired_counts(pairs).collect()}
    assert counted == {((-2, -1), True, (-4, -3), False): 1, ((-2, -1), False, (-4, -3), True): 2, ((-5,), True, (-5,), True): 1}


@pytest.mark.parametrize("name", ["modularity", "condorcet", "goldberg"])
def test_louvain_and_quality_of_runs_together_are_those_of_each_run(spark, name):
    draw = random.Random(4)
    rows = [(r, a * 10 + draw.randrange(6), a * 10 + draw.randrange(6), draw.random() + 0.5) for r in range(3) for a in range(4 + r) for _ in range(12)]
    rows = sorted({(r, min(a, b), max(a, b)): (r, min(a, b), max(a, b), w) for r, a, b, w in rows if a != b}.values())
    every = spark.createDataFrame(rows, "run int, src long, dst long, w double")
    keyed = every.select(*[community.keyed(F.col(c), F.col("run"), 3).alias(c) for c in ("src", "dst")], "w")
    together = community.flatten(community.louvain(keyed, name, 7, runs=3)).cache()
    values = {r["run"]: r["quality"] for r in community.quality(keyed, together, name, runs=3).collect()}
    parted = {(r["run"], r["node"], r["community"]) for r in community.unkeyed(together, 3, "node", "community").collect()}
    for run in range(3):
        network = every.filter(F.col("run") == run).drop("run")
        alone = community.flatten(community.louvain(network, name, 7 + run)).cache()
        assert {(r["node"], r["community"]) for r in alone.collect()} == {(n, c) for r, n, c in parted if r == run}
        assert values[run] == pytest.approx(community.quality(network, alone, name).first()["quality"])


def test_stable_core_is_that_of_rounds_one_by_one(spark):
    draw, runs, size = random.Random(11), 6, 12.0
    n = 150
    weights = {}
    for _ in range(260):
        a, b = draw.randrange(n - 20), draw.randrange(n - 20)
        if a != b and a // 26 == b // 26:
            weights[min(a, b), max(a, b)] = draw.randint(1, runs)
    visited, kept = {}, {}
    for t, (least, largest) in enumerate(consensus.size_bounds(size, runs)):
        parts = {v: {v} for v in range(n)}
        for (a, b), w in weights.items():
            if w > t and parts[a] is not parts[b]:
                parts[a] |= parts[b]
                for v in parts[b]:
                    parts[v] = parts[a]
        for part in {min(p): p for p in parts.values()}.values():
            if not part & visited.keys() and (t == runs - 1 or len(part) <= largest):
                visited |= dict.fromkeys(part, t)
                kept |= dict.fromkeys(part, (t, min(part))) if len(part) >= least else {}
        if n - len(visited) < least:
            break
    keys = {v: kept.get(v, (runs, v)) for v in range(n)}
    number = {key: i + 1 for i, key in enumerate(sorted(set(keys.values())))}
    rows = [(a, b, w) for (a, b), w in weights.items()]
    found = consensus.stable_core(spark.range(n).withColumnRenamed("id", "node"), spark.createDataFrame(rows, "i long, j long, weight long"), size, runs)
    assert {r["node"]: r["cluster_id"] for r in found.collect()} == {v: number[key] for v, key in keys.items()}


def test_ladder_is_clustered_in_one_go(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(community, "louvain", lambda *a, found=community.louvain, **b: calls.append(1) or found(*a, **b))
    edges = spark.createDataFrame([(a, b, 50.0) for a in range(12) for b in range(a)], "src long, dst long, sim double")
    pairs = spark.range(12).withColumnRenamed("id", "pair_id")
    pipeline.clusters(pairs, edges, pipeline.Config(coverage=30.0, least_quality=-1.0))
    assert len(calls) == 1


def test_a_component_of_thousands_of_edges_is_solved_in_a_task_of_its_own(spark, monkeypatch):
    rng = random.Random(4)
    tied = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(14_000)) if a != b and (a % 5 == b % 5 or rng.random() < 0.3)}
    rows = [(a, b, 1.0 + (a % 5 == b % 5)) for a, b in sorted(tied)] + [(1000 + a, 1000 + b, w) for a, b, w in cliques(3, 5)]
    assert len(tied) > 4_096
    edges = spark.createDataFrame(rows, "src long, dst long, w double")
    monkeypatch.setattr(community, "joined_louvain", lambda *_: pytest.fail("rounds of joins over an edge table that fits a task"))
    found = {r["node"]: r["community"] for r in community.flatten(community.louvain(edges)).collect()}
    assert len(found) == len({v for a, b, _ in rows for v in (a, b)})
    monkeypatch.setattr(community, "DEALT", 20)  # both components are beyond it
    assert {r["node"]: r["community"] for r in community.flatten(community.louvain(edges)).collect()} == found
    assert all((v < 1000) == (c < 1000) and found[c] == c for v, c in found.items())


@pytest.fixture(scope="module")
def walks(spark):
    rng = random.Random(11)
    rows = [(k, [rng.choice((-1, 1)) * rng.randint(1, 5) for _ in range(rng.randint(0, 7))]) for k in range(300)]
    return spark.createDataFrame(rows, "id long, chain array<int>"), spark.createDataFrame([(n, 3 * n) for n in range(1, 6)], "node int, n long")


def test_contexts_are_shuffled_once_with_their_lengths(spark, walks):
    rows, lengths = walks
    sized = chains.measured(rows, lengths).localCheckpoint()  # its own plan is not looked at
    found = chains.contexts_by_last(sized, 4, 31)
    names = ["order", "context", "next", "freq", "length"]
    wanted = chains.context_lengths(chains.contexts(rows, 4), lengths, 31)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(map(tuple, wanted.select(*names).collect()))
    left = chains.propagated(found.withColumn("accepted", F.col("freq") > 2))
    assert left.collect() and left._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_longest_known_ends_decide_and_are_joined_last(spark, walks):
    rows, _ = walks
    decided = chains.contexts(rows).withColumn("accepted", F.col("freq") > 2).select("order", "context", "next", "accepted")
    follow, wanted = defaultdict(set), {}
    for r in decided.filter("accepted").collect():
        follow[tuple(r["context"])].add(r["next"])
    for r in rows.collect():
        if known := [tuple(r["chain"][-n:]) for n in range(len(r["chain"]), 0, -1) if tuple(r["chain"][-n:]) in follow]:
            wanted[r["id"]] = sorted(follow[known[0]])
    found = chains.allowed_next(rows, decided)
    assert {r["id"]: r["next"] for r in found.collect()} == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert "Project" in plan and "Aggregate" not in plan  # what may follow is not grouped by chain
