"""Maximal exact matches and seeds against brute force."""

import random

from readloom.operators import matches

K = 13


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def brute_matches(reads, nodes, least):
    found = set()
    for key, read in reads:
        for i, seq, _ in nodes:
            for node, s in ((i, seq), (-i, rc(seq))):
                for a in range(len(read)):
                    for b in range(len(s)):
                        if read[a] == s[b] and (a == 0 or b == 0 or read[a - 1] != s[b - 1]):
                            n = 0
                            while a + n < len(read) and b + n < len(s) and read[a + n] == s[b + n]:
                                n += 1
                            if n >= least:
                                found.add((key, node, b, a, n))
    return found


def made():
    rng = random.Random(12)
    nodes = [(i, "".join(rng.choices("ACGT", k=rng.randint(K, 60)))) for i in range(1, 9)]
    nodes = [(i, s, len(s) - K + 1) for i, s in nodes]
    reads = []
    for key in range(12):
        i, s, _ = rng.choice(nodes)
        read = list((s if key % 2 else rc(s)) + "".join(rng.choices("ACGT", k=15)))
        for at in range(7, len(read), 17):
            read[at] = "N" if key == 3 else rc(read[at])
        reads.append((key, "".join(read)))
    return reads + [(50, ""), (51, None), (52, "ACG")], nodes


def test_matches_against_brute_force(spark):
    reads, nodes = made()
    frame, table = spark.createDataFrame(reads, "id long, seq string"), spark.createDataFrame(nodes, "id long, seq string, n long").withColumnRenamed("id", "id")
    found = matches.maximal_matches(frame, table, 5, "id").select("id", "node", "node_first", "read_first", "len")
    wanted = brute_matches([r for r in reads if r[1]], nodes, 5)
    assert {tuple(r) for r in found.collect()} == wanted and found.count() == len(wanted) > 30


def test_seeds_against_serial_merging(spark):
    reads, nodes = made()
    frame, table = spark.createDataFrame(reads, "id long, seq string"), spark.createDataFrame(nodes, "id long, seq string, n long")
    info = {i: (s, n) for i, s, n in nodes}
    for enough in (3, 100):
        found = {(r["id"], r["node"], r["node_first"], r["first"], r["end"], r["rank"]) for r in matches.exact_seeds(frame, table, K, "id", least=5, enough=enough, most=4).collect()}
        wanted = set()
        for key, read in reads:
            if not read:
                continue
            every = brute_matches([(key, read)], nodes, 5)
            for least in range(K - 1, 4, -1):  # shrinking until there are enough
                some = [m for m in every if m[4] >= least]
                if len(some) >= enough:
                    break
            seeds = sorted([node, b, a, a + n] for _, node, b, a, n in some if b < info[abs(node)][1] and a < len(read) - K + 1)
            merged = []
            for s, before in zip(seeds, [None, *seeds], strict=False):
                if before and before[0] == s[0] and s[1] - before[1] == s[2] - before[2]:
                    merged[-1][3] = s[3]
                else:
                    merged.append(list(s))
            merged.sort(key=lambda s: (s[2] - s[3], s[2], s[1], info[abs(s[0])][0], -s[0]))
            wanted |= {(key, *s[:3], s[3] - min(K - 1, s[3] - s[2] - 1), rank) for rank, s in enumerate(merged[:4], 1)}
        assert found == wanted and wanted
    assert matches.exact_seeds(frame.limit(0), table, K, "id").count() == 0
