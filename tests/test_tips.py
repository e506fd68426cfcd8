"""Tips by alignment with what is beside them, against a plain sequential pass."""

import random

import pytest

from readloom.functions import alignment
from readloom.operators import graph

NODES, ARCS = "id long, seq string, n long, kmer_cov long", "src long, dst long, cov long"
K = 5


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_banded_scores_equal_single_alignments():
    rng = random.Random(5)
    pairs = [("", ""), ("A", "C"), ("N", "C"), ("AC", "CA"), ("ACGTACGTAC", "CGTACGTACA")]
    for n in (1, 3, 7, 20, 20, 33):
        a = "".join(rng.choices("ACGTN", k=n))
        pairs += [(a, "".join(rng.choices("ACGT", k=n))), (a, a[1:] + "A"), (a, a)]
    for band in (0, 1, 2, 3):
        assert alignment.banded_scores([a for a, _ in pairs], [b for _, b in pairs], band).tolist() == [alignment.global_score(a, b, band) for a, b in pairs]
    assert len(alignment.banded_scores([], [], 2)) == 0


def made(seed, n=24):
    """Nodes of which many are dead ends at shared places; arcs are there on both strands."""
    rng = random.Random(seed)
    trunk = "".join(rng.choices("ACGT", k=16))
    different = set()  # nodes of one coverage are taken by sequence
    while len(different) < n:
        different.add("".join(c if rng.random() < 0.85 else rng.choice("ACGT") for c in trunk)[rng.randint(0, 8) :])
    seqs = dict(enumerate(rng.sample(sorted(different), n), 1))
    rows = [(i, s, len(s) - K + 1, (len(s) - K + 1) * rng.choice([1, 1, 2, 3, 9])) for i, s in seqs.items()]
    arcs = set()
    for i in range(1, n + 1):
        for _ in range(rng.choice([0, 1, 1, 1, 1, 2])):
            a, b = i * rng.choice([1, 1, -1]), rng.choice([-1, 1]) * rng.randint(1, n // 3)
            if abs(a) != abs(b):
                arcs |= {(a, b), (-b, -a)}
    arcs |= {(7, 7), (-7, -7)} if seed % 2 else set()
    return rows, arcs


def naive(rows, arcs, cutoff, longest):
    info = {i: (s, n, c / n) for i, s, n, c in rows}
    ways = lambda node, arcs: [d for s, d in arcs if s == node]
    low = [i for i, (_, n, avg) in info.items() if avg <= cutoff and n <= longest]
    certain = set()
    for i in low:
        right, left = ways(i, arcs), ways(-i, arcs)
        if len(right) == 1 and len(left) == 1 and (right == [i] or any((d, s) in arcs for s in (i, -i) for d in ways(s, arcs) if abs(d) != i)):
            certain.add(i)
        if not (right and left) and len(right) + len(left) != 1:
            certain.add(i)
    arcs = {a for a in arcs if abs(a[0]) not in certain and abs(a[1]) not in certain}
    gone = set()
    for i in sorted(low, key=lambda i: (info[i][2], info[i][0])):
        out = [(s, d) for s in (i, -i) for d in ways(s, arcs)]
        if i in certain or len(out) != 1:
            continue
        tip, place = out[0]
        for other in [s for s, d in arcs if d == place and s != tip and abs(s) not in gone]:
            x, y = (info[abs(v)][0] if v > 0 else rc(info[abs(v)][0]) for v in (tip, other))
            m = min(len(x), len(y))
            x, y = x[len(x) - m :][: m - K + 1], y[len(y) - m :][: m - K + 1]
            if len(x) < K or alignment.global_score(x, y, 2) > 0:
                gone.add(i)
                break
    return certain | gone


@pytest.mark.parametrize("seed", range(3))
def test_aligned_tips_equal_a_sequential_pass(spark, seed):
    rows, arcs = made(seed)
    nodes, arc = spark.createDataFrame(rows, NODES), spark.createDataFrame([(*a, 1) for a in sorted(arcs)], ARCS)
    wanted = naive(rows, arcs, 2.0, 12)
    assert wanted and {r.id for r in graph.aligned_tips(nodes, arc, K, 2.0, 12).collect()} == wanted


def test_of_two_equal_tips_at_one_place_one_stays(spark):
    rows = [(1, "ACGTTGCAAC", 6, 6), (2, "ACGTAGCAAC", 6, 6), (3, "CAACTTTTGG", 6, 60)]
    arcs = [(1, 3, 1), (-3, -1, 1), (2, 3, 1), (-3, -2, 1)]
    found = graph.aligned_tips(spark.createDataFrame(rows, NODES), spark.createDataFrame(arcs, ARCS), K, 2.0, 12).collect()
    assert [r.id for r in found] == [2]


def test_empty_graph(spark):
    assert graph.aligned_tips(spark.createDataFrame([], NODES), spark.createDataFrame([], ARCS), K, 2.0, 12).count() == 0
