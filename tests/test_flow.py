"""Arcs judged by flow, against plain loops over small random graphs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from readloom.functions import alignment
from readloom.operators import flow

MODEL = dict(mean=[2.0, 3.0, 20.0, 40.0], variance=[2.5, 3.6, 30.0, 70.0], mass=[900.0, 200.0, 3000.0, 150.0], cutoff=5, avg_cov=20.0)
NODES, ARCS = "id long, seq string, n long, kmer_cov long, multiplicity int", "src long, dst long, cov long"


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def made(seed, k=5, n=14):
    """Nodes with arcs of up to four letters a side; an arc and its other strand are both there."""
    rng = random.Random(seed)
    nodes = {i: ("".join(rng.choices("ACGT", k=12 + rng.randint(0, 8)))) for i in range(1, n + 1)}
    rows = [(i, s, len(s) - k + 1, (len(s) - k + 1) * rng.choice([3, 18, 20, 22, 41, 63]), rng.choice([0, 1, 1, 1, 2, 5, None])) for i, s in nodes.items()]
    letter = lambda d: (nodes[d] if d > 0 else rc(nodes[-d]))[k - 1]
    arcs = {}
    for _ in range(4 * n):
        a, b = rng.choice([-1, 1]) * rng.randint(1, n), rng.choice([-1, 1]) * rng.randint(1, n)
        used = lambda s: {letter(d) for x, d in arcs if x == s}
        if a != b and a != -b and letter(b) not in used(a) and letter(-a) not in used(-b):
            arcs[a, b] = arcs[-b, -a] = rng.choice([1, 2, 2, 4, 19, 21, 38])
    return rows, arcs, letter


def observed(x, m):
    part = lambda j, s=1: math.log(MODEL["mass"][j]) + math.log(alignment.negative_binomial(int(x), s * MODEL["mean"][j], s * MODEL["variance"][j]))
    return part(0) + part(1) if m == 0 else part(m + 1) if m <= 2 else part(2, m)


def multiplicity(c):
    return 0 if c < MODEL["cutoff"] else max(1, math.floor(c / MODEL["avg_cov"] + 0.5))


def naive_unlikely(rows, arcs):
    gone = set()
    for i, _, n, total, _ in rows:
        for s in (i, -i):
            out, c = {d: a for (x, d), a in arcs.items() if x == s}, total / n
            m, am = multiplicity(c), {d: multiplicity(a) for d, a in out.items()}
            if len(out) < 2 or not m or 0 not in am.values():
                continue
            stands = observed(c, sum(max(x, 1) for x in am.values())) + sum(observed(out[d], max(x, 1)) for d, x in am.items())
            if observed(c, m) + sum(observed(out[d], x) for d, x in am.items()) - stands >= 5:
                gone |= {(s, d) for d, x in am.items() if not x}
    return gone


def naive_chimeras(rows, arcs, letter, cutoff, longest):
    info = {r[0]: r for r in rows}
    sure = lambda s: info[abs(s)][3] / info[abs(s)][2] >= cutoff and info[abs(s)][2] >= longest and 1 <= (info[abs(s)][4] or 0) <= 4
    found = set()
    for s in (x for i in info for x in (i, -i)):
        out = sorted((d for x, d in arcs if x == s), key=letter)
        m = info[abs(s)][4]
        trusted = next((d for d in out if sure(d) and info[abs(d)][4] == m), None)
        if sure(s) and len(out) >= max(2, m) and trusted:
            weak = [d for d in out if d != trusted and arcs[s, d] < cutoff]
            found |= {(s, weak[0], trusted)} if weak else set()
    return found


def tables(spark, rows, arcs):
    return spark.createDataFrame(rows, NODES), spark.createDataFrame([(*a, c) for a, c in arcs.items()], ARCS)


@pytest.fixture(scope="module")
def model(spark):
    return spark.createDataFrame([MODEL], "mean array<double>, variance array<double>, mass array<double>, cutoff int, avg_cov double")


def without(arcs, gone):
    return {a: c for a, c in arcs.items() if a not in gone and (-a[1], -a[0]) not in gone}


def test_unlikely_arcs_equal_a_plain_loop(spark, model):
    seen = 0
    for seed in range(2):
        rows, arcs, _ = made(seed)
        wanted = naive_unlikely(rows, arcs)
        nodes, arc = tables(spark, rows, arcs)
        assert {(r.src, r.dst) for r in flow.unlikely_arcs(nodes, arc, model).collect()} == wanted
        seen += len(wanted)
    assert seen


def test_likelihood_rounds_end_and_drop_what_nothing_leads_to(spark, model):
    rows, arcs, _ = made(1)
    rows.append((99, "ACGTACGTACGTAA", 10, 20, None))  # an error that only one weak arc leads to
    lonely = rows[0][0]
    arcs |= {(lonely, 99): 1, (-99, -lonely): 1}
    left, alive = dict(arcs), {r[0] for r in rows}
    while gone := naive_unlikely([r for r in rows if r[0] in alive], left):
        left = without(left, gone)
        alive -= {abs(d) for _, d in gone} - {abs(s) for s, _ in left}
    nodes, arc = flow.correct_by_likelihood(*tables(spark, rows, arcs), model)
    assert {(r.src, r.dst): r.cov for r in arc.collect()} == left and {r.id for r in nodes.collect()} == alive


def test_chimeras_equal_a_plain_loop(spark):
    seen = 0
    for seed in range(2):
        rows, arcs, letter = made(seed)
        wanted = naive_chimeras(rows, arcs, letter, 5.0, 9)
        nodes, arc = tables(spark, rows, arcs)
        assert {tuple(r) for r in flow.chimeric_links(nodes, arc, 5.0, 9, 5).collect()} == wanted
        left = dict(arcs)
        while found := naive_chimeras(rows, left, letter, 5.0, 9):
            left = without(left, {f[:2] for f in found})
        assert {(r.src, r.dst): r.cov for r in flow.remove_chimeras(nodes, arc, 5.0, 9, 5).collect()} == left
        seen += len(wanted)
    assert seen


def test_empty_graph_and_empty_fit(spark, model):
    nodes, arc = tables(spark, [], {})
    assert flow.unlikely_arcs(nodes, arc, model).count() == 0 and flow.chimeric_links(nodes, arc, 5.0, 9, 5).count() == 0
    rows, arcs, _ = made(2)
    assert flow.unlikely_arcs(*tables(spark, rows, arcs), model.filter(F.lit(False))).count() == 0
