"""Hard negatives, exact search and periodic runs against brute force, with edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from readloom.llm import exact_search, hard_negatives, integer_vectors, queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ENDS = (-(2**63), 2**63 - 1)


def whole(v, scale):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(scale * x) for x in v]


def product(a, b):
    return min(max(sum(x * y for x, y in zip(a, b, strict=True)), ENDS[0]), ENDS[1])


def brute_negatives(rows, every=100):
    rows = [(i, e, label) for i, v, label in rows if i is not None and label is not None and (e := whole(v, 256)) is not None]
    out = []
    for own, e, label in {(i, tuple(e), label) for i, e, label in rows if i % every == 0}:
        others = [(product(e, f), i, other) for i, f, other in rows if i != own and len(f) == len(e)]
        for p, positive, _ in sorted((x for x in others if x[2] == label), key=lambda x: (-x[0], x[1]))[:5]:
            fit = sorted((x for x in others if x[2] != label and 80 * p <= 100 * x[0] <= 100 * p), key=lambda x: (-x[0], x[1]))[:5]
            out += [(own, positive, k, i, p, s) for k, (s, i, _) in enumerate(fit, 1)]
    return sorted(out)


def brute_search(rows, every=100, k=10):
    rows = [(i, e) for i, v in rows if i is not None and (e := whole(v, 1024)) is not None]
    out = {}
    for own, e in {(i, tuple(e)) for i, e in rows if i % every == 0}:
        out.setdefault(own, []).extend((-product(e, f), i) for i, f in rows if i != own and len(f) == len(e))
    return sorted((q, r, i, -s) for q, found in out.items() for r, (s, i) in enumerate(sorted(found)[:k], 1))


def made(kind, n=700, d=12):
    """Vectors by kind, with labels; 'hot' has one vector in a third of the rows and one label in most."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, d)) * 0.2 + np.eye(d)[np.arange(n) % d] * (0.5 if kind != "plain" else 0)
    label = rng.integers(0, 10, n)
    if kind == "hot":
        x[::3], label[rng.random(n) < 0.6] = x[0], 4
    if kind == "ties":
        x = np.round(x)
    if kind == "wild":
        x[::50] *= 1e12
        x[7::100] *= 1e30
    return [(int(k), [float(np.float32(c)) for c in v], int(g)) for k, v, g in zip(range(n), x, label, strict=True)]


def triples(frame):
    return sorted(tuple(r) for r in frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("kind", ["plain", "hot", "ties", "wild"])
@pytest.mark.parametrize("size", [64, 4096])
def test_hard_negatives_against_brute_force(spark, monkeypatch, kind, size):
    monkeypatch.setattr(hard_negatives, "ROWS", size)
    monkeypatch.setattr(hard_negatives, "ANCHORS", max(2, size // 32))
    rows = made(kind)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert triples(hard_negatives.mine(frame, frame["vec_id"] % 100 == 0)) == brute_negatives(rows)


@pytest.mark.parametrize("kind", ["plain", "hot", "ties", "wild"])
@pytest.mark.parametrize("size", [40, 4096])
def test_exact_search_against_brute_force(spark, monkeypatch, kind, size):
    monkeypatch.setattr(exact_search, "BLOCK", size)
    monkeypatch.setattr(exact_search, "QUERIES", max(2, size // 20))
    monkeypatch.setattr(exact_search, "SUMMARIES", 9 if size < 100 else 4096)
    rows = [(i, v) for i, v, _ in made(kind)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = exact_search.search(frame, frame["vec_id"] % 100 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute_search(rows)


INF, NAN = float("inf"), float("nan")
ODD = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 2), (3, [0.0, 0.0], 2), (4, None, 1), (5, [INF, 1.0], 1), (6, [NAN, 1.0], 1), (7, [None, 1.0], 1), (None, [1.0, 1.0], 1), (8, [1.0], 1), (9, [0.9, 0.0], 2), (200, [], 1), (10, [], 2), (1, [1.0, 0.0], 1), (11, [1.0, 5.0], None), (100, [1.0, 0.0], 1), (300, [-1.0, 0.25], 2), (12, [-0.5, 3e38], 3)]


def test_odd_rows_of_vectors(spark):
    frame = spark.createDataFrame([(*r, 1, 2, 3.0) for r in ODD], "vec_id long, embedding array<float>, label int, block int, deal int, score double")
    known = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    assert triples(hard_negatives.mine(frame, frame["vec_id"] % 100 == 0)) == brute_negatives(known)
    found = exact_search.search(frame, frame["vec_id"] % 100 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute_search([r[:2] for r in known])
    assert hard_negatives.mine(frame.limit(0), frame["vec_id"] % 100 == 0).count() == 0
    assert exact_search.search(frame.limit(0), frame["vec_id"] % 100 == 0).count() == 0


def test_planes_rebuild_integers_and_intervals_drop_rows():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (500, 70)).astype(float)
    planes = hard_negatives.Planes.of(x)
    one = hard_negatives.Planes.of(x[:1])
    total = sum(planes.weight(t) * hard_negatives.with_plane(one, 0, planes.bits[t]) for t in range(planes.top + 1))
    assert (total == x.astype(int) @ x[0].astype(int)).all()
    left, score = hard_negatives.survivors(one, 0, x[0], planes, np.arange(500), [(-np.inf, np.inf)])
    assert len(left) < 30 and set(np.argsort(-total, kind="stable")[:5]) <= set(left.tolist()) and (score == total[left]).all()


def test_bounds_skip_rows_and_blocks():
    """In groups of near vectors a query scores few rows of its block, and its summaries rule other blocks out."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.integers(-500, 500, (20, 16)), 50, axis=0) + rng.integers(-5, 6, (1000, 16)).astype(float)
    pivots = {16: np.vstack([np.zeros(16), x[::50]])}
    away, squares = exact_search.distances(x, pivots), (x * x).sum(axis=1)
    seen = []

    class Counting(np.ndarray):
        def __getitem__(self, at):
            seen.append(len(np.atleast_1d(at)))
            return np.asarray(super().__getitem__(at))

    ids = np.arange(1000)
    found, score = exact_search.best_of_block(x[3], away[3], 3, -np.inf, ids, x.view(Counting), squares, away)
    wanted = sorted(((-s, i) for i, s in enumerate(x @ x[3]) if i != 3))[:10]
    assert list(zip((-score).tolist(), found.tolist(), strict=True)) == wanted and sum(seen) < 1000 / 2


def naive_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        start = 0
        while start < n:
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            end = min(end, n)
            if end - start >= max(6, 4 * q):
                part = words[start:end]
                if not any(all(part[i] == part[i + r] for i in range(len(part) - r)) for r in range(1, q)):
                    found.append((start, end - start, q))
            start = max(start + 1, end - q + 1)
    return sorted(found)


def naive_collapse(words, found):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]


def test_runs_against_brute_force():
    rng = random.Random(11)
    for trial in range(400):
        words = []
        while len(words) < rng.randint(0, 120):
            kind = rng.random()
            if kind < 0.5:
                unit = rng.choices("abc" if kind < 0.25 else "abcdefgh", k=rng.randint(1, 9))
                words += (unit * 9)[: rng.randint(1, 9 * len(unit))]
            else:
                words += rng.choices("ab" if trial % 2 else "abcdef", k=rng.randint(1, 20))
        found = runs.runs_of(words)
        assert found == naive_runs(words), words
        assert runs.collapse(words, found) == naive_collapse(words, found)


def naive_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a, p = g % n, 0
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs.runs_of(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return doc_id, len(found), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(naive_collapse(words, found)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op12_runs(spark, sf_dir).select(*COLUMNS).collect()
    assert sorted(map(tuple, found)) == sorted(naive_row(*r) for r in docs)
    assert sum(r["n_runs"] > 0 for r in found) >= 15


def test_runs_edge_cases(spark, tmp_path):
    long = " ".join(f"w{k % 997}" for k in range(30_000))
    texts = [None, "", " \t\r\n", "a", "a a a a a", "a a a a a a", "x\ta\x0ba\x0ca a a a y", "ün 中文 ün 中文 ün 中文 ün 中文 ün", "a a a a a", long]
    rows = [(k, t, 1, "r") for k, t in enumerate(texts)] + [(3, "b b b b b b b", 1, None), (None, "c c c c c c", None, None), (5, "a a a a a a", 1, "r")]
    rows += [(k, f"p{k} " + " ".join(f"q{j}" for j in range(60)), 2, None) for k in range(100, 160)]  # some of these get a planted tail
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in queries.op12_runs(spark, str(tmp_path)).select(*COLUMNS).collect()]
    wanted = [naive_row(i, t) for i, t, *_ in rows if t != long] + [(9, 1, 0, 30_000, 997, 30_090)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((r if r[0] != 9 else r[:6] for r in found), key=key) == sorted(wanted, key=key)
    assert runs.find_runs(frame.limit(0)).count() == 0
    assert any(r[1] for r in found if r[0] is not None and r[0] >= 100)
    plain = runs.find_runs(frame.filter("doc_id = 6")).first()
    assert [tuple(r) for r in plain["runs"]] == [(1, 6, 1)] and plain["collapsed"] == "x a y"


def test_tame_and_wild_products_agree():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 8))
    a, tame = integer_vectors.floored(x, 256)
    assert tame.all() and (integer_vectors.exact_products(x[0], x, 256) == a @ a[0]).all()
    assert not integer_vectors.floored(np.array([[1e300, 0.0]]), 256)[1][0]
