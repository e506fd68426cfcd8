"""Hierarchical navigable small-world graphs over one shard's vectors, as flat neighbour arrays.

A shard is small, so a layer's candidate neighbours are its exact nearest ones, found by blocks of products. Of these a
node keeps the ones that are nearer to it than to any neighbour kept before, which leaves edges in all directions, and
gets edges back from the nodes that chose it while there is room. Every layer holds a sixteenth of the one below.

Searches run for many queries in step: down the upper layers greedily, then with a beam over the lowest. The beam also
starts from one node of each connected part of the lowest layer, so no part is out of reach; where a shard has more parts
than ``PARTS``, or hardly more rows than a beam, it is marked as flat and scanned.

Graphs are built in single precision after every shard, and every query, was divided by a power of two near its largest
component; that keeps the order of the products whatever the magnitude of the vectors.
"""

from __future__ import annotations

import io

import numpy as np

DEGREE, FILL, CANDIDATES, BEAM, FAN, THINNING, PARTS = 16, 10, 64, 192, 6, 16, 48


def _nearest(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row by inner product, nearest first."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, max(k, 0)), np.int32)
    for a in range(0, n, 512):
        sims = x[a : a + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -np.inf
        top = np.argpartition(-sims, min(k, n - 1) - 1, axis=1)[:, :k] if k else np.empty((len(sims), 0), int)
        order = np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable")
        out[a : a + 512] = np.take_along_axis(top, order, 1)
    return out


def _diverse(x: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` of the candidates of each row, none nearer to an earlier choice than to the row; if these are fewer
    than ``FILL``, the nearest others; -1 for empty places."""
    out = np.full((len(x), degree), -1, np.int32)
    for a in range(0, len(x), 1024):
        rows = slice(a, a + 1024)
        size = len(near[rows])
        own, kept, count = x[rows], np.zeros((size, degree, x.shape[1]), np.float32), np.zeros(size, int)
        for t in range(near.shape[1]):
            c = x[near[rows, t]]
            to_own = np.einsum("nd,nd->n", c, own)
            to_kept = np.einsum("nmd,nd->nm", kept, c)
            to_kept[np.arange(degree)[None, :] >= count[:, None]] = -np.inf
            ok = np.flatnonzero((count < degree) & (to_kept.max(axis=1) < to_own))
            out[a + ok, count[ok]] = near[a + ok, t]
            kept[ok, count[ok]] = c[ok]
            count[ok] += 1
        for t in range(near.shape[1]):  # nodes with few directions, as on a line, also keep their nearest
            ahead = np.einsum("nd,nd->n", x[near[rows, t]], own) > 0
            few = np.flatnonzero((count < FILL) & ahead & ~(out[rows] == near[rows, t][:, None]).any(axis=1))
            out[a + few, count[few]] = near[a + few, t]
            count[few] += 1
    return out


def _with_reverse(x: np.ndarray, chosen: np.ndarray, room: int) -> np.ndarray:
    """Append the reverse edges that fit into ``room`` places, the nearest first."""
    n, degree = chosen.shape
    out = np.full((n, room), -1, np.int32)
    out[:, :degree] = chosen
    # choices stand first in a row
    src, slot = np.nonzero(chosen >= 0)
    dst = chosen[src, slot]
    order = np.lexsort((src, -np.einsum("nd,nd->n", x[src], x[dst]), dst))
    src, dst = src[order].astype(np.int32), dst[order]
    fresh = ~(chosen[dst] == src[:, None]).any(axis=1)
    src, dst = src[fresh], dst[fresh]
    rank = np.arange(len(dst)) - np.searchsorted(dst, dst)
    place = (chosen >= 0).sum(axis=1)[dst] + rank
    fits = place < room
    out[dst[fits], place[fits]] = src[fits]
    return out


def scaled(rows: np.ndarray, axis: int | None) -> np.ndarray:
    """Rows in single precision over a power of two: one for all (axis None), or one for each row (axis 1)."""
    top = np.abs(rows).max(axis=axis, keepdims=True) if rows.size else np.ones((1, 1))
    power = np.frexp(np.where(top > 0, top, 1.0))[1]
    return np.ldexp(rows, -power).astype(np.float32)


def parts_of(neighbours: np.ndarray) -> np.ndarray:
    """One node of each connected part, edges taken in both directions: smallest labels, with jumps, until nothing moves."""
    n = len(neighbours)
    label = np.arange(n)
    src, slot = np.nonzero(neighbours >= 0)
    dst = neighbours[src, slot]
    while True:
        before = label.copy()
        np.minimum.at(label, dst, label[src])
        np.minimum.at(label, src, label[dst])
        label = label[label]
        if (label == before).all():
            return np.unique(label)


def build(vectors: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """Index of distinct rows: per layer the member rows and a (members, places) neighbour array of member positions."""
    x = scaled(vectors, None)
    order = np.random.default_rng(seed).permutation(len(x))
    index: dict[str, np.ndarray] = {"vectors": x}
    if len(x) <= 2 * BEAM:
        return index | {"parts": np.zeros(0, np.int32)}
    members, layer = np.arange(len(x)), 0
    while True:
        part = x[members]
        near = _nearest(part, CANDIDATES)
        index[f"members{layer}"] = members.astype(np.int32)
        index[f"neighbours{layer}"] = _with_reverse(part, _diverse(part, near, DEGREE), 2 * DEGREE)
        if layer == 0:
            parts = parts_of(index["neighbours0"])
            index["parts"] = (parts if len(parts) <= PARTS else parts[:0]).astype(np.int32)
            if len(parts) > PARTS:
                return index
        if len(members) <= 2 * THINNING:
            return index
        members = np.sort(order[: max(1, len(members) // THINNING)])
        layer += 1


def search(index: dict[str, np.ndarray], queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Rows found for each query; -1 where fewer are found. All rows of a shard that is flat."""
    x, layer = index["vectors"], 0
    q = scaled(queries, 1)
    if not len(index["parts"]):
        return _scan(x, q, beam)
    while f"members{layer + 1}" in index:
        layer += 1
    top = index[f"members{layer}"]
    found = top[(q @ x[top].T).argmax(axis=1)]
    while layer > 1:
        layer -= 1
        found = _greedy(index, layer, q, found)
    return _beam(x, index["neighbours0"], q, found, index["parts"], beam)


def _scan(x: np.ndarray, q: np.ndarray, beam: int) -> np.ndarray:
    """The ``beam`` nearest of all rows, or all rows."""
    if len(x) <= beam:
        return np.repeat(np.arange(len(x), dtype=np.int32)[None, :], len(q), axis=0)
    return np.argpartition(-(q @ x.T), beam - 1, axis=1)[:, :beam].astype(np.int32)


def _greedy(index: dict[str, np.ndarray], layer: int, q: np.ndarray, found: np.ndarray) -> np.ndarray:
    x, members, neighbours = index["vectors"], index[f"members{layer}"], index[f"neighbours{layer}"]
    at = np.searchsorted(members, found)
    best = np.einsum("qd,qd->q", q, x[found])
    while True:
        near = neighbours[at]
        sims = np.einsum("qmd,qd->qm", x[members[near]], q)
        sims[near < 0] = -np.inf
        pick = sims.argmax(axis=1)
        value = sims[np.arange(len(q)), pick]
        better = value > best
        if not better.any():
            return members[at]
        at = np.where(better, near[np.arange(len(q)), pick], at)
        best = np.where(better, value, best)


def _beam(x: np.ndarray, neighbours: np.ndarray, q: np.ndarray, start: np.ndarray, parts: np.ndarray, beam: int) -> np.ndarray:
    rows = np.arange(len(q))
    node = np.full((len(q), beam), -1, np.int32)
    sims = np.full((len(q), beam), -np.inf, np.float32)
    fresh = np.zeros((len(q), beam), bool)
    seen = np.zeros((len(q), len(x)), bool)
    node[:, 0], sims[:, 0], fresh[:, 0] = start, np.einsum("qd,qd->q", q, x[start]), True
    seen[rows, start] = True
    for k, part in enumerate(parts.tolist(), 1):
        new = start != part
        node[new, k], sims[new, k], fresh[new, k] = part, q[new] @ x[part], True
        seen[:, part] = True
    live = rows
    while len(live):
        open_sims = np.where(fresh[live], sims[live], -np.inf)
        pick = np.argpartition(-open_sims, FAN - 1, axis=1)[:, :FAN]
        usable = np.take_along_axis(open_sims, pick, 1) > -np.inf
        fresh[live[:, None], pick] = False
        near = neighbours[np.where(usable, node[live[:, None], pick], 0)]
        near = np.where(usable[:, :, None], near, -1).reshape(len(live), -1)
        near.sort(axis=1)  # so that a node that several others offer is taken once
        new = (near >= 0) & ~seen[live[:, None], near]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        value = np.full(near.shape, -np.inf, np.float32)
        a, b = np.nonzero(new)
        value[a, b] = np.einsum("nd,nd->n", x[near[a, b]], q[live[a]])
        seen[live[a], near[a, b]] = True
        all_node, all_sims = np.concatenate((node[live], near), 1), np.concatenate((sims[live], value), 1)
        all_fresh = np.concatenate((fresh[live], new), 1)
        keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        node[live], sims[live], fresh[live] = (np.take_along_axis(y, keep, 1) for y in (all_node, all_sims, all_fresh))
        live = live[(fresh[live] & (sims[live] > -np.inf)).any(axis=1)]
    node[np.isneginf(sims)] = -1
    return node


def pack(index: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **index)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}
