"""Weighted MinHash of shingle multisets after BagMinHash, and exact multiset overlap.

An element of weight w owns the weight levels 1 to w. They are grouped into shells (0,1], (1,2], (2,4], (4,8] ...; each
shell of each element is a Poisson process in time whose rate is the shell's width. A point of a process carries a level
of its shell, a signature register and an identity, all derived from the element's hash, so two multisets see the same
points. A point counts for a multiset if its level is at most the element's weight: the lower halves of the hierarchy are
shared, the upper one is thinned. A register keeps the identity of its earliest point; two multisets agree in a register
with a probability that equals their weighted Jaccard similarity. An element costs as many processes as its weight has
binary digits, and time is cut off where all registers have a point.
"""

from __future__ import annotations

import numpy as np

from .word_hash import U, Words, mix, runs

SHINGLE = 5


def shingle_bags(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (text, hash, multiplicity); a text of one to four words is one shingle."""
    owner, counts = w.text_of(), w.count
    all_runs = runs(w.hash, SHINGLE)
    whole = np.flatnonzero(owner[: len(all_runs)] == owner[SHINGLE - 1 :]) if len(all_runs) else np.zeros(0, np.int64)
    texts, hashes, weights = [], [], []
    bounds = np.searchsorted(owner[whole], np.arange(len(counts) + 1)) if len(whole) else np.zeros(len(counts) + 1, np.int64)
    values = all_runs[whole]
    for k, n in enumerate(counts):
        if n >= SHINGLE:
            found, times = np.unique(values[bounds[k] : bounds[k + 1]], return_counts=True)
        elif n:
            found, times = runs(w.hash[w.first[k] : w.first[k + 1]], int(n)), np.ones(1, np.int64)
        else:
            continue
        texts.append(np.full(len(found), k))
        hashes.append(found)
        weights.append(times)
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(texts), np.concatenate(hashes), np.concatenate(weights)


def _points(text: np.ndarray, element: np.ndarray, weight: np.ndarray, until: np.ndarray, registers: int, time: np.ndarray, identity: np.ndarray) -> None:
    """Lower the registers by all points before ``until`` (one time for each element)."""
    shells = np.frexp(np.maximum(weight - 1, 0).astype(float))[1] + 1
    k = np.repeat(np.arange(len(element)), shells)
    shell = np.arange(len(k)) - np.repeat(np.cumsum(shells) - shells, shells)
    width = np.where(shell == 0, 1.0, 2.0 ** (shell - 1))
    base = np.where(shell == 0, 0.0, width)
    seed = mix(element[k] + shell.astype(U) * U(0xD1B54A32D192ED03))
    text, weight, until = text[k], weight[k], until[k]
    now, done, step = np.zeros(len(k)), 0, 1
    while len(now):  # points done + 1 to done + step of the processes that are still before their end
        number = np.arange(done + 1, done + step + 1, dtype=U)
        mark = mix(seed[:, None] + number * U(0x9E3779B97F4A7C15))
        at = now[:, None] + np.cumsum(-np.log1p((mark >> U(11)) * -(2.0**-53)), axis=1) / width[:, None]
        row, column = np.nonzero(at < until[:, None])
        name, early = mix(mark[row, column] ^ U(0xA0761D6478BD642F)), at[row, column]
        ok = base[row] + np.floor((name >> U(11)) * 2.0**-53 * width[row]) + 1 <= weight[row]
        row, name, early = row[ok], name[ok], early[ok]
        slot = text[row] * registers + (mix(name) % U(registers)).astype(np.int64)
        np.minimum.at(time, slot, early)
        first = time[slot] == early
        identity[slot[first]] = name[first]
        alive = at[:, -1] < until
        text, weight, until, seed, width, base, now = (x[alive] for x in (text, weight, until, seed, width, base, at[:, -1]))
        done, step = done + step, min(4 * step, 256)


def signatures(bags: tuple[np.ndarray, np.ndarray, np.ndarray], texts: int, registers: int) -> np.ndarray:
    """One row of register identities for each text; rows of texts without shingles are 0."""
    text, element, weight = bags
    time, identity = np.full(texts * registers, np.inf), np.zeros(texts * registers, U)
    total = np.bincount(text, weights=weight, minlength=texts)
    until = registers * (np.log(registers) + 2.5) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        chosen = todo[text]
        _points(text[chosen], element[chosen], weight[chosen], until[text[chosen]], registers, time, identity)
        todo &= np.isinf(time).reshape(texts, registers).any(axis=1)
        until = np.where(todo, 2 * until, until)
    return identity.reshape(texts, registers)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each stretch of ``rows`` registers, different from band to band."""
    keys = np.zeros((signature.shape[0], signature.shape[1] // rows), U)
    for b in range(keys.shape[1]):
        key = np.full(signature.shape[0], b + 1, U)
        for r in range(rows):
            key = mix(key * U(0x9E3779B97F4A7C15) + signature[:, b * rows + r])
        keys[:, b] = key
    return keys


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags of (sorted distinct hashes, multiplicities)."""
    _, at, to = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][at], b[1][to]).sum()
    union = a[1].sum() + b[1].sum() - common
    return float(common / union) if union else 0.0
