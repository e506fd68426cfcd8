"""Correction of one cluster's reads against the cluster's own cleaned graph; a helper of grouped work.

The graph is kept as counted k-mers on both strands. Cleaning drops k-mers below the cutoff, and whole tips: low dead ends
shorter than two k-mers. A read keeps its longest run of graph k-mers as a seed and is extended from it in both
directions along the graph, each step taken by the branch that agrees best with what is left of the read. The read's
length never changes, and a correction counts only if it scores more than half of the read.
"""

from __future__ import annotations

from collections import Counter

from ..functions.alignment import hamming_score

_SWAP = str.maketrans("ACGT", "TGCA")
#: Branches that one extension may follow side by side.
BEAM = 50


def reverse_complement(seq: str) -> str:
    return seq.translate(_SWAP)[::-1]


def build(reads: list[str], k: int) -> Counter[str]:
    """k-mers of both strands with their counts."""
    found: Counter[str] = Counter()
    for read in reads:
        for i in range(len(read) - k + 1):
            kmer = read[i : i + k]
            if not kmer.strip("ACGT"):
                found[kmer] += 1
                found[reverse_complement(kmer)] += 1
    return found


def right(graph: Counter[str], kmer: str) -> list[str]:
    return [n for b in "ACGT" if (n := kmer[1:] + b) in graph]


def left(graph: Counter[str], kmer: str) -> list[str]:
    return [n for b in "ACGT" if (n := b + kmer[:-1]) in graph]


def clean(graph: Counter[str], k: int, cutoff: float) -> Counter[str]:
    """Drop tips in rounds, until none is left: paths that end, are at most k long, and join a better covered branch."""
    graph = Counter(graph)
    while True:
        gone: set[str] = set()
        for kmer in sorted(graph):
            if left(graph, kmer) or kmer in gone:
                continue
            path, ahead = [kmer], right(graph, kmer)
            while len(ahead) == 1 and len(left(graph, ahead[0])) == 1 and len(path) <= k:
                path.append(ahead[0])
                ahead = right(graph, ahead[0])
            average = sum(graph[x] for x in path) / len(path)
            rivals = [y for x in ahead for y in left(graph, x) if y != path[-1]]
            beaten = not ahead or len(ahead) > 1 or any(graph[y] > average for y in rivals)
            if len(path) <= k and average <= cutoff and beaten:
                gone.update(path)
        if not gone:
            return graph
        for kmer in gone:
            graph.pop(kmer, None)
            graph.pop(reverse_complement(kmer), None)


def longest_seed(graph: Counter[str], read: str, k: int) -> tuple[int, int] | None:
    """First and last start of the longest run of consecutive graph k-mers."""
    best, first = None, None
    for i in range(len(read) - k + 2):
        if i <= len(read) - k and read[i : i + k] in graph:
            first = i if first is None else first
        elif first is not None:
            if best is None or i - first > best[1] - best[0] + 1:
                best = (first, i - 1)
            first = None
    return best


def extend(graph: Counter[str], kmer: str, rest: str) -> tuple[str, bool]:
    """Bases along the graph for ``rest``, and whether two ends were equally good (then the read's own bases stay). Where
    the graph ends, the read's bases go on."""
    paths = {("", kmer): 0}
    for at, base in enumerate(rest):
        following: dict[tuple[str, str], int] = {}
        for (path, last), errors in paths.items():
            for n in right(graph, last) if last else []:
                key = (path + n[-1], n)
                following[key] = min(following.get(key, at + 2), errors + (n[-1] != base))
            if not last or not right(graph, last):
                following[path + base, ""] = errors
        ranked = sorted(following.items(), key=lambda x: (x[1], x[0]))
        paths = dict(ranked[:BEAM])
    ends = sorted((errors, path) for (path, _), errors in paths.items())
    if len(ends) > 1 and ends[0][0] == ends[1][0] and ends[0][1] != ends[1][1]:
        return rest, True
    return ends[0][1], False


def correct_reads(reads: list[str], k: int, cutoff: float) -> list[tuple[str, bool, int]]:
    """Of each read its corrected sequence, whether that was accepted, and how many bases changed."""
    counts = build(reads, k)
    graph = clean(Counter({x: n for x, n in counts.items() if n >= cutoff}), k, cutoff)
    out = []
    for read in reads:
        seed = longest_seed(graph, read, k) if len(read) >= k else None
        if seed is None:
            out.append((read, False, 0))
            continue
        first, last = seed
        tail, _ = extend(graph, read[last : last + k], read[last + k :])
        head, _ = extend(graph, reverse_complement(read[first : first + k]), reverse_complement(read[:first]))
        fixed = reverse_complement(head) + read[first : last + k] + tail
        score = hamming_score(read, fixed)
        ok = score > len(read) // 2
        out.append((fixed if ok else read, ok, (len(read) - score) // 2 if ok else 0))
    return out
