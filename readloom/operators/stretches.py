"""Stretches of a de Bruijn graph: k-mers that follow each other in one read and are linked uniquely, as one row.

Reads are cut where the smallest hash of the words in a k-mer (its minimizer) changes, and the pieces are shuffled by that
hash, packed to two bits a letter; all occurrences of a k-mer meet there and are counted. Then every k-mer is dealt to one
of the reads that hold it, so k-mers of a read that belong together meet in one task and are joined there; what is left to
join over the whole graph are stretches, not k-mers. Neighbours are joined only if their counts of letters on either side
and their own letters say so, so where the rows of a read are torn apart, stretches get shorter and nothing else. For odd k
up to 31; codes are those of ``graph.kmer_code``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of a read that one number tells apart (14 bits, and one for the strand); longer reads are dealt in pieces.
PLACES = 14
_DIGIT = np.full(256, 4, np.int64)
_DIGIT[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
_LETTER = np.frombuffer(b"ACGT", np.uint8)
_SIDE = pa.list_(pa.int64())
_PIECE = pa.schema([("bucket", pa.int32()), ("owner", pa.int64()), ("packed", pa.binary())])
_KNOWN = pa.schema([("code", pa.int64()), ("owner", pa.int64()), ("counts", pa.binary())])
_STRETCH = pa.schema([(c, pa.int64()) for c in ("first", "last", "n", "kmer_cov", "top", "top_cov")] + [("seq", pa.string()), ("before", _SIDE), ("after", _SIDE)])
_WAY = pa.schema([(c, pa.int64()) for c in ("a", "src", "dst", "cov")] + [("only", pa.bool_())])
#: K-mers that a task counts at once.
_AT_ONCE = 1 << 20


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, and where each begins (one more entry for the end); nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)), offsets - offsets[0]


def _windows(digit: np.ndarray, read: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of k letters inside one read, and their numbers on both strands."""
    n = max(len(digit) - k + 1, 0)
    bad = np.concatenate(([0], np.cumsum(digit > 3)))
    at = np.flatnonzero((read[:n] == read[k - 1 : k - 1 + n]) & (bad[k : k + n] == bad[:n]))
    own, other = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(k):
        own = (own << 2) | (digit[j : j + n] & 3)
        other |= (3 - (digit[j : j + n] & 3)) << (2 * j)
    return at, own[at], other[at]


def signed_codes(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all k-mers of A, C, G and T of all strings: the string's number, the place, the signed code."""
    text, begin = _texts(column)
    read = np.repeat(np.arange(len(column)), np.diff(begin))
    at, own, other = _windows(_DIGIT[text], read, k)
    letter = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))  # letters, of which others than these have several bytes
    return read[at], letter[at] - letter[begin[read[at]]], np.where(own <= other, own + 1, -other - 1)


def _minimizers(digit: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The smallest hash of the words of k / 2 letters in each window, the same on both strands."""
    m = max(k // 2, 1)
    n = max(len(digit) - m + 1, 0)
    own, other = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(m):
        letter = (digit[j : j + n] & 3).astype(np.uint64)
        own = (own << np.uint64(2)) | letter
        other |= (np.uint64(3) - letter) << np.uint64(2 * j)
    low = (((np.minimum(own, other) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int32)
    span, wide = 1, k - m + 1
    while 2 * span <= wide:
        low, span = np.minimum(low[: len(low) - span], low[span:]), 2 * span
    return np.minimum(low[at], low[at + wide - span])


def _pieces(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """bucket (the minimizer), owner (of the first k-mer, as if it were not on its kept strand) and packed letters of the runs
    of k-mers of a read with one minimizer. A packed run begins with the letters beside it (1 to 4, 0: none), three bits
    each, and two bits for the number of letters in its last byte."""
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            part = batch.slice(start, 2048)
            text, begin = _texts(part.column("seq"))
            name = part.column("name").to_numpy(zero_copy_only=False)
            read, digit = np.repeat(np.arange(part.num_rows), np.diff(begin)), _DIGIT[text]
            at, *_ = _windows(digit, read, k)
            if not len(at):
                continue
            padded, around = np.concatenate((digit, [4])), np.concatenate((read, [-1]))
            place, low = at - begin[read[at]], _minimizers(digit, at, k)
            goes_on = (np.diff(at) == 1) & (np.diff(read[at]) == 0) & (np.diff(low) == 0) & (np.diff(place >> PLACES) == 0)
            a = np.flatnonzero(np.concatenate(([True], ~goes_on)))
            z = np.append(a[1:], len(at)) - 1
            beside = lambda place, of: np.where((around[place] == of) & (padded[place] < 4), padded[place] + 1, 0)
            before, after = beside(at[a] - 1, read[at[a]]), beside(at[z] + k, read[at[z]])
            piece = (name[read[at[a]]] + (place[a] >> PLACES) * 0x9E3779B1) & ((1 << 62 - PLACES) - 1)
            owner = (piece << (PLACES + 1)) | ((place[a] & ((1 << PLACES) - 1)) << 1)
            letters = at[z] - at[a] + k
            size = (letters + 3) // 4
            offsets = np.concatenate(([0], np.cumsum(size + 1)))
            fours = np.zeros(4 * offsets[-1], np.uint8)
            run = np.repeat(np.arange(len(a)), letters)
            inside = np.arange(len(run)) - np.repeat(np.cumsum(letters) - letters, letters)
            fours[4 * (offsets[run] + 1) + inside] = digit[at[a][run] + inside]
            packed = (fours.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8)
            packed[offsets[:-1]] = before << 5 | after << 2 | letters & 3
            rows = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([pa.array(low[a]), pa.array(owner), rows], schema=_PIECE)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and where each begins (one more entry for the end)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _occurrences(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """bucket, code, count, owner and the counts of letters on both sides, as the kept strand sees them, of the k-mers of pieces; each once."""
    packed, offsets = _bytes(batch.column("packed"))
    head = packed[offsets[:-1]].astype(np.int64)
    letters = 4 * (np.diff(offsets) - 1) - ((4 - (head & 3)) & 3)
    # one row of letters, with those beside each run
    begin = np.concatenate(([0], np.cumsum(letters + 2)))
    row = np.repeat(np.arange(len(letters)), letters)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(letters) - letters, letters)
    place = 4 * (offsets[row] + 1) + inside
    digit = np.full(begin[-1], 4, np.int64)
    digit[begin[row] + 1 + inside] = (packed[place >> 2] >> (6 - 2 * (place & 3)).astype(np.uint8)) & 3
    runs = np.repeat(np.arange(len(letters)), letters)
    at, own, other = _windows(digit[(begin[row] + 1 + inside)], runs, k)
    of, where = row[at], inside[at]
    digit[begin[:-1]], digit[begin[1:] - 1] = (head >> 5) - 1, (head >> 2 & 7) - 1
    before, after = digit[begin[of] + where] + 1, digit[begin[of] + where + k + 1] + 1
    kept = own <= other
    turned = lambda x: np.where(x > 0, 5 - x, 0)
    left, right = np.where(kept, before, turned(after)), np.where(kept, after, turned(before))
    owner = batch.column("owner").to_numpy()[of] + 2 * where + kept
    code = np.minimum(own, other) + 1
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))[: len(code)])
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
    counted = [np.bincount(5 * group + side[order], minlength=5 * len(first)).reshape(-1, 5)[:, 1:] for side in (left, right)]
    return [batch.column("bucket").to_numpy()[of][order][first], code[first], np.bincount(group), np.minimum.reduceat(owner[order], first), np.concatenate(counted, 1)]


def _merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    bucket, code, cov, owner, sides = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return [bucket[order][first], code[first], np.add.reduceat(cov[order], first), np.minimum.reduceat(owner[order], first), np.add.reduceat(sides[order], first)]


def _packed_counts(counts: np.ndarray) -> pa.Array:
    """Rows of counts, in a byte each where all of a row are small, else in eight."""
    small = counts.max(1) < 256
    size = np.where(small, counts.shape[1], 8 * counts.shape[1])
    offsets = np.concatenate(([0], np.cumsum(size)))
    data = np.empty(offsets[-1], np.uint8)
    for chosen, kind, wide in ((small, np.uint8, 1), (~small, np.int64, 8)):
        rows = counts[chosen].astype(kind).view(np.uint8).reshape(-1, wide * counts.shape[1])
        data[offsets[:-1][chosen][:, None] + np.arange(wide * counts.shape[1])] = rows
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _unpacked_counts(column: pa.Array, wide: int) -> np.ndarray:
    data, offsets = _bytes(column)
    out, large = np.empty((len(column), wide), np.int64), np.diff(offsets) > wide
    out[~large] = data[offsets[:-1][~large][:, None] + np.arange(wide)]
    out[large] = data[offsets[:-1][large][:, None] + np.arange(8 * wide)].view(np.int64)
    return out


def _counted(batches: Iterator[pa.RecordBatch], k: int, least: int) -> Iterator[pa.RecordBatch]:
    """code, owner and counts (of the k-mer, and of the four letters on both sides) of the k-mers of pieces that come in the
    order of their buckets. Only k-mers of the last bucket wait for more."""

    def rows(known: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        _, code, cov, owner, sides = known
        chosen = np.flatnonzero(cov >= least)
        for i in range(0, len(chosen), 1 << 16):
            c = chosen[i : i + (1 << 16)]
            counts = np.concatenate((cov[c, None], np.where(sides[c] >= least, sides[c], 0)), 1)
            yield pa.RecordBatch.from_arrays([pa.array(code[c]), pa.array(owner[c]), _packed_counts(counts)], schema=_KNOWN)

    waiting, parts, n = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append(_occurrences(batch, k))
        n += len(parts[-1][1])
        if n >= _AT_ONCE + (len(waiting[0][1]) if waiting else 0):
            known = _merged(waiting + parts)
            last = known[0] == known[0].max()
            yield from rows([c[~last] for c in known])
            waiting, parts, n = [[c[last] for c in known]], [], 0
    if waiting or parts:
        yield from rows(_merged(waiting + parts))


def _turned(value: np.ndarray, k: int) -> np.ndarray:
    """Numbers of k letters read from the other strand."""
    out, rest = np.zeros_like(value), value.copy()
    for _ in range(k):
        out, rest = (out << 2) | (3 - (rest & 3)), rest >> 2
    return out


def _letters(value: np.ndarray, k: int) -> np.ndarray:
    """A row of k letters for each number."""
    return _LETTER[(value[:, None] >> (2 * np.arange(k - 1, -1, -1))) & 3]


def _signed(value: np.ndarray, k: int) -> np.ndarray:
    other = _turned(value, k)
    return np.where(value <= other, value + 1, -other - 1)


def strings(first: np.ndarray, last_letter: np.ndarray, begin: np.ndarray, k: int) -> pa.Array:
    """Texts of runs of k-mers: all letters of the first and the last letter of each other one. ``begin`` holds where each
    run begins among ``last_letter``, and the end."""
    length = np.diff(begin) + k - 1
    offsets = np.concatenate(([0], np.cumsum(length)))
    text = np.empty(offsets[-1], np.uint8)
    text[(offsets[:-1, None] + np.arange(k)).ravel()] = _letters(first, k).ravel()
    inner = np.ones(len(last_letter), bool)
    inner[begin[:-1]] = False
    run = np.repeat(np.arange(len(length)), np.diff(begin))
    text[(offsets[run] + np.arange(len(last_letter)) - begin[run] + k - 1)[inner]] = last_letter[inner]
    return pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text)]).cast(pa.string())


def _joined(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Stretches of k-mers (code, owner, counts) that are rows beside each other."""
    mask = (1 << 2 * k) - 1
    for batch in batches:
        if not batch.num_rows:
            continue
        code, owner, counts = batch.column("code").to_numpy(), batch.column("owner").to_numpy(), _unpacked_counts(batch.column("counts"), 9)
        cov, left, right = counts[:, 0], counts[:, 1:5], counts[:, 5:]
        kept = (owner & 1) == 1
        oriented, value = np.where(kept, code, -code), np.where(kept, code - 1, _turned(code - 1, k))
        after, before = np.where(kept[:, None], right, left[:, ::-1]), np.where(kept[:, None], left, right[:, ::-1])
        n_after, n_before = (after > 0).sum(1), (before > 0).sum(1)
        onward = ((value << 2) | np.argmax(after > 0, 1)) & mask
        follows = np.concatenate(([False], (n_after[:-1] == 1) & (n_before[1:] == 1) & (onward[:-1] == value[1:]) & (code[:-1] != code[1:])))
        begin = np.concatenate((np.flatnonzero(~follows), [len(code)]))
        a, z = begin[:-1], begin[1:] - 1
        # the largest code of a stretch, and how often the arc before it, on the strand where it is positive, was seen; it is
        # asked for where the ends have one way, so that every k-mer of the stretch has one
        run = np.repeat(np.arange(len(a)), np.diff(begin))
        best = np.lexsort((code, run))[begin[1:] - 1]
        up = oriented[best] > 0
        top_cov = np.where(up, before[best].max(1), after[best].max(1))
        seq = strings(value[a], _LETTER[value & 3], begin, k)
        ring = (n_before[a] == 1) & (n_after[z] == 1)  # only these can lie on one
        total = np.add.reduceat(cov, a)
        fields = [pa.array(c.astype(np.int64)) for c in (oriented[a], oriented[z], np.diff(begin), total)]
        tops = [pa.array(oriented[best].astype(np.int64), mask=~ring), pa.array(top_cov.astype(np.int64), mask=~ring)]
        yield pa.RecordBatch.from_arrays([*fields, *tops, seq, _side(before[a]), _side(after[z])], schema=_STRETCH)


def _side(counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(counts) + 1, 4, dtype=np.int32)), pa.array(np.ascontiguousarray(counts, np.int64).ravel()))


def _led(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    mask = (1 << 2 * k) - 1
    for batch in batches:
        text, begin = _texts(batch.column("seq"))
        digit, name = _DIGIT[text], batch.column("id").to_numpy()
        spelled = lambda start: sum((digit[start + j] << (2 * (k - 1 - j)) for j in range(k)), np.zeros(len(name), np.int64))
        before, after = (np.array(batch.column(c).flatten().to_numpy(), np.int64).reshape(-1, 4) for c in ("before", "after"))
        found = []
        for sign, number, counts in ((-1, _turned(spelled(begin[:-1]), k), before[:, ::-1]), (1, spelled(begin[1:] - k), after)):
            at, b = np.nonzero(counts)
            found.append((sign * name[at], _signed(number, k)[at], _signed(((number[at] << 2) | b) & mask, k), counts[at, b], ((counts > 0).sum(1) == 1)[at]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=_WAY)


def ways(parts: DataFrame, k: int) -> DataFrame:
    """a (the id, negative where it is left on the other strand), src and dst (signed codes of k-mers), cov and only (whether
    it is the one way there) of all ways that leave ``parts`` (id, seq, and the counts of letters before and after it)."""
    return parts.select("id", "seq", "before", "after").mapInArrow(_on(_led, k), _ddl(_WAY))


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", _SIDE: "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _on(f: Callable, k: int, **more: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return partial(f, k=k, **more)


def stretches(reads: DataFrame, k: int, least: int = 1) -> DataFrame:
    """first and last (signed codes), n, kmer_cov, seq, before and after (how often A, C, G and T were seen beside its ends);
    every k-mer is in one stretch. Where both ends have one way, so that it may lie on a ring, also top (the signed code
    that is largest without its sign) and top_cov (of the arc before it where it is positive). K-mers and arcs seen less than ``least`` times are left out, before anything is dealt."""
    named = reads.select("seq", F.xxhash64("seq").alias("name"))
    pieces = named.mapInArrow(_on(_pieces, k), _ddl(_PIECE)).repartition("bucket").sortWithinPartitions("bucket")
    known = pieces.mapInArrow(_on(_counted, k, least=least), _ddl(_KNOWN))
    dealt = known.repartition(F.shiftright("owner", PLACES + 1)).sortWithinPartitions("owner")
    return dealt.mapInArrow(_on(_joined, k), _ddl(_STRETCH))


def _walked(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """``batches`` (with seq and ring) with members, the signed codes of the k-mers; a ring begins at its largest."""
    for batch in batches:
        read, _, code = signed_codes(batch.column("seq"), k)
        begin = np.searchsorted(read, np.arange(batch.num_rows + 1))
        seq, names = batch.column("seq"), batch.schema.names
        rings = np.flatnonzero(batch.column("ring").to_numpy(zero_copy_only=False))
        if len(rings):
            texts = seq.to_pylist()
            for i in rings:
                part = code[begin[i] : begin[i + 1]]
                turn = int(part.argmax())
                texts[i] = texts[i][turn : len(part)] + texts[i][: turn + k - 1] if turn else texts[i]
                code[begin[i] : begin[i + 1]] = np.roll(part, -turn)
            seq = pa.array(texts, pa.string())
        members = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(code))
        yield pa.RecordBatch.from_arrays([seq if c == "seq" else batch.column(c) for c in names] + [members], [*names, "members"])


def with_members(paths: DataFrame, k: int) -> DataFrame:
    """``paths`` (with seq and ring) with ``members``; rings are turned to begin at their largest k-mer."""
    fields = ", ".join(f"{n} {t}" for n, t in paths.dtypes)
    return paths.mapInArrow(_on(_walked, k), f"{fields}, members array<long>")


def _placed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            read, place, code = signed_codes(part.column("seq"), k)
            keys = [part.column(c).take(pa.array(read)) for c in part.schema.names if c != "seq"]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(place.astype(np.int32)), pa.array(code)], [c for c in part.schema.names if c != "seq"] + ["pos", "code"])


def placed_codes(reads: DataFrame, k: int, *keys: str) -> DataFrame:
    """keys, pos and code (signed) of each k-mer of ``reads`` (keys, seq)."""
    fields = [f"{n} {t}" for n, t in reads.select(*keys).dtypes]
    return reads.select(*keys, "seq").mapInArrow(_on(_placed, k), ", ".join([*fields, "pos int", "code long"]))
