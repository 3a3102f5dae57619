"""Substring deduplication by compact windows.

A text is the sequence of its five-word shingles. For each of HASHES random orders, the Cartesian tree over the shingles'
values groups all subsequences of at least LEAST_WORDS words by the shingle that is least in them: node c stands for every
subsequence between its nearest smaller neighbours that holds c (a compact window). Two texts with a common passage have,
for each order, windows over it with the same least shingle. Windows are joined on order and value; pairs of documents whose
windows meet over a passage in ENOUGH orders are verified word by word on their texts.

A value of at most SMALL documents gives all their pairs, unless its windows all have the same surroundings; a larger one gives a star
around its least document, within each task before the shuffle and then over tasks. That document may hold the least shingle without
the passage, so that two things follow for values whose windows don't all have the same surroundings. Those of order 0 are open: each run of
as many shingles as LEAST_WORDS words have, of which the value is the least, is a value of its own there, and links its documents to the
least one. All that share a run have all of it, so that every word-by-word repeat of LEAST_WORDS words is found. And the documents of each
large one are compared, when the passages of the stars and small values are known. Of a text only positions outside these are looked for, in runs of which
earlier documents of large values have enough shingles: shingles meet by value, as arrays, to tell which those are. The other texts are looked through
for the shingles that are looked for in the value. What is left is dealt to cells, and every two cells are compared by whole arrays. Of the texts that
have enough in common with one that is looked for, those of which an earlier one in the cell has all positions in common are left out: what they
would give lies within what that one gives. So a group of near copies gives few pairs. Bitmaps of bounded size tell what to look for; where they fill
up at size, more is compared than need be.

Pairs are verified word by word on their texts: a shingle counts if the other text has it. A passage is reported for the later document, with the
earlier one that has it, unless it lies within one that a still earlier document has: taking out all reported passages leaves the first occurrence of
each. A passage has at least LEAST_WORDS words and at least SIMILARITY of its shingles in the other text; it starts and ends with shared shingles.

Null, empty and short texts have no windows, and rows with a null doc_id take no part. Rows that repeat a doc_id count as one
document; where their texts differ, each is cut by its own passages. Ties go to the first position. Texts of any length are taken whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm.common import binary_texts, free, free_name, map_arrow, materialize, mix, shingle_lists, slices, table, word_hashes
from maskwell.llm.jaccard import token_bitmap
from maskwell.llm.pairs import runs, with_texts

WORD_SHINGLE = 5
LEAST_WORDS = 50
SIMILARITY = 0.75
HASHES, ENOUGH = 4, 2
#: Rows that a task holds before it passes them on.
FLUSH = 400_000
#: Values of up to so many documents give all their pairs; larger ones give a star.
SMALL = 16
SALTS = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)


def compact_windows(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all nodes of the Cartesian tree whose span has at least `least` positions; r is inclusive; of equal values the first is less.

    A node's ancestors have wider spans, so that only positions that are least in some run of `least` can matter; the tree is
    built on these alone.
    """
    n = len(values)
    empty = np.empty(0, np.int64)
    if n < least:
        return empty, empty, empty
    # least value, and its first position, of each run of `least`, by doubling
    low, arg, width = values, np.arange(n), 1
    while width < least:
        step = min(width, least - width)
        a, b = low[: len(low) - step], low[step:]
        right = b < a
        arg = np.where(right, arg[step:], arg[: len(arg) - step])
        low = np.where(right, b, a)
        width += step
    at = np.unique(arg)
    v = values[at].tolist()
    pos = at.tolist()
    left, right, stack = [0] * len(v), [n - 1] * len(v), []
    for i, x in enumerate(v):
        while stack and v[stack[-1]] > x:
            right[stack.pop()] = pos[i] - 1
        left[i] = pos[stack[-1]] + 1 if stack else 0
        stack.append(i)
    l, r = np.array(left), np.array(right)
    wide = r - l + 1 >= least
    return l[wide], at[wide], r[wide]


def _slide(x: np.ndarray, least: int, of) -> np.ndarray:
    """of, np.minimum or np.maximum, of each run of `least`, by doubling."""
    width = 1
    while width < least:
        step = min(width, least - width)
        x = of(x[: len(x) - step], x[step:])
        width += step
    return x


def windows_of(x: np.ndarray, ends: np.ndarray, salt: np.uint64, least: int) -> tuple[np.ndarray, ...]:
    """compact_windows() of the values mix(x ^ salt) of texts that lie one after the other in x, with len(texts) + 1 ends: the texts' numbers, the values,
    and l, c and r as places in x."""
    n = np.diff(ends)
    if len(x) < least:
        empty = np.empty(0, np.int64)
        return empty, np.empty(0, np.uint64), empty, empty, empty
    values = np.maximum(mix(x ^ salt), np.uint64(1))
    owner = np.repeat(np.arange(len(n)), n)
    low = _slide(values, least, np.minimum)
    low[owner[: len(low)] != owner[least - 1 :]] = 0  # a run over the end of a text
    none = np.zeros(least - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate((none, low, none)), least, np.maximum) == values)  # the least of some run
    twice = np.flatnonzero((values[at[1:]] == values[at[:-1]]) & (np.diff(at) < least) & (owner[at[1:]] == owner[at[:-1]])) + 1
    # of equal values the first is less: one after it counts if it is the least of a run that begins between them; what lies between is less than
    # both, or they stand next to each other here
    if len(twice):
        a, b = at[twice - 1] + 1, at[twice]
        most, m, width = np.zeros(len(twice), np.uint64), np.concatenate((low, none)), 1
        while width < least:
            some = (b - a + 1 >= width) & (b - a + 1 < 2 * width)
            most[some] = np.maximum(m[a[some]], m[b[some] - width + 1])
            m = np.maximum(m[:-width], m[width:])
            width *= 2
        at = np.delete(at, twice[most != values[b]])
    of = owner[at]
    v, pos, k = values[at].tolist(), at.tolist(), len(at)
    new = np.concatenate(([True], of[1:] != of[:-1])).tolist() if k else []
    left, right, stack = ends[of].tolist(), (ends[of + 1] - 1).tolist(), []
    for i in range(k):
        if new[i]:
            stack = []
        else:
            y, before = v[i], pos[i] - 1
            while stack and v[stack[-1]] > y:
                right[stack.pop()] = before
            if stack:
                left[i] = pos[stack[-1]] + 1
        stack.append(i)
    l, r = np.array(left, np.int64), np.array(right, np.int64)
    wide = r - l + 1 >= least
    at = at[wide]
    return of[wide], values[at], l[wide], at, r[wide]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers. np.unique() without places hashes them first, which takes several times as long."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def packed(*columns: np.ndarray) -> bytes:
    """Columns one after the other."""
    return b"".join(c.tobytes() for c in columns)


def unpacked(rows: list[bytes], kinds: tuple) -> list[np.ndarray]:
    """The columns of all packed() rows."""
    size, out = sum(np.dtype(k).itemsize for k in kinds), []
    for t in rows:
        n, at, cols = len(t) // size, 0, []
        for k in kinds:
            cols.append(np.frombuffer(t, k, n, at))
            at += cols[-1].nbytes
        out.append(cols)
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, k) for k in kinds]


def dealt(key: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 64-bit hash. Parts follow each other in the hashes' order."""
    return (key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def by_part(batches: Iterator) -> Iterator[tuple]:
    """Of rows in order of their first column, a part, the lists of what each part has in the other columns."""
    part, held = None, []
    for b in batches:
        for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != part and held:
                yield part, *(list(x) for x in zip(*held, strict=True))
                held = []
            part = k
            held.append(row)
    if held:
        yield part, *(list(x) for x in zip(*held, strict=True))


def joined(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays one after the other, and their len(lists) + 1 ends."""
    return np.concatenate([*lists, np.empty(0, np.uint64)]), np.cumsum([0, *map(len, lists)])


def matched_segments(hit: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, float]]:
    """Segments (first, last + 1, share of hits) with at least `least` positions and `similarity` hits, that start and end with hits.

    A hit counts 1 - similarity and a miss -similarity; the segments are the maximal-scoring ones, split where they are too thin.
    """
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    first, last = edge[::2], edge[1::2]
    held: list[list[float]] = []
    total = at = 0.0
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        total -= similarity * (a - at)
        at = b
        before, total = total, total + (1 - similarity) * (b - a)
        new = [a, b, before, total]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j -= 1
            if j < 0 or held[j][3] >= new[3]:
                held.append(new)
                break
            new = [held[j][0], new[1], held[j][2], new[3]]
            del held[j:]
    return [(int(a), int(b), float(hit[int(a) : int(b)].mean())) for a, b, _, _ in held if b - a >= least and hit[int(a) : int(b)].mean() >= similarity]


def tokens(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    return shingle_lists(texts, WORD_SHINGLE)


#: Shingles of texts whose windows are found together, about.
TOGETHER = 1 << 15


def together(ids: list[int], lists: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts that have windows, some at a time: their ids, their shingles one after the other, and the ends of these."""
    doc, few, n = [], [], 0
    for d, x in zip(ids, lists, strict=True):
        if len(x) >= LEAST:
            doc.append(d)
            few.append(x)
            n += len(x)
            if n >= TOGETHER:
                yield np.array(doc), *joined(few)
                doc, few, n = [], [], 0
    if few:
        yield np.array(doc), *joined(few)


#: Columns of windows, sig, doc, a, b, h and big, and of stars, sig, doc, c_doc, a, b and h, in packed().
WINDOW, STAR = ("<i8", "<i8", "<i8", "<i8", "i1", "?"), ("<i8", "<i8", "<i8", "<i8", "<i8", "i1")
PAIR = ("<i8", "<i8")


def window_rows(docs: DataFrame, text: str, parts: int) -> DataFrame:
    """k, windows, stars: by parts of the values, as arrays, the WINDOW columns: a value of order h that doc has windows of, with the least and greatest
    hash of their surroundings.

    Of a value that a task meets in more than SMALL documents the row of the least is marked big and has the surroundings of all, and the
    others are among the stars, with that document as c_doc.
    """
    import pyarrow as pa

    def out(held):
        sig, doc, h, around = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        key = mix(sig.view(np.uint64))
        order = np.lexsort((doc, key))
        sig, doc, h, around, key = (x[order] for x in (sig, doc, h, around, key))
        at = np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1]))))
        low, high = np.minimum.reduceat(around, at), np.maximum.reduceat(around, at)
        sig, doc, h, key = sig[at], doc[at], h[at], key[at]
        first = runs(sig)
        own = first == np.arange(len(sig))
        big = np.bincount(first, minlength=len(first))[first] > SMALL
        starts = np.flatnonzero(own)
        some = big[starts]
        low[starts[some]], high[starts[some]] = np.minimum.reduceat(low, starts)[some], np.maximum.reduceat(high, starts)[some]
        star, center = big & ~own, doc[first]
        ends = np.searchsorted(dealt(key, parts), np.arange(parts + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(ends)).tolist():
            s = slice(ends[k], ends[k + 1])
            m = star[s]
            windows, stars = (packed(*(x[s][of] for x in cols)) for of, cols in ((~m, (sig, doc, low, high, h, big)), (m, (sig, doc, center, low, high, h))))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([windows], pa.binary()), pa.array([stars], pa.binary())], names=["k", "windows", "stars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in slices(batches, 100):
            few = []
            for doc, x, ends in together(b.column(0).to_pylist(), tokens(binary_texts(b.column(1)))):
                sums = run_sums(x)
                for h in range(HASHES):
                    of, v, l, c, r = windows_of(x, ends, SALTS[h], LEAST)
                    few.append((v.view(np.int64), doc[of], np.full(len(c), h, np.int8), surroundings(sums, l, c, r)))
            if few:
                held.append(tuple(np.concatenate(x) for x in zip(*few, strict=True)))  # small arrays have much overhead
                n += len(held[-1][0])
            if n >= FLUSH:
                yield from out(held)
                held, n = [], 0
        if n:
            yield from out(held)

    return map_arrow(docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), text), run, "k long, windows binary, stars binary")


LINKS = ["sig", "doc", "c_doc", "h", "a", "b", "large"]


def met_windows(batches: Iterator) -> Iterator:
    """LINKS of all windows of a part, whose rows come one after the other; and, with no documents, the open values: those of order 0 that stand for
    different runs in different places."""
    import pyarrow as pa

    for _, windows, stars in by_part(batches):
        sig, doc, a, b, h, big = unpacked(windows, WINDOW)
        order = np.lexsort((doc, sig))
        sig, doc, a, b, h, big = (x[order] for x in (sig, doc, a, b, h.astype(np.int32), big))
        if len(sig):
            yield from bucket_links(iter([pa.RecordBatch.from_arrays([pa.array(x) for x in (sig, doc, h, a, b, big)], names=["sig", "doc", "h", "a", "b", "big"])]))
            starts = np.flatnonzero(runs(sig) == np.arange(len(sig)))
            found = sig[starts][(h[starts] == 0) & (np.minimum.reduceat(a, starts) != np.maximum.reduceat(b, starts))]
            none = [pa.nulls(len(found), k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())]
            yield from pa.Table.from_arrays([pa.array(found), *none], names=LINKS).to_batches(max_chunksize=100_000)
        sig, doc, c_doc, a, b, h = unpacked(stars, STAR)
        if len(sig):
            cols = (sig, doc, c_doc, h.astype(np.int32), a, b, np.ones(len(sig), bool))
            yield from pa.Table.from_arrays([pa.array(x) for x in cols], names=LINKS).to_batches(max_chunksize=100_000)


def bucket_links(batches: Iterator) -> Iterator:
    """sig, doc, c_doc (the lesser), h, a, b, large from rows (sig, doc, h, a, b, big) in order of sig and doc.

    All pairs of a value of at most SMALL documents with different surroundings, else a star around the least document. A star's rows have the
    least and greatest surroundings of both ends. Rows of a value may go on over batches: at most SMALL are held, or the first of a large one.
    """
    import pyarrow as pa

    def arrays(cols, last: bool):
        """The rows to hold, and a batch."""
        sig, doc, h, a, b, big = cols
        first = runs(sig)
        starts = np.flatnonzero(first == np.arange(len(sig)))
        of = np.cumsum(first == np.arange(len(sig))) - 1
        large = ((np.diff(np.append(starts, len(sig))) > SMALL) | np.maximum.reduceat(big, starts))[of]
        unlike = (np.minimum.reduceat(a, starts) != np.maximum.reduceat(b, starts))[of]
        end = len(sig) if last else int(first[-1])  # the last value may go on
        at = np.arange(len(sig))
        star = np.flatnonzero((first != at) & (large | ~unlike & (at < end)))
        x, y = [first[star]], [star]
        few = np.flatnonzero(~large & unlike & (at < end))
        for d in range(1, SMALL):
            same = np.flatnonzero(sig[few[d:]] == sig[few[:-d]])
            if not len(same):
                break
            x.append(few[same])
            y.append(few[same + d])
        x, y = np.concatenate(x), np.concatenate(y)
        apart = doc[x] != doc[y]
        x, y = x[apart], y[apart]
        found = [sig[y], doc[y], doc[x], h[y], np.minimum(a[x], a[y]), np.maximum(b[x], b[y]), large[y]]
        held = [c[end:] for c in cols]
        if len(held[0]) and large[-1]:
            held = [c[:1].copy() for c in held]
            held[5][:] = True
        return held, pa.Table.from_arrays([pa.array(c) for c in found], names=LINKS).to_batches(max_chunksize=100_000)

    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        held, out = arrays([np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols, False)
        yield from out
    if held and len(held[0]):
        yield from arrays(held, True)[1]


LEAST = LEAST_WORDS - WORD_SHINGLE + 1
#: Bits of the map of open values: where it fills up at size, more runs are tried than need be.
OPEN_BITS = 1 << 26


def run_hashes(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the LEAST shingles from each position, by doubling."""
    h, width = x, 1
    while width < LEAST:
        step = min(width, LEAST - width)
        with np.errstate(over="ignore"):
            h = mix(h[: len(h) - step] * np.uint64(0xC2B2AE3D27D4EB4F) + h[step:] + np.uint64(width))
        width += step
    return h


def own_runs(l: np.ndarray, c: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the runs of LEAST shingles that each node is the least of."""
    return np.maximum(l, c - LEAST + 1), np.minimum(c, r - LEAST + 1) + 1


def run_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the hashes of the runs before each position."""
    with np.errstate(over="ignore"):
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(run_hashes(x), dtype=np.uint64)))


def surroundings(sums: np.ndarray, l: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """A hash of the runs that each node is the least of."""
    first, end = own_runs(l, c, r)
    with np.errstate(over="ignore"):
        return mix(sums[end] - sums[first]).view(np.int64)


def open_values(sigs: DataFrame) -> np.ndarray:
    """A bitmap of values."""
    import pyarrow as pa

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = mix(b.column(0).to_numpy().view(np.uint64)) % np.uint64(OPEN_BITS)
            w = (h >> np.uint64(6)).astype(np.int64)
            order = np.argsort(w, kind="stable")
            w, bit = w[order], (np.uint64(1) << (h & np.uint64(63)))[order]
            if len(w):
                at = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(w[at]), pa.array(np.bitwise_or.reduceat(bit, at).view(np.int64))], names=["w", "bits"])

    out = np.zeros(OPEN_BITS // 64, np.int64)
    found = materialize(map_arrow(sigs, words, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")), "open")
    for r in found.toLocalIterator():  # at most OPEN_BITS / 64 small rows
        out[r.w] = r.bits
    free(found)
    return out.view(np.uint64)


def run_pairs(docs: DataFrame, text: str, opened: DataFrame, parts: int) -> DataFrame:
    """doc, c_doc (the lesser) that have a run of an open value in common. A table.

    Runs go to parts by their hashes, as arrays, and then the pairs, which have runs in many parts, to an eighth as many parts.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(open_values(opened))  # of fixed size

    def stars(sig, doc):
        """Runs in order with their least documents, and the others with these."""
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        first = runs(sig)
        own = first == np.arange(len(sig))
        rest = ~own & (doc != doc[first])
        return sig[own], doc[own], distinct_pairs(doc[rest], doc[first][rest])

    def by_pair(both, parts):
        """Of each part that has pairs, these."""
        to = dealt(mix(both[0].view(np.uint64) ^ mix(both[1].view(np.uint64))), parts)
        order = np.argsort(to, kind="stable")
        a, b = (x[order] for x in both)
        ends = np.searchsorted(to[order], np.arange(parts + 1, dtype=np.uint64)).tolist()
        return {k: packed(a[x:y], b[x:y]) for k, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if y > x}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, n = shared.value, [], 0

        def out():
            sig, doc, both = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            pairs = by_pair(both, parts)
            ends = np.searchsorted(dealt(sig, parts), np.arange(parts + 1, dtype=np.uint64)).tolist()
            for k, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if y > x or k in pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([packed(sig[x:y], doc[x:y])], pa.binary()), pa.array([pairs.get(k, b"")], pa.binary())], names=["k", "runs", "pairs"])

        for b in slices(batches):
            for doc, x, ends in together(b.column(0).to_pylist(), tokens(binary_texts(b.column(1)))):
                _, v, l, c, r = windows_of(x, ends, SALTS[0], LEAST)
                first, end = own_runs(l, c, r)
                h = mix(v) % np.uint64(OPEN_BITS)
                some = (bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)) > 0
                if some.any():
                    depth = np.zeros(len(x) + 1, np.int32)
                    np.add.at(depth, first[some], 1)
                    np.add.at(depth, end[some], -1)
                    at = np.flatnonzero(np.cumsum(depth) > 0)
                    of = np.searchsorted(ends, at, "right") - 1
                    held.append((run_hashes(x)[at], doc[of]))
                    n += len(at)
            if n >= FLUSH:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some, pairs in by_part(batches):
            found = zip(stars(*unpacked(some, ("<u8", "<i8")))[2], unpacked(pairs, PAIR), strict=True)
            both = by_pair(distinct_pairs(*(np.concatenate(x) for x in found)), fewer)
            yield pa.RecordBatch.from_arrays([pa.array(list(both), pa.int64()), pa.array(list(both.values()), pa.binary())], names=["k", "pairs"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pairs in by_part(batches):
            both = distinct_pairs(*unpacked(pairs, PAIR))
            yield from pa.Table.from_arrays([pa.array(x) for x in both], names=["doc", "c_doc"]).to_batches(max_chunksize=100_000)

    fewer = 1 + parts // 8
    rows = map_arrow(docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), text), run, "k long, runs binary, pairs binary")
    rows = map_arrow(rows.repartition("k").sortWithinPartitions("k"), meet, "k long, pairs binary")
    return materialize(map_arrow(rows.repartition("k").sortWithinPartitions("k"), once, "doc long, c_doc long"), "run-pairs")


def window_pairs(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Tables. doc, c_doc (the lesser), for pairs that meet in ENOUGH orders or have a run in common. And g, doc: the documents of each value of
    more than SMALL documents whose surroundings differ, which a star doesn't tell all about."""
    parts = 1 + (docs.agg(F.sum(F.length(text))).first()[0] or 0) // PART
    rows = window_rows(docs, text, parts).repartition("k").sortWithinPartitions("k")
    met = materialize(map_arrow(rows, met_windows, "sig long, doc long, c_doc long, h int, a long, b long, large boolean"), "window-links")
    links = met.where("doc IS NOT NULL")
    grouped = links.groupBy("doc", "c_doc").agg(F.bit_or(F.expr("shiftleft(1, h)")).alias("orders")).where(F.bit_count("orders") >= ENOUGH).select("doc", "c_doc")
    # who meets in ENOUGH orders does in one of the first
    star = links.where(F.col("large") & (F.col("h") <= HASHES - ENOUGH))
    apart = star.groupBy("sig").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("sig")
    members = materialize(star.join(apart, "sig").select(F.col("sig").alias("g"), F.explode(F.array("doc", "c_doc")).alias("doc")).distinct(), "window-groups")
    exact = run_pairs(docs, text, met.where("doc IS NULL").select("sig"), parts)
    out = materialize(grouped.unionByName(exact).distinct(), "passage-pairs")
    free(met, exact)
    return out, members


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The passages of pairs (doc, c_doc), a table: where the other text has enough of the shingles."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            out = []
            texts, others = binary_texts(b.column(2)), binary_texts(b.column(3))
            every = list(dict.fromkeys([*texts, *others]))  # rows come by the earlier document, whose text repeats
            lists = dict(zip(every, tokens(every), strict=True))
            sets = {q: distinct(lists[q]) for q in dict.fromkeys(others)}
            for d, c, p, q, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, others, b.column(4).to_pylist(), strict=True):
                for at, to, share in matched_segments(held_by(lists[p], sets[q]), LEAST, SIMILARITY):
                    out.append((d, c, at, to + WORD_SHINGLE - 1, to + WORD_SHINGLE - 1 - at, share, key))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names=["doc_id", "first_doc_id", "start_word", "end_word", "n_words", "similarity", "text_hash"])

    full = with_texts(pairs, docs, "doc", "c_doc").select("doc", "c_doc", "a_text", "b_text", F.xxhash64("a_text"))
    return map_arrow(full, run, "doc_id long, first_doc_id long, start_word long, end_word long, n_words long, similarity double, text_hash long")


def held_by(x: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted members."""
    if not len(members):
        return np.zeros(len(x), bool)
    return members[np.minimum(np.searchsorted(members, x), len(members) - 1)] == x


#: Of the first LEAST positions of a passage so many are in common at least.
SHARED = -int(-SIMILARITY * LEAST // 1)
#: What is left of a text, which is looked for in others, and a text as a whole, which is looked through.
REST, WHOLE = 0, 1
#: Shingles of a cell, about.
CELL = 200_000
#: Shingles that a task holds before it passes them on by value, in parts of about PART characters of text in all.
HELD, PART = 1 << 20, 12 << 20
#: Bytes of rows that a task gives at once.
BYTES = 4 << 20


def dense_runs(may: np.ndarray) -> np.ndarray:
    """Positions that lie in LEAST in a row of which SHARED may be in common."""
    out = np.zeros(len(may) + 1, np.int32)
    if len(may) >= LEAST:
        total = np.concatenate(([0], np.cumsum(may)))
        at = np.flatnonzero(total[LEAST:] - total[:-LEAST] >= SHARED)
        out[at] += 1
        out[at + LEAST] -= 1
    return np.cumsum(out)[:-1] > 0


def rests(docs: DataFrame, members: DataFrame, found: DataFrame) -> DataFrame:
    """doc, text, gs, spans: the members' texts, their values, and where passages are known, as first and last + 1 positions of shingles."""
    groups = members.groupBy("doc").agg(F.collect_set("g").alias("gs"))
    span = F.struct(F.col("start_word").alias("l"), (F.col("end_word") - WORD_SHINGLE + 1).alias("r"))
    known = found.groupBy(F.col("doc_id").alias("doc"), F.col("text_hash").alias("key")).agg(F.collect_set(span).alias("spans"))
    texts = docs.select(F.col("doc_id").alias("doc"), "text").where("text IS NOT NULL").join(groups, "doc").withColumn("key", F.xxhash64("text"))
    return texts.join(known, ["doc", "key"], "left").select("doc", "text", "gs", "spans")


def members_of(batch) -> Iterator[tuple[int, np.ndarray, list[int], np.ndarray]]:
    """Of a batch of rests() the documents, shingles, values, and the positions that lie in known passages."""
    docs, gs, spans = (batch.column(i).to_pylist() for i in (0, 2, 3))
    for d, x, g, p in zip(docs, tokens(binary_texts(batch.column(1))), gs, spans, strict=True):
        known = np.zeros(len(x), bool)
        for q in p or ():
            known[q["l"] : q["r"]] = True
        yield d, x, g, known


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    """The part that each shingle is in, and 32 of its bits. Parts follow each other in the shingles' order."""
    return dealt(x, parts) << np.uint64(32) | x & np.uint64(0xFFFFFFFF)


def of_owner(x: np.ndarray, owner: int | np.ndarray) -> np.ndarray:
    """Ids of shingles that an owner has, a document or a value."""
    return x ^ mix(np.asarray(owner, np.int64).view(np.uint64))


def has(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a bitmap of token_bitmap() may hold the ids."""
    h = mix(ids) & np.uint64(len(bits) * 64 - 1)
    return (bits.view(np.uint8).take((h >> np.uint64(3)).view(np.int64)) >> (h & np.uint64(7)).astype(np.uint8) & np.uint8(1)) > 0


def met_before(members: DataFrame, parts: int) -> DataFrame:
    """id: of_owner() of each shingle that a text of rests() has outside its known passages and an earlier one has anywhere. A table.

    Shingles go to parts by their values, as arrays: each part has all documents of its shingles.
    """
    import pyarrow as pa

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            docs = np.array([d for d, _, _ in held], np.int64)
            v = part_of(np.concatenate([x for _, x, _ in held]), parts)
            at = np.repeat(np.arange(len(held), dtype=np.uint16), [len(x) for _, x, _ in held]) << np.uint16(1) | np.concatenate([k for _, _, k in held])
            if parts <= 1 << 16:  # part, 32 bits, text and known in one number
                key = np.sort(v << np.uint64(16) | at)
                v, at = key >> np.uint64(16), key.astype(np.uint16)
            else:
                order = np.lexsort((at, v))
                v, at = v[order], at[order]
            of = at >> np.uint16(1)
            new = np.concatenate(([True], (v[1:] != v[:-1]) | (of[1:] != of[:-1])))
            v, at = v[new], at[new]
            ends = np.searchsorted(v, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
            for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                if b > a:
                    cols = [pa.array([k], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (docs, at[a:b], v[a:b].astype(np.uint32)))]
                    yield pa.RecordBatch.from_arrays(cols, names=["k", "docs", "at", "v"])

        for b in slices(batches, 100):
            for d, x, _, known in members_of(b):
                if len(x):
                    held.append((d, x, known))
                    n += len(x)
                if n >= HELD or len(held) >= 1 << 15:
                    yield from out()
                    held, n = [], 0
        if held:
            yield from out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, docs, at, v in by_part(batches):
            docs, at, v = ([np.frombuffer(t, kind) for t in x] for x, kind in ((docs, np.int64), (at, np.uint16), (v, np.uint32)))
            every = distinct(np.concatenate(docs))
            # shingle, document's rank and known in one number
            rank = [np.searchsorted(every, d).astype(np.uint64) << np.uint64(1) for d in docs]
            key = np.sort(np.concatenate([w.astype(np.uint64) << np.uint64(32) | r[i >> np.uint16(1)] | (i & np.uint16(1)) for w, r, i in zip(v, rank, at, strict=True)]))
            value, doc = key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)) >> np.uint64(1)
            later = (doc != doc[runs(value)]) & (key & np.uint64(1) == 0)
            ids = of_owner(np.uint64(part) << np.uint64(32) | value[later], every[doc[later].astype(np.int64)]).view(np.int64)
            for a in range(0, len(ids), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 100_000])], names=["id"])

    rows = map_arrow(members, deal, "k long, docs binary, at binary, v binary")
    return materialize(map_arrow(rows.repartition("k").sortWithinPartitions("k"), meet, "id long"), "met-before")


NODES = "node long, doc long, kind int, n long, t binary, g long"


def _nodes(rows: list[tuple]):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["node", "doc", "kind", "n", "t", "g"])


def _node(kind: int, doc: int, g: int, t: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(t, digest_size=8, key=b"%d,%d,%d" % (kind, doc, g)).digest(), "little", signed=True)


#: The shingle that stands for a value whose texts may have passages of fewer than SHARED distinct shingles.
FEW = np.uint64(1 << 40)


def looked_for(members: DataFrame, parts: int, before: np.ndarray) -> DataFrame:
    """What is looked for: of a text and each of its values the positions that the value's windows reach, a passage's first LEAST counted in, if they lie
    outside known passages and in LEAST in a row of which SHARED are in earlier texts; with known positions near by."""
    import pyarrow as pa

    shared = members.sparkSession.sparkContext.broadcast(before)  # bounded: see token_bitmap()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in slices(batches, 100):
            out = []
            for d, x, gs, known in members_of(b):
                rest = np.flatnonzero(~known)
                rest = rest[dense_runs(has(bits, of_owner(part_of(x[rest], parts), d)))]
                if not len(rest):
                    continue
                left = np.zeros(len(x) + 1, np.int64)
                left[rest + 1] = 1
                total = np.cumsum(left)
                at = np.arange(len(x))
                near = total[np.minimum(at + LEAST, len(x))] > total[np.maximum(at - LEAST, 0)]
                keep = near & known | (left[1:] > 0)
                asked, places = np.array(gs, np.int64), {}
                for h in range(HASHES - ENOUGH + 1):
                    _, v, l, _, r = windows_of(x, np.array([0, len(x)]), SALTS[h], LEAST)
                    end = np.minimum(r + LEAST, len(x))
                    reach = (total[end] > total[l]) & np.isin(v.view(np.int64), asked)
                    for g, i, j in zip(v[reach].view(np.int64).tolist(), l[reach].tolist(), end[reach].tolist(), strict=True):
                        places.setdefault(g, []).append((i, j))
                for g, some in places.items():
                    own = np.zeros(len(x), bool)
                    for i, j in some:
                        own[i:j] = keep[i:j]
                    if own.sum() >= LEAST:
                        t = x[own].astype(np.uint32).tobytes()
                        out.append((_node(REST, d, g, t), d, REST, len(t) // 4, t, g))
            yield _nodes(out)

    return map_arrow(members, run, NODES)


def looked_for_ids(texts: DataFrame) -> DataFrame:
    """id: the shingles of looked_for(), alone and of_owner() of their values, and FEW."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            held = []
            for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = distinct(np.frombuffer(t, np.uint32)).astype(np.uint64)
                held += [v, of_owner(v, g)]
                if 4 * len(v) < len(t):
                    held.append(of_owner(np.array([FEW]), g))
            yield pa.RecordBatch.from_arrays([pa.array(distinct(np.concatenate([*held, np.empty(0, np.uint64)])).view(np.int64))], names=["id"])

    return materialize(map_arrow(texts.select("t", "g"), run, "id long"), "looked-for")


def looked_through(members: DataFrame, ids: np.ndarray) -> DataFrame:
    """Of the texts, for each of their values, the shingles that texts of this value look for."""
    import pyarrow as pa

    shared = members.sparkSession.sparkContext.broadcast(ids)  # bounded: see token_bitmap()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in slices(batches, 100):
            out, size = [], 0
            for d, x, gs, _ in members_of(b):
                v = distinct(x.astype(np.uint32)).astype(np.uint64)
                v = v[has(bits, v)]
                gs = np.array(gs, np.int64)
                few = has(bits, of_owner(FEW, gs))
                if len(v) < SHARED:
                    gs, few = gs[few], few[few]
                step = max(1, (1 << 18) // max(1, len(v)))
                for a in range(0, len(gs) if len(v) else 0, step):
                    held = has(bits, of_owner(v[None, :], gs[a : a + step, None]))
                    n = held.sum(axis=1)
                    for i in np.flatnonzero((n >= SHARED) | few[a : a + step] & (n > 0)).tolist():
                        t, g = v[held[i]].astype(np.uint32).tobytes(), int(gs[a + i])
                        out.append((_node(WHOLE, d, g, t), d, WHOLE, len(t) // 4, t, g))
                        size += len(t)
                        if size >= BYTES:  # long texts have many values
                            yield _nodes(out)
                            out, size = [], 0
            yield _nodes(out)

    return map_arrow(members, run, NODES)


def likely(x_doc, x, x_ends, y_doc, y, y_ends, fewest: bool = False):
    """Pairs (doc, c_doc) of a text x and an earlier one y, where LEAST positions of x have SHARED of them in common with y. With `fewest` only
    those y of which no earlier one here has all the positions in common."""
    known = distinct(x)
    if not len(known) or not len(y):
        return None
    y_of = np.repeat(np.arange(len(y_doc)), np.diff(y_ends))
    y_at = np.minimum(np.searchsorted(known, y), len(known) - 1)
    some = known[y_at] == y
    each = distinct(y_at[some] << 32 | y_of[some])
    y_at, y_of = each >> 32, each & 0xFFFFFFFF  # by places in known
    first = np.searchsorted(y_at, np.arange(len(known) + 1))
    found = []
    for i in range(len(x_doc)):
        own, place = np.unique(x[x_ends[i] : x_ends[i + 1]], return_inverse=True)
        n = len(place)
        if n < LEAST:
            continue
        own = np.searchsorted(known, own)
        count = first[own + 1] - first[own]
        at = np.repeat(first[own], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        of, column = y_of[at], np.repeat(np.arange(len(own)), count)
        need = max(1, SHARED - (n - len(own)))  # a shingle's repeats count once
        may = np.flatnonzero((np.bincount(of, minlength=len(y_doc)) >= need) & (y_doc < x_doc[i]))
        may = may[np.argsort(y_doc[may], kind="stable")]
        row = np.full(len(y_doc), -1)
        row[may] = np.arange(len(may))
        kept = row[of] >= 0
        of, column = row[of[kept]], column[kept]
        order = np.argsort(of.astype(np.uint16) if len(may) < 1 << 16 else of, kind="stable")  # of 16-bit integers: a radix sort
        of, column = of[order], column[order]
        step = max(1, (1 << 21) // n)
        best = np.empty((0, (len(own) + 7) // 8), np.uint8)
        for a in range(0, len(may), step):
            s = slice(*np.searchsorted(of, (a, a + step)))
            hit = np.zeros((min(step, len(may) - a), len(own)), bool)
            hit[of[s] - a, column[s]] = True
            sums = np.zeros((len(hit), n + 1), np.int32)
            np.cumsum(hit[:, place], axis=1, out=sums[:, 1:])
            near = np.flatnonzero((sums[:, LEAST:] - sums[:, :-LEAST] >= SHARED).any(axis=1))
            if fewest:
                packed, rest, near = np.packbits(hit[near], axis=1), near, []
                for k in best:
                    more = (packed & ~k).any(axis=1)
                    packed, rest = packed[more], rest[more]
                while len(rest):
                    near.append(rest[0])
                    k = packed[0]
                    best = np.concatenate((best, k[None]))
                    more = (packed & ~k).any(axis=1)
                    packed, rest = packed[more], rest[more]
            found += [(x_doc[i], y_doc[may[a + j]]) for j in near]
    if not found:
        return None
    return tuple(np.array(c, np.int64) for c in zip(*found, strict=True))


def compared(rows: DataFrame, texts: DataFrame | None = None, fewest: bool = False) -> DataFrame:
    """doc, c_doc: likely() of rows g, node, n, doc, kind, t: every cell of a value's REST texts with every cell of its WHOLE ones, which come once
    for each cell of the other kind. t may be in `texts` (node, t) in place of rows."""
    import pyarrow as pa

    rest = F.col("kind") == REST
    sizes = rows.groupBy("g").agg(*(F.ceil(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)) / CELL).cast("int").alias(c) for k, c in ((REST, "kx"), (WHOLE, "ky"))))
    dealt = rows.join(sizes, "g").where("kx > 0 AND ky > 0")
    if texts is not None:
        dealt = dealt.join(texts.select("node", "t").hint("merge"), "node")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.when(rest, F.col("kx")).otherwise(F.col("ky"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(rest, F.col("ky")).otherwise(F.col("kx")) - 1)))
    dealt = dealt.withColumns({"i": F.when(rest, F.col("own")).otherwise(F.col("other")), "j": F.when(rest, F.col("other")).otherwise(F.col("own"))})
    names = ["g", "i", "j", "kind", "node", "doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, held = [], []  # rows of the last two cells seen, which may go on

        def done(whole: int):
            """Of two cells that end at row `whole`."""
            cut_at = [0, *(np.flatnonzero(np.any([k[1:whole] != k[: whole - 1] for k in cols[:3]], axis=0)) + 1).tolist(), whole]
            for at, to in zip(cut_at[:-1], cut_at[1:], strict=True):
                _, _, _, kind, node, doc = (x[at:to] for x in cols)
                one = np.unique(node, return_index=True)[1]  # repeated ids may have brought a text twice
                a, b = one[kind[one] == REST], one[kind[one] == WHOLE]
                if len(a) and len(b):
                    got = likely(doc[a], *in_order([held[at + k] for k in a]), doc[b], *in_order([held[at + k] for k in b]), fewest)
                    if got is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["doc", "c_doc"])

        for b in slices(batches, 200):
            new = [b.column(k).to_numpy(zero_copy_only=False) for k in range(len(names))]
            cols = [np.concatenate(x) for x in zip(cols, new, strict=True)] if cols else new
            held += b.column(len(names)).to_pylist()
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in cols[:3]], axis=0))
            if len(change):
                last = int(change[-1]) + 1
                yield from done(last)
                cols, held = [x[last:] for x in cols], held[last:]
        if held:
            yield from done(len(held))

    dealt = dealt.select(*names, "t").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    return map_arrow(dealt, run, "doc long, c_doc long")


def in_order(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(lists), np.uint32), np.cumsum([0, *(len(x) // 4 for x in lists)])


def earliest(found: DataFrame) -> DataFrame:
    """Passages but those that lie within one of the same text that a document before theirs has."""
    names = [c for c in found.columns if c not in ("doc_id", "text_hash")]
    own = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(*names)).alias("p"))

    def needed(p):
        return ~F.exists("p", lambda q: (q["first_doc_id"] < p["first_doc_id"]) & (q["start_word"] <= p["start_word"]) & (q["end_word"] >= p["end_word"]))

    return own.select("doc_id", "text_hash", F.inline(F.filter("p", needed))).select(*found.columns)


def repeated_passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, first_doc_id, start_word, end_word (exclusive), n_words, similarity: passages that an earlier document has; and text_hash, which
    tells apart the texts of rows that repeat a doc_id."""
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    pairs, members = window_pairs(one, "text")
    found = materialize(verified(pairs, one), "found")
    whole = materialize(rests(one, members, found), "rests")
    free(members)
    parts = 1 + (whole.agg(F.sum(F.length("text"))).first()[0] or 0) // PART
    before = met_before(whole, parts)
    rest = materialize(looked_for(whole, parts, token_bitmap(before)), "rest-texts")
    free(before)
    ids = looked_for_ids(rest)
    texts = materialize(rest.unionByName(looked_through(whole, token_bitmap(ids))), "texts")
    free(whole, rest, ids)
    near = materialize(compared(texts, fewest=True).distinct(), "likely")
    more = materialize(near.join(pairs, ["doc", "c_doc"], "left_anti"), "more-pairs")
    free(texts, near, pairs)
    return earliest(found.unionByName(verified(more, one)))


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the word spans (first, last + 1), which may overlap."""
    _, start, end = word_hashes(data, spans=True)
    out, at = [], 0
    for a, b in sorted(spans):
        if b > len(start):
            raise ValueError("a span ends beyond the text")
        s, e = int(start[a]), int(end[b - 1])
        if s > at:
            out.append(data[at:s])
        at = max(at, e)
    return b"".join([*out, data[at:]])


def without_passages(docs: DataFrame, passages: DataFrame, text: str = "text", mark: str = "spans") -> DataFrame:
    """docs with the passages taken out of `text`, and the spans of what was taken out in a column `mark`, which docs must not have."""
    import pyarrow as pa

    if mark.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {mark}")
    d, h = free_name([*docs.columns, mark], "d"), free_name([*docs.columns, mark], "h")
    spans = materialize(passages.groupBy(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).agg(F.collect_set(F.struct("start_word", "end_word")).alias(mark)), "spans")
    marked = docs.join(spans, (docs["doc_id"].cast("long") == spans[d]) & (F.xxhash64(docs[text]) == spans[h]), "left").drop(d, h)
    names = marked.columns
    at, of = names.index(text), names.index(mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, found = binary_texts(b.column(at)), b.column(of).to_pylist()
            new = [cut(t, [(s["start_word"], s["end_word"]) for s in f]) if f and t else t for t, f in zip(texts, found, strict=True)]
            yield b.set_column(at, b.schema.field(at), pa.array(new, pa.binary()).cast(pa.string()))

    return map_arrow(marked, run, marked.schema)


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op3_repeated_passages": op3_repeated_passages}
ORACLE_SQL: dict[str, str] = {}
