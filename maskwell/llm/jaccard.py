"""N-gram Jaccard join on sets of five-word shingles, by token-combination prefixes.

Tokens, here shingles, are in one global order: those that tasks met seldom by hash, then those they met oftener by hash (a bitmap of
bounded size tells which), then frequent ones by count and hash. A document indexes
a prefix of its tokens: single tokens of the rare class, pairs of tokens of the same group of the frequent class. With o the
least overlap that a partner needs (o >= 0.75 n), the prefix goes on until sum over groups max(0, held - k + 1) exceeds
n - o, where k is 1 for rare tokens and 2 for frequent groups; fewer than that many tokens can be missing from a partner,
so that partners share a signature. Groups are as many as an eighth of the size class; a document uses the size classes
that partners can have.

Equal sets are one node. In a bucket of at most SMALL nodes every pair whose sizes allow a link is a candidate: at most SMALL / 2 for
each of its rows. A larger bucket is spanned by a star, within each task before the shuffle and then over tasks. Before texts are
fetched for a candidate, bitmaps of its sets, of 8 to 16 bits a shingle, bound its overlap from above; the rest are verified,
and components found. A large bucket is done if its star lies in one component. The nodes of the others are dealt to cells of about
CELL shingles, and every two cells of a bucket are compared with whole arrays that count the shingles in common exactly; only links
between different components come out. Links join components exactly as all pairs would.

At last each component is dealt to cells in the same way and its links are counted, those inside a component of thousands of near
copies too, without a row for each: n_links is the number of other documents that a document links to, copies included.
That work grows with the square of a component's distinct texts, spread over tasks; copies of one text count as one.

Null, empty and blank texts have no shingles, link with nothing and are their own component; texts with fewer than five
words have one shingle. A null doc_id takes no part and has a null component. Rows that repeat an id count each.
Texts of any length are taken whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm.common import binary_texts, free, map_arrow, materialize, mix, shingle_sets, slices, table
from maskwell.llm.pairs import bitmap, components, may_hold, runs, with_texts

#: A token is frequent if it is in FREQUENT of the distinct sets, and in LEAST at least, not counting windows of a task where less than SOME have it.
FREQUENT, LEAST, SOME = 0.002, 24, 2
#: The map of tokens that were met MET times or more so: bits for each, and bits at least and at most (32 MB to broadcast). Where it fills
#: up at size, more tokens count as met often, in the end all, and their order is by hash alone.
MET, BITS_EACH, BITS = 4, 8, (1 << 20, 1 << 28)
#: Signatures that a task holds, and tokens whose counts it holds.
FLUSH, WINDOW = 1_000_000, 4_000_000
#: Buckets of up to so many nodes give all their pairs as candidates; larger ones give a star.
SMALL = 16
#: Shingles in a cell, about; shingles of so many nodes of a cell are counted by products of dense columns.
CELL, DENSE, COLUMNS = 400_000, 16, 2048


def set_ids(values: np.ndarray, ends: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, whatever its order."""
    out = []
    with np.errstate(over="ignore"):
        for x in (values + np.uint64(2 * seed + 1), values ^ np.uint64(0xA5A5A5A5A5A5A5A5)):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(x), dtype=np.uint64)))
            out.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
    return out[0], out[1]


def sketch(s: np.ndarray) -> bytes:
    """A bitmap of the set, of 8 to 16 bits for each member: a power of two, so that halves fold."""
    m = max(128, 1 << (8 * max(len(s), 1) - 1).bit_length())
    bits = np.zeros(m, np.uint8)
    bits[(mix(s ^ np.uint64(0x5DEECE66D)) & np.uint64(m - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> int:
    """An upper bound of the overlap of two sets of nx and ny members from their bitmaps: bits in common, and members beyond one a bit."""
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    both, px, py = (int(np.bitwise_count(b).sum()) for b in (x & y, x, y))
    return min(both + min(nx - px, ny - py), nx, ny)


def met_often(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The values that SOME of the arrays at least have, and how many. Empties `held`, and takes twice its memory at most."""
    t = np.concatenate(held)
    held.clear()
    t.sort()
    few = t[SOME - 1 :] == t[: max(0, len(t) - SOME + 1)]
    few[1:] &= t[1 : len(few)] != t[: max(0, len(few) - 1)]  # where a value begins
    at = np.flatnonzero(few)
    return t[at], np.searchsorted(t, t[at], "right") - at


def sets(docs: DataFrame, text: str, seed: int) -> DataFrame:
    """kind 0: a document (id, n, d1, d2, sketch). kind 1: a token (id) that n sets of a task's window have, if SOME have it."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()

        def frequent():
            t, c = met_often(held)
            k = len(t)
            return pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.array(t.view(np.int64)), pa.array(c), pa.array([0] * k, pa.int64()), pa.array([0] * k, pa.int64()), pa.nulls(k, pa.binary())], names=names)

        names = ["kind", "id", "n", "d1", "d2", "sketch"]
        for b in slices(batches):
            values, ends = shingle_sets(binary_texts(b.column(1)))
            d1, d2 = set_ids(values, ends, seed)
            maps = []
            for d, at, to in zip(d1.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                s = values[at:to]
                maps.append(sketch(s) if to - at > 2 else None)
                if to > at and d not in seen:
                    seen.add(d)
                    held.append(s.copy())
                    n += to - at
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(d1), np.int32)), b.column(0).cast(pa.int64()), pa.array(np.diff(ends)), pa.array(d1), pa.array(d2), pa.array(maps, pa.binary())], names=names)
            if n >= WINDOW:
                yield frequent()
                n, seen = 0, set()
        if held:
            yield frequent()

    return map_arrow(docs.select("doc_id", text), run, "kind int, id long, n long, d1 long, d2 long, sketch binary")


def _groups(n: int) -> int:
    """Groups of the frequent class in the size class 2**level that n is in."""
    return max(1, 1 << max(0, n.bit_length() - 4))


def signatures(values: np.ndarray, ends: np.ndarray, common: np.ndarray, rank: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
    """The signatures of each set. common: sorted frequent tokens, rank: their places in the order; bits: see token_bitmap()."""
    at = np.minimum(np.searchsorted(common, values), len(common) - 1) if len(common) else np.zeros(len(values), np.int64)
    often = common[at] == values if len(common) else np.zeros(len(values), bool)
    mixed = mix(values)  # the order of rare tokens, apart from the hash's order in the set; it stands for them
    h = mixed & np.uint64(len(bits) * 64 - 1)
    mixed = mixed >> np.uint64(1) | (bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)) << np.uint64(63)
    out = []
    for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        n = j - i
        if n < 3:  # partners of so few tokens are equal
            out.append(values[:0])
            continue
        missing = n - (3 * n + 3) // 4
        rare = np.sort(mixed[i:j][~often[i:j]])
        if len(rare) > missing:
            out.append(rare[: missing + 1])
        else:
            own = often[i:j]
            rest = values[i:j][own][np.argsort(rank[at[i:j][own]], kind="stable")]
            out.append(np.concatenate([rare, *_combined(n, missing + 1 - len(rare), rest)]))
    return out


def _combined(n: int, need: int, rest: np.ndarray) -> list[np.ndarray]:
    """Pairs of frequent tokens, in the global order, that a set of n tokens indexes beside all its rare ones."""
    out = []
    for g in sorted({_groups(m) for m in ((3 * n + 3) // 4, n, 4 * n // 3)}):
        group = (mix(rest + np.uint64(g)) % np.uint64(g)).astype(np.int64)
        order = np.argsort(group, kind="stable")  # stays in the global order within a group
        place = np.arange(len(rest)) - np.searchsorted(group[order], group[order])
        held = np.empty(len(rest), np.int64)
        held[order] = place  # tokens of its group before it
        end = int(np.searchsorted(np.cumsum(held > 0), need)) + 1
        inside = order < end
        x, before = rest[order[inside]], place[inside]
        later = np.repeat(np.arange(len(x)), before)  # each token with all those of its group before it
        first = later - np.repeat(before, before) + np.arange(len(later)) - np.repeat(np.cumsum(before) - before, before)
        lo, hi = np.minimum(x[first], x[later]), np.maximum(x[first], x[later])
        with np.errstate(over="ignore"):
            out.append(mix(mix(lo + np.uint64(g)) + hi * np.uint64(0x9E3779B97F4A7C15)))
    return out


def signature_rows(docs: DataFrame, text: str, seed: int, order: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """sig, node, its set's size n, big, and the node that the task has for the signature already (null: none).

    Of a signature that a task meets with more than SMALL nodes the first row is marked big, and the others come with its node: they
    need no shuffle.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(order)  # bounded: see token_order()

    def out(sig, node, n):
        with np.errstate(over="ignore"):
            sig = np.concatenate(sig).view(np.int64)
        node, n = np.concatenate(node), np.concatenate(n)
        order = np.lexsort((node, sig))
        sig, node, n = sig[order], node[order], n[order]
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
        sig, node, n = sig[new], node[new], n[new]
        first = runs(sig)
        big = np.bincount(first, minlength=len(first))[first] > SMALL
        center = pa.array(node[first], pa.int64(), mask=~big | (first == np.arange(len(first))))
        for at in range(0, len(sig), 100_000):
            s = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(sig[s]), pa.array(node[s]), pa.array(n[s]), pa.array(big[s]), center.slice(at, 100_000)], names=["sig", "node", "n", "big", "center"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank, bits = shared.value
        sig, node, size, n, seen = [], [], [], 0, set()
        for b in slices(batches):
            values, ends = shingle_sets(binary_texts(b.column(0)))
            ids = set_ids(values, ends, seed)[0].tolist()
            for k, x, m in zip(ids, signatures(values, ends, common, rank, bits), np.diff(ends).tolist(), strict=True):
                if not len(x) or k in seen:
                    continue
                seen.add(k)
                sig.append(x)
                node.append(np.full(len(x), k, np.int64))
                size.append(np.full(len(x), m, np.int32))
                n += len(x)
            if n >= FLUSH:
                yield from out(sig, node, size)
                sig, node, size, n, seen = [], [], [], 0, set()
        if n:
            yield from out(sig, node, size)

    return map_arrow(docs.where(F.col("doc_id").isNotNull()).select(text), run, "sig long, node long, n int, big boolean, center long")


def _pairs(sig: np.ndarray, node: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a signature's nodes whose sizes allow a link, each once."""
    out = []
    for d in range(1, SMALL):
        same = np.flatnonzero(sig[d:] == sig[:-d])
        if not len(same):
            break
        x, y = same, same + d
        ok = (4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y])) & (node[x] != node[y])
        out.append(np.stack([np.minimum(node[x], node[y])[ok], np.maximum(node[x], node[y])[ok]]))
    both = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
    both = both[:, np.lexsort(both[::-1])]
    new = np.ones(both.shape[1], bool)
    new[1:] = (both[:, 1:] != both[:, :-1]).any(axis=0)
    return both[0][new], both[1][new]


def bucket_pairs(batches: Iterator) -> Iterator:
    """From rows (sig, node, n, big) in order of sig, big ones first: pairs (a, b) of small buckets with a null sig, stars of large ones with theirs.

    A bucket's rows may go on over batches: of a large one only the first is remembered, of a small one at most SMALL.
    """
    import pyarrow as pa

    def arrays(cols, last: bool):
        """The rows to keep for the next call, and a batch."""
        sig, node, n, big = cols
        first = runs(sig)
        size = np.bincount(first, minlength=len(sig))[first]
        large = (size > SMALL) | big[first]
        end = len(sig) if last else int(first[-1])  # the last bucket may go on
        small = np.flatnonzero(~large[:end])
        a, b = _pairs(sig[small], node[small], n[small])
        star = np.flatnonzero(large & (node != node[first]))  # those of the last bucket too, if it is large already
        x, y = node[first[star]], node[star]
        sigs = pa.array(np.concatenate([np.zeros(len(a), np.int64), sig[star]]), mask=np.arange(len(a) + len(star)) < len(a))
        batch = pa.RecordBatch.from_arrays([sigs, pa.array(np.concatenate([a, np.minimum(x, y)])), pa.array(np.concatenate([b, np.maximum(x, y)]))], names=["sig", "a", "b"])
        held = [c[end:] for c in cols]
        if len(held[0]) and large[-1]:
            held = [c[:1].copy() for c in held]
            held[3][:] = True
        return held, batch

    held: list[np.ndarray] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        held, batch = arrays([np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols, False)
        if batch.num_rows:
            yield batch
    if held and len(held[0]):
        yield arrays(held, True)[1]


def candidates(rows: DataFrame) -> DataFrame:
    """signature_rows() as a table of bucket_pairs(), with the tasks' own stars."""
    dealt = rows.where("center IS NULL").select("sig", "node", "n", "big").repartition("sig").sortWithinPartitions("sig", F.desc("big"), "node")
    over = map_arrow(dealt, bucket_pairs, "sig long, a long, b long")
    own = rows.where("center IS NOT NULL").select("sig", F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b"))
    return over.unionByName(own)


def token_order(rows: DataFrame, n_sets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The frequent tokens by token and their places in the order of counts, and a bitmap of all tokens of kind 1.

    Frequent ones have counts of FREQUENT * n_sets over all tasks, so that they number at most the mean set size over FREQUENT,
    whatever the number of documents and sources.
    """
    sums = materialize(rows.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")), "tokens")
    got = sums.where(F.col("n") >= max(LEAST, FREQUENT * n_sets)).collect()
    t = np.array([r.id for r in got], np.int64).view(np.uint64)
    n = np.array([r.n for r in got], np.int64)
    by = np.argsort(t)
    t, n = t[by], n[by]
    rank = np.empty(len(t), np.int64)
    rank[np.lexsort((mix(t), n))] = np.arange(len(t))
    bits = token_bitmap(sums.where(F.col("n") >= MET))
    free(sums)
    return t, rank, bits


def token_bitmap(tokens: DataFrame) -> np.ndarray:
    """A bitmap, as 64-bit words, with the tokens `id`."""
    import pyarrow as pa

    size = min(max(1 << (BITS_EACH * tokens.count()).bit_length(), BITS[0]), BITS[1])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.sort(mix(b.column(0).to_numpy().view(np.uint64)) & np.uint64(size - 1))
            if len(h):
                w = (h >> np.uint64(6)).astype(np.int64)
                at = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(w[at]), pa.array(np.bitwise_or.reduceat(np.uint64(1) << (h & np.uint64(63)), at).view(np.int64))], names=["w", "bits"])

    out = np.zeros(size // 64, np.int64)
    got = map_arrow(tokens.select("id"), words, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most size / 64 rows
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def measured(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Of candidates (a, b) those that link, as a table."""
    import pyarrow as pa

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            na, nb = b.column(4).to_pylist(), b.column(5).to_pylist()
            x, y = (b.column(i).to_pylist() for i in (6, 7))
            keep = []
            for p, q, m, n in zip(x, y, na, nb, strict=True):
                shared = most_shared(np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8), m, n)
                keep.append(100 * shared >= 75 * (m + n - shared))
            yield b.select(["a", "b", "ra", "rb"]).filter(pa.array(keep, pa.bool_()))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            a_ids, b_ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            texts = dict(zip(a_ids, binary_texts(b.column(2)), strict=True)) | dict(zip(b_ids, binary_texts(b.column(3)), strict=True))
            values, ends = shingle_sets(list(texts.values()))
            known = {k: values[i:j] for k, i, j in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)}
            keep = []
            for x, y in zip(a_ids, b_ids, strict=True):
                both = len(np.intersect1d(known[x], known[y], assume_unique=True))
                keep.append(100 * both >= 75 * (len(known[x]) + len(known[y]) - both) and both > 0)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    c = nodes.select("node", "rep", "n", "sketch")
    near = pairs.join(c.toDF("a", "ra", "na", "x"), "a").join(c.toDF("b", "rb", "nb", "y"), "b").where("4 * least(na, nb) >= 3 * greatest(na, nb)")
    near = map_arrow(near.select("a", "b", "ra", "rb", "na", "nb", "x", "y"), bound, "a long, b long, ra long, rb long")
    may = materialize(near, "may-link")
    full = with_texts(may, docs, "ra", "rb", text)
    out = materialize(map_arrow(full.select("a", "b", "a_text", "b_text"), verify, "a long, b long").distinct(), "links")
    free(may)
    return out


# ---------------------------------------------------------------- cells


def overlaps(values: np.ndarray, ends: np.ndarray, left: int) -> np.ndarray:
    """Sizes of the intersections of the first `left` sets with the others, or, if there are no others, with each other."""
    g = len(ends) - 1
    same = left == g
    out = np.zeros((left, left if same else g - left), np.int32)
    owner = np.repeat(np.arange(g, dtype=np.int32), np.diff(ends))
    order = np.argsort(values, kind="stable")
    v, o = values[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(v)))
    # shingles that few sets have: their pairs, at most DENSE / 2 for each place
    few = np.repeat((count > 1) & (count < DENSE), count)
    fv, fo = v[few], o[few]
    for d in range(1, DENSE - 1):
        at = np.flatnonzero(fv[d:] == fv[:-d])
        if not len(at):
            break
        x, y = fo[at], fo[at + d]  # ascending, as the sort is stable
        if not same:
            across = (x < left) & (y >= left)
            x, y = x[across], y[across] - left
        np.add.at(out, (x, y), 1)
    # shingles that many have: products of dense columns
    many = np.flatnonzero(count >= DENSE)
    for at in range(0, len(many), COLUMNS):
        some = many[at : at + COLUMNS]
        n = count[some]
        places = np.repeat(first[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        column = np.zeros((g, len(some)), np.float32)
        column[o[places], np.repeat(np.arange(len(some)), n)] = 1
        out += ((np.triu(column @ column.T, 1)) if same else column[:left] @ column[left:].T).astype(np.int32)
    return out + out.T if same else out


def linked(values: np.ndarray, ends: np.ndarray, left: int) -> np.ndarray:
    """Which of the first `left` sets link with which of the others, or of themselves."""
    n = np.diff(ends)
    x, y = n[:left, None], (n if left == len(n) else n[left:])[None, :]
    both = overlaps(values, ends, left)
    return (both > 0) & (100 * both.astype(np.int64) >= 75 * (x + y - both))


def in_cells(rows: DataFrame, docs: DataFrame, text: str, emit, schema: str, read=shingle_sets) -> DataFrame:
    """rows: g, node, rep, n, c, copies. Every two cells of a group g go through emit(node, c, copies, values, ends, left), as arrays,
    with the nodes of the one cell before those of the other; it gives Arrow columns of `schema`. read: values and ends of texts.
    """
    import pyarrow as pa

    sizes = rows.groupBy("g").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("k"))
    ids = rows.select("rep").distinct()
    held = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("rep"), F.col(text).alias("t")).where(may_hold(bitmap(ids, "rep"), "rep"))
    dealt = rows.join(sizes, "g").join(held.hint("merge"), "rep").withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumns({"p": F.least("i", "j"), "q": F.greatest("i", "j")})
    names = ["g", "p", "q", "i", "node", "c", "copies"]
    out_names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, texts = [], []  # rows of the last group seen, which may go on

        def done(whole: int):
            """The groups that end at row `whole`; none if that is 0."""
            cut = np.flatnonzero(_changes(cols[:3])[:whole]).tolist()
            for at, to in zip(cut, [*cut[1:], whole][: len(cut)], strict=True):
                g, p, q, i, node, c, copies = (x[at:to] for x in cols)
                _, one = np.unique(np.stack([i, node]), axis=1, return_index=True)  # repeated ids may have brought a text twice
                one = one[np.argsort(i[one] != p[0], kind="stable")]
                left = int((i[one] == p[0]).sum())
                if p[0] != q[0] and left in (0, len(one)):  # one of the two cells is empty
                    continue
                values, ends = read([texts[at + k] for k in one])
                got = emit(node[one], c[one], copies[one], values, ends, left)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=out_names)

        for b in slices(batches, 200):
            new = [b.column(k).to_numpy(zero_copy_only=False) for k in range(len(names))]
            cols = [np.concatenate(x) for x in zip(cols, new, strict=True)] if cols else new
            texts += binary_texts(b.column(len(names)))
            last = int(np.flatnonzero(_changes(cols[:3]))[-1])
            if last:
                yield from done(last)
                cols, texts = [x[last:] for x in cols], texts[last:]
        if texts:
            yield from done(len(texts))

    dealt = dealt.select(*names, "t").repartition("g", "p", "q").sortWithinPartitions("g", "p", "q")
    return map_arrow(dealt, run, schema)


def _changes(keys: list[np.ndarray]) -> np.ndarray:
    """True for each row whose keys differ from those of the row before; the first does."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def across_components(node, c, copies, values, ends, left):
    """Links (a, b) between nodes of different components."""
    n = len(node)
    x, y = np.nonzero(linked(values, ends, left) & (c[:left, None] != (c if left == n else c[left:])[None, :]))
    y = y if left == n else y + left
    if not len(x):
        return None
    return np.minimum(node[x], node[y]), np.maximum(node[x], node[y])


def links_counted(node, c, copies, values, ends, left):
    """node and the documents of the other cell, or its own, that link to it."""
    n = len(node)
    link = linked(values, ends, left)
    if left == n:
        return node, link @ copies
    return node, np.concatenate([link @ copies[left:], copies[:left] @ link])


def near_duplicates(docs: DataFrame, text: str = "text", links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links reach; and with `links` n_links, the other documents that link to it."""
    for seed in range(8):
        rows = materialize(sets(docs, text, seed), "sets")
        nodes = rows.where("kind = 0 AND n > 0 AND id IS NOT NULL").groupBy(F.col("d1").alias("node")).agg(
            F.min("id").alias("rep"), F.max("n").alias("n"), F.min("d2").alias("x"), F.max("d2").alias("y"), F.min("n").alias("m"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")
        )
        nodes = materialize(nodes, "nodes")
        if nodes.where("x <> y OR m <> n").isEmpty():
            break
        free(rows, nodes)  # two sets share a digest: take another
    else:
        raise RuntimeError("sets share digests under every seed")
    order = token_order(rows, nodes.count())
    found = materialize(candidates(signature_rows(docs, text, seed, order)), "candidates")
    pairs = materialize(found.select("a", "b").distinct(), "pairs")
    known = measured(pairs, nodes, docs, text)
    free(pairs)
    labels = components(known)
    # large buckets whose star isn't in one component yet: all their nodes, by the least one of the bucket
    star = found.where("sig IS NOT NULL")
    la, lb = labels.toDF("a", "ca"), labels.toDF("b", "cb")
    apart = star.join(la, "a", "left").join(lb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("sig").distinct()
    least = star.join(apart, "sig").select("sig", "a", "b")
    least = materialize(least, "open")
    center = least.groupBy("sig").agg(F.min("a").alias("g"))
    members = least.join(center, "sig").select("g", F.explode(F.array("a", "b")).alias("node")).distinct()
    of = nodes.select("node", "rep", "n", "copies").join(labels, "node", "left").select("node", "rep", "n", "copies", F.coalesce("label", "node").alias("c"))
    of = materialize(of, "labelled")
    members = materialize(members.join(of, "node"), "members")
    free(least, found)
    more = materialize(in_cells(members, docs, text, across_components, "a long, b long").distinct(), "across")
    free(members)
    if not more.isEmpty():
        free(labels, of)
        labels = components(known.unionByName(more))
        of = materialize(nodes.select("node", "rep", "n", "copies").join(labels, "node", "left").select("node", "rep", "n", "copies", F.coalesce("label", "node").alias("c")), "labelled")
    free(known, more, nodes)
    counted = None
    if links:
        inside = of.where("c <> node").select("c").distinct()
        several = materialize(of.join(inside, "c").withColumn("g", F.col("c")), "several")
        counted = materialize(in_cells(several, docs, text, links_counted, "node long, n long").groupBy("node").agg(F.sum("n").alias("links")), "links")
        free(several)
    least = of.groupBy("c").agg(F.min("rep").alias("component_id"))
    of_all = of.join(least, "c")
    of_all = of_all.join(counted, "node", "left") if links else of_all.withColumn("links", F.lit(0))
    whole = materialize(of_all.select(F.col("node").alias("d1"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "components")
    free(of, labels, *([counted] if links else []))
    out = rows.where("kind = 0").drop("sketch").join(whole, "d1", "left")
    known_id, some = F.col("id").isNotNull(), F.col("n") > 0
    component = F.when(known_id, F.when(some, F.col("component_id")).otherwise(F.col("id")))
    counts = [F.when(known_id, F.when(some, F.col("n_links")).otherwise(F.lit(0))).cast("long").alias("n_links")] if links else []
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), *counts)
    out._tables = rows, whole  # for free(), by who has written what they need of it
    return out


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_ngram_jaccard": op4_ngram_jaccard}
ORACLE_SQL: dict[str, str] = {}
