"""Parts that joins on pairs of documents share: stars over signatures, texts for pairs, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.llm.common import free, map_arrow, materialize

BITMAP_WORDS = 1 << 14


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """A bitmap of fixed size with the keys' hashes: a filter that lets every key pass, and fewer others the fewer keys there are."""
    h = F.xxhash64(key)
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), 64) as int))")
    words = np.zeros(BITMAP_WORDS, np.int64)
    for r in keys.groupBy(F.pmod(F.shiftrightunsigned(h, 6), F.lit(BITMAP_WORDS)).alias("w")).agg(F.bit_or(bit).alias("b")).collect():  # at most BITMAP_WORDS rows
        words[r.w] = r.b
    return words


def may_hold(words: np.ndarray, key: str) -> Column:
    bits = F.expr(f"cast(split('{','.join(map(str, words))}', ',') as array<bigint>)")
    at = (F.pmod(F.shiftrightunsigned(F.xxhash64(key), 6), F.lit(BITMAP_WORDS)) + 1).cast("int")
    return F.element_at(bits, at).bitwiseAND(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), 64) as int))")) != 0


def with_texts(pairs: DataFrame, docs: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """pairs, a table of materialize(), with a_text and b_text. Only texts that a pair may need are shuffled; a hot side is split by the skew join."""
    ids = pairs.select(F.explode(F.array(a, b)).alias("k")).distinct()
    held = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("k"), F.col(text).alias("t")).where(may_hold(bitmap(ids, "k"), "k"))
    one = held.select(F.col("k").alias(a), F.col("t").alias("a_text")).hint("merge")
    two = held.select(F.col("k").alias(b), F.col("t").alias("b_text")).hint("merge")
    return pairs.join(one, a).join(two, b)


def runs(keys: np.ndarray) -> np.ndarray:
    """For each row of sorted keys the index of the first row with its key."""
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    return np.flatnonzero(first)[np.cumsum(first) - 1]


def star_batches(batches: Iterator, names: list[str], columns: int) -> Iterator:
    """Rows sorted by their first column, as a stream: each row but the first of its run comes out with the first's other columns after its own."""
    import pyarrow as pa

    last: list | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if last is not None and last[0] == cols[0][0]:  # the run goes on from the batch before
            cols = [np.concatenate(([v], c)).astype(c.dtype) for v, c in zip(last, cols, strict=True)]
        first = runs(cols[0])
        rows = np.flatnonzero(first != np.arange(len(first)))
        last = [c[first[-1]] for c in cols]
        if len(rows):
            out = [c[rows] for c in cols] + [c[first[rows]] for c in cols[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)


#: Edges that a task thins out, about.
EDGES = 200_000


def forest(edges: DataFrame) -> DataFrame:
    """Of the edges (a, b), a table, those that join what a task's edges before didn't: they connect the same nodes, and a group of near copies has
    about as many as nodes for each task, not as many as its links."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for b in batches:
            keep = []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                keep.append(x != y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            yield b.filter(pa.array(keep, pa.bool_()))

    return map_arrow(edges.select("a", "b").coalesce(1 + edges.count() // EDGES), run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node connected to each node of the edges (a, b), by least labels of neighbours and pointer jumping.

    Edges are thinned out to forests first. Every round reads and writes tables in the shared folder; its joins have tables on either side, so that hot nodes are split.
    """
    edges = forest(edges)
    both = materialize(edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b"), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("m"))
        lower = materialize(labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "labels")
        free(labels)
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = materialize(lower.join(up, "label", "left").select("node", "old", F.least("label", "up").alias("label")), "labels")
        free(lower)
        labels = jumped.select("node", "label")
        labels._table_path = jumped._table_path
        if jumped.where("old <> label").isEmpty():
            free(both)
            return labels
