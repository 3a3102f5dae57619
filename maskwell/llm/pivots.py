"""Exact top-k inner products by pivot-table elimination.

Vectors are integers. Each carries its distances to a table of pivots. For a query q and a candidate x the largest
|d(q, p) - d(x, p)| over the pivots bounds d(q, x) from below, and with both lengths known this bounds the inner product
from above: <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2. A query starts from the k-th best score among a bounded sample of the candidates,
below which nothing matters. Candidates are dealt to cells by their nearest pivot; of each cell the greatest length and the range of
distances to every pivot are known, so that a query goes to those cells alone whose bound reaches its start. There a few pivots drop most
candidates, the rest of the table drops more, and what is left is evaluated in the order of bounds until the next bound is below the k-th
best score; bounds that equal it are evaluated, for ties. No candidate is dropped but by a bound.

Cells and queries are dealt to blocks of bounded size and each pair of blocks that meets is one group: every task holds two
blocks, whatever the number of rows. Null vectors, and those with null or non-finite components, take no part; shorter
vectors count as padded with zeros. Rows that share the query's id are its own and no candidates. Repeated rows are
candidates each. With fewer candidates than k all are returned; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwell.llm.common import materialize, table

PIVOTS = 48
#: Pivots whose bounds are tried on all candidates of a block, before those of the whole table.
FIRST = 8
PIVOT_SAMPLE = 2000
CANDIDATES = 8192
QUERIES_IN_BLOCK = 1024


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal of a bounded sample: each pivot is the vector farthest from those before."""
    if not len(sample):
        return sample
    far = ((sample - sample.mean(axis=0)) ** 2).sum(axis=1)
    chosen = []
    near = np.full(len(sample), np.inf)
    for _ in range(min(n, len(sample))):
        chosen.append(int(np.argmax(far if not chosen else near)))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if near.max() <= 0:
            break
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def upper_bounds(qq: float, xx: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Of inner products, from squared lengths and lower bounds of distances, with slack for rounding in the distances."""
    return (qq + xx - np.maximum(lower - 1e-6, 0) ** 2) / 2 + 1e-9 * (qq + xx) + 1e-6


def best(q: np.ndarray, own: int, x: np.ndarray, ids: np.ndarray, exact: bool, d: np.ndarray, dx: np.ndarray, qq: float, xx: np.ndarray, k: int, start: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
    """(id, score) of the k best candidates of at least `start` for one query, and how many were evaluated. d, dx: distances to pivots;
    dx has a row for each pivot. exact: doubles hold the sums."""
    rows = np.flatnonzero(ids != own)
    lower = np.zeros(len(rows))
    for at in (slice(0, FIRST), slice(FIRST, None)):
        for column, p in zip(dx[at], d[at], strict=True):
            np.maximum(lower, np.abs(column[rows] - p), out=lower)
        bound = upper_bounds(qq, xx[rows], lower)
        stay = bound >= start
        rows, lower, bound = rows[stay], lower[stay], bound[stay]
        if 2 * len(rows) > len(stay):  # bounds that drop little cost more than products
            break
    order = np.argsort(-bound, kind="stable")
    rows, bound = rows[order], bound[order]
    scores, names = np.empty(0, np.float64 if exact else object), np.empty(0, np.int64)
    at, step = 0, 64
    while at < len(rows):
        if len(scores) == k and bound[at] < scores[-1]:
            break
        some = rows[at : at + step]
        new = x[some] @ q if exact else np.array([sum(int(a) * int(b) for a, b in zip(x[r], q, strict=True)) for r in some], object)
        scores, names = np.concatenate([scores, new]), np.concatenate([names, ids[some]])
        if len(scores) > k and exact:
            high = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            scores, names = scores[high], names[high]
        by = sorted(range(len(scores)), key=lambda i: (-scores[i], names[i]))[:k]
        scores, names = scores[by], names[by]
        at, step = at + step, min(4 * step, 4096)
    return [(int(i), int(s)) for i, s in zip(names, scores, strict=True)], min(at, len(rows))


def top_k(queries: DataFrame, candidates: DataFrame, k: int, pivots: int = PIVOTS, block: int = CANDIDATES, query_block: int = QUERIES_IN_BLOCK, evaluated: bool = False) -> DataFrame:
    """queries, candidates: vec_id long, v array<double> of integers. Gives query_id, rank, vec_id, score. evaluated: instead gives
    query_id, n: how many candidates were evaluated in full."""
    spark = candidates.sparkSession
    n, dim, n_queries = (candidates.agg(F.count("*"), F.max(F.size("v"))).first() or (0, 0)) + (queries.count(),)
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, n long" if evaluated else "query_id long, rank int, vec_id long, score long")
    dim = max(dim, queries.agg(F.max(F.size("v"))).first()[0], 1)
    # the pivots, and the scores to start from, come from a bounded sample; any give exact results
    sample = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()
    points, sample_ids = np.zeros((len(sample), dim)), np.array([r.vec_id for r in sample], np.int64)
    for row, r in zip(points, sample, strict=True):
        row[: len(r.v)] = r.v
    table_of = choose_pivots(points, pivots)
    shared = spark.sparkContext.broadcast((table_of, points, sample_ids))  # at most PIVOT_SAMPLE vectors

    def dense(v: pd.Series) -> np.ndarray:
        out = np.zeros((len(v), dim))
        for row, x in zip(out, v, strict=True):
            row[: len(x)] = x
        return out

    def with_distances(frames):
        for pdf in frames:
            x = dense(pdf["v"])
            d = distances(x, shared.value[0])
            yield pdf.assign(d=list(d), xx=(x**2).sum(axis=1), cell=d.argmin(axis=1).astype(np.int32))

    schema = "vec_id long, v array<double>, d array<double>, xx double, cell int"
    c = materialize(candidates.select("vec_id", "v").mapInPandas(with_distances, schema), "distances")
    m = len(table_of)
    sides = [f(F.col("d")[i]).alias(f"{name}{i}") for i in range(m) for f, name in ((F.min, "a"), (F.max, "z"))]
    stats = c.groupBy("cell").agg(F.count("*").alias("n"), F.max("xx").alias("xx"), *sides).collect()  # a row for each pivot at most
    cells = np.array([r["cell"] for r in stats])
    near, far = (np.array([[r[f"{name}{i}"] for i in range(m)] for r in stats]) for name in "az")
    longest, blocks = np.array([r["xx"] for r in stats]), {r["cell"]: -(-r["n"] // block) for r in stats}
    bounds = spark.sparkContext.broadcast((cells, near, far, longest))

    def reached(frames):
        """Each query with its start and the cells that may hold a score as high."""
        own_cells, low, high, most = bounds.value
        _, some, some_ids = shared.value
        for pdf in frames:
            x = dense(pdf["v"])
            d, xx = distances(x, shared.value[0]), (x**2).sum(axis=1)
            exact = dim * max(np.abs(some).max(), 1) * max(np.abs(x).max(), 1) < 2.0**52
            starts, to = [], []
            for own, v, e, sq in zip(pdf["vec_id"], x, d, xx, strict=True):
                scores = some[some_ids != own] @ v
                start = float(np.partition(scores, len(scores) - k)[len(scores) - k]) if exact and len(scores) >= k else -np.inf
                gap = np.maximum(np.maximum(low - e, e - high), 0).max(axis=1)
                starts.append(start)
                to.append(own_cells[upper_bounds(sq, most, gap) >= start].tolist())
            yield pdf.assign(d=list(d), xx=xx, start=starts, cells=to)

    n_q = -(-n_queries // query_block)
    count = F.element_at(F.create_map(*[F.lit(int(x)) for kv in blocks.items() for x in kv]), F.col("cell"))
    c = c.withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), count).cast("int"))  # repeated ids spread too
    q = queries.select("vec_id", "v").mapInPandas(reached, "vec_id long, v array<double>, d array<double>, xx double, start double, cells array<int>")
    q = materialize(q.withColumn("q", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_q)).cast("int")), "queries")
    q = q.withColumn("cell", F.explode("cells")).withColumn("b", F.explode(F.sequence(F.lit(0), count - 1))).drop("cells")
    # candidates go only to the query blocks that have a query for their cell
    asked = q.select(F.col("cell").alias("to"), F.col("q").alias("of")).distinct()
    c = c.join(asked, F.col("cell") == F.col("to")).drop("to").withColumnRenamed("of", "q").select("q", "cell", "b", "vec_id", "v", "d", "xx")

    def search(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out, counts = [], []
        if len(qs) and len(cs):
            x, y, ids = dense(cs["v"]), dense(qs["v"]), cs["vec_id"].to_numpy()
            columns, dy, xx = np.ascontiguousarray(np.stack(cs["d"].to_list()).T), np.stack(qs["d"].to_list()), cs["xx"].to_numpy()
            exact = dim * max(np.abs(x).max(), 1) * max(np.abs(y).max(), 1) < 2.0**52
            for own, v, d, sq, start in zip(qs["vec_id"], y, dy, qs["xx"], qs["start"], strict=True):
                found, seen = best(v, own, x, ids, exact, d, columns, sq, xx, k, start)
                out += [(own, i, s) for i, s in found]
                counts.append((own, seen))
        if evaluated:
            return pd.DataFrame(counts, columns=["query_id", "n"]).astype("int64")
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    q, c = (df.select(*[F.col(x).alias(x, metadata={"side": side}) for x in df.columns]) for df, side in ((q, "q"), (c, "c")))  # as columns of their own
    groups = q.groupBy("q", "cell", "b").cogroup(c.groupBy("q", "cell", "b"))
    if evaluated:
        return groups.applyInPandas(search, "query_id long, n long").groupBy("query_id").agg(F.sum("n").alias("n"))
    found = groups.applyInPandas(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and floor(256 x) of each component, as doubles; vectors that can't take part are left out."""
    x = F.col(column)
    good = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < math.inf)) & F.col("vec_id").isNotNull()
    return embeddings.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * 256.0).cast("double")).alias("v"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialize(integer_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, 5)


QUERIES = {"op10_top_k": op10_top_k}
ORACLE_SQL = {
    "op10_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
