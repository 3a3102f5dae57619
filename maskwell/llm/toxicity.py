"""Toxicity: maximum-scoring segments of token log-odds, aggregated by extreme-value calibration.

Token scores are log-odds between toxic and clean labelled texts under an informative Dirichlet prior (the corpus
distribution), lowered by a drift, so that a clean text's running sum falls; a text counts a word MOST times at most, and words met fewer
than LEAST times have none. MOST, LEAST, the drift and the prior's mass were chosen by cross-validation within the training fold (README). A linear-time scan finds all maximal-scoring segments of a text. The chance of a segment of score s in n tokens
of clean text is 1 - exp(-K n exp(-lambda s)); lambda solves E exp(lambda s) = 1 on clean tokens and K is fitted to the
best segments of clean texts. The significant segments' evidence is summed and mapped to 0..1 by a logistic fit.

The classifier learns from a bounded sample of labelled rows (TRAIN_ROWS, those with the smallest hashes of doc_id)
outside the held-out fold; scoring covers every text whole. Null and empty texts, and texts without words, have no
segments and get the score that this means. Labels, language, source and id are no inputs of a score.
Repeated rows score alike; an empty table gives no rows; without labels of both kinds every score is the base rate.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm.common import free_name, in_train_fold, map_arrow, slices, table

TRAIN_ROWS = 20_000
#: Words of the model at most, the most significant ones, so that its size is bounded.
MODEL_WORDS = 200_000
PRIOR_MASS = 2_000.0
DRIFT = 2.0
MOST, LEAST = 2, 5
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    default: float = -DRIFT
    lam: float = 1.0
    k: float = 0.1
    coef: tuple[float, float, float] = (-3.0, 0.0, 0.0)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def maximal_segments(scores: list[tuple[int, float]], default: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (Ruzzo and Tompa), as (first, last + 1, score).

    scores: positions in order with a score other than `default`, which is negative and holds at every other position.
    """
    held: list[list[float]] = []  # first, last + 1, sum before, sum after
    total, at = 0.0, 0
    for i, s in scores:
        total += default * (i - at)
        at = i + 1
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j -= 1
            if j < 0 or held[j][3] >= new[3]:
                held.append(new)
                break
            new = [held[j][0], new[1], held[j][2], new[3]]
            del held[j:]
    return [(int(a), int(b), r - l) for a, b, l, r in held]


def evidence(model: Model, words: list[str]) -> tuple[float, float, list[tuple[int, int, float]]]:
    """Evidence of the best segment, the sum over significant ones, and these, as (first, last + 1, p-value)."""
    get, default = model.weights.get, model.default
    found = maximal_segments([(i, s) for i, w in enumerate(words) if (s := get(w)) is not None], default)
    noise = math.log(max(model.k * max(len(words), 1), 1e-9))
    strong = [(a, b, model.lam * s - noise) for a, b, s in found]
    best = max((x for _, _, x in strong), default=-noise)
    kept = [(a, b, -math.expm1(-math.exp(-x))) for a, b, x in strong if x > 0]
    return best, sum(x for _, _, x in strong if x > 0), kept


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def score_of(model: Model, best: float, total: float) -> float:
    a, b, c = model.coef
    return logistic(a + b * max(min(best, 50.0), -50.0) + c * math.log1p(total))


def log_odds(counts: list[tuple[str, int, int]], totals: tuple[int, int]) -> dict[str, float]:
    """Per word the log-odds of toxic against clean, shrunk to the corpus distribution."""
    toxic, clean = totals
    every, out = toxic + clean, {}
    for w, t, c in counts:
        a = PRIOR_MASS * (t + c) / every
        delta = math.log((t + a) / (toxic + PRIOR_MASS - t - a)) - math.log((c + a) / (clean + PRIOR_MASS - c - a))
        out[w] = (delta, abs(delta) / math.sqrt(1 / (t + a) + 1 / (c + a)))
    if len(out) > MODEL_WORDS:
        out = {w: out[w] for w in sorted(out, key=lambda w: -out[w][1])[:MODEL_WORDS]}
    return {w: d for w, (d, _) in out.items()}


def solve_lambda(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of E exp(lambda s) = 1; E s is negative and some s positive."""
    low, high = 1e-4, 1.0
    value = lambda x: float((share * np.exp(np.minimum(x * scores, 600))).sum()) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return (low + high) / 2


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton steps with a slight ridge."""
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - 1e-2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def train_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Texts with their labels: at most `rows`, so that their ids can be broadcast; one label for each document."""
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & in_train_fold()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__y"))
    few = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    ids = docs.sparkSession.createDataFrame(few.collect(), "doc_id long, __y int")  # bounded by `rows`
    return docs.select("doc_id", F.col("text").alias("__text")).join(F.broadcast(ids), "doc_id").groupBy("__text").agg(F.max("__y").alias("__y"))  # copies count once


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    import pyarrow as pa

    train = train_rows(docs, labels, rows).repartition(max(2, docs.sparkSession.sparkContext.defaultParallelism))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        n = [0, 0]
        for b in slices(batches):
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, k in Counter(words_of(text)).items():
                    seen.setdefault(w, [0, 0])[y > 0] += min(k, MOST)
                    n[y > 0] += min(k, MOST)
        seen[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], names=["w", "t", "c"])

    sums = map_arrow(train, count, "w string, t long, c long").groupBy("w").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(f"w = '' OR t + c >= {LEAST}")
    got = [(r.w, r.t, r.c) for r in sums.collect()]  # at most a fifth of the sample's words
    totals = next(((t, c) for w, t, c in got if not w), (0, 0))
    if not min(totals):
        return Model()
    counts = [x for x in got if x[0]]
    delta = log_odds(counts, totals)
    model = Model({w: d - DRIFT for w, d in delta.items()})
    clean = {w: c for w, _, c in counts if w in delta}
    rest = totals[1] - sum(clean.values())
    scores = np.array([*(model.weights[w] for w in clean), model.default])
    share = np.array([*clean.values(), rest]) / totals[1]
    if (scores > 0).any() and float((scores * share).sum()) < 0:
        model.lam = solve_lambda(scores, share)

    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, raw, y = [], [], b.column(1).to_pylist()
            for text in b.column(0).to_pylist():
                words = words_of(text)
                found = maximal_segments([(i, s) for i, w in enumerate(words) if (s := model.weights.get(w)) is not None], model.default)
                n.append(len(words))
                raw.append([s for _, _, s in found])
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(raw, pa.list_(pa.float64())), pa.array(y, pa.int32())], names=["n", "s", "y"])

    seen = map_arrow(train, examine, "n long, s array<double>, y int").collect()  # bounded by `rows`
    low = [(r.n, math.exp(-model.lam * max(r.s, default=0.0))) for r in seen if r.y == 0 and r.n]
    model.k = max(len(low) / max(sum(n * e for n, e in low), 1e-9), 1e-9)
    x = []
    for r in seen:
        noise = math.log(max(model.k * max(r.n, 1), 1e-9))
        strong = [model.lam * s - noise for s in r.s]
        x.append((max(min(max(strong, default=-noise), 50.0), -50.0), math.log1p(sum(v for v in strong if v > 0))))
    model.coef = fit_logistic(np.array(x), np.array([float(r.y > 0) for r in seen]))
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", names: tuple[str, str, str] = ("score", "predicted", "segments")) -> DataFrame:
    """The columns of `keep`, the score, the prediction and the significant segments as word positions and p-values, by `names`. No shuffle."""
    import pyarrow as pa
    from pyspark.sql import types as T

    segment = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("p_value", T.DoubleType())]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, k) for n, k in zip(names, (T.DoubleType(), T.IntegerType(), segment), strict=True)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MODEL_WORDS words
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("p_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            values, segments = [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                best, total, kept = evidence(m, words_of(t))
                values.append(score_of(m, best, total))
                segments.append([{"first_word": a, "end_word": e, "p_value": p} for a, e, p in kept])
            v = np.array(values)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(v, pa.float64()), pa.array((v >= 0.5).astype(np.int32)), pa.array(segments, kind)], names=[f.name for f in schema])

    return map_arrow(docs.select(*keep, docs[text].alias(free_name(keep, "text"))), run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).withColumn("held_out", ~in_train_fold()).select("doc_id", "held_out", "score", "predicted", "segments")


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict[str, str] = {}
