"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Tokens are words and runs of other marks, lower-cased. The most frequent WORDS of the whole corpus have ids of their own,
the others share hashed ones, whose chance their words have in equal parts. For each position the vectors of the tokens on either side, by
place, are added and squashed; a softmax gives the class of the masked token, and a softmax of the class's own, over the same
squashed values, the token in it. The sum of the conditional log-probabilities over all positions scores the document.

Counts cover all tokens of all documents, and the output biases start from them. Every partition trains its own copy on every position of
each of its documents, from one start, and the copies are averaged by the number of positions, chunk by chunk, in two steps of
streamed sums; so what is gathered grows with the input, and no task or driver holds more than a few models. The weights depend
on how rows lie in partitions; the same rows in the same partitions give the same weights.
Null, empty and blank texts have no tokens and score 0. Repeated rows score alike; an empty table gives no rows. Texts of any length are
scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.llm.common import free, free_name, keep_freed, map_arrow, materialize, slices, table

#: Ids: WORDS of their own, HASHED shared ones, and a pad. Id i is the (i // CLASSES)-th of class i % CLASSES.
CLASSES, EACH, HASHED, HIDDEN = 64, 128, 1024, 16
WORDS = CLASSES * EACH - HASHED
PAD = WORDS + HASHED
IDS = PAD + 1
PLACES = (-3, -2, -1, 1, 2, 3)
EDGE = 3
BATCH, RATE, START = 8192, 0.1, 1e-9
#: Logits between this and its negative have exponentials that sum to finite numbers of 32 bits above 0.
LIMIT = 60
FLUSH = 400_000
#: Tokens that a row of cuts() has, about.
HELD = 1 << 22
CHUNKS = 64
#: Words that an encoder remembers beside the listed ones, and their length at most.
MEMORY, LONGEST = 200_000, 40
TOKEN = re.compile(r"\w+|[^\w\s]+")


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """w, n over all documents. Each task counts first and passes on its sums whenever it holds FLUSH words."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["w", "n"])

        for b in slices(batches):
            for t in b.column(0).to_pylist():
                c.update(tokens_of(t))
            if len(c) > FLUSH:
                yield out()
                c = Counter()
        if c:
            yield out()

    return map_arrow(docs.select(text), run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def cuts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Texts cut into tokens, many in a row: kept, their columns of `keep` as an Arrow stream; words, the distinct tokens, a line each; counts of these;
    lengths, the texts' numbers of tokens; and places, the tokens' places among the words. The last three are 64, 64 and 32-bit integers."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, lengths, places, known, n = [], [], [], defaultdict(), 0
        known.default_factory = known.__len__

        def out():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept[0].schema) as stream:
                for k in kept:
                    stream.write_batch(k)
            at = np.concatenate([*places, np.empty(0, np.uint32)])
            cols = ("\n".join(known).encode(), np.bincount(at, minlength=len(known)).astype(np.int64).tobytes(), np.array(lengths, np.int64).tobytes(), at.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (sink.getvalue().to_pybytes(), *cols)], names=["kept", "words", "counts", "lengths", "places"])

        for b in slices(batches):
            kept.append(b.select(range(b.num_columns - 1)))
            for t in b.column(b.num_columns - 1).to_pylist():
                words = tokens_of(t)
                places.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                lengths.append(len(words))
                n += len(words)
            if n >= HELD or len(known) > FLUSH:
                yield out()
                kept, lengths, places, n = [], [], [], 0
                known.clear()
        if kept:
            yield out()

    return map_arrow(docs.select(*keep, docs[text].alias(free_name(keep, "text"))), run, "kept binary, words binary, counts binary, lengths binary, places binary")


def _lines(words: bytes) -> list[str]:
    return words.decode().split("\n") if words else []


def counts_of_cuts(rows: DataFrame) -> DataFrame:
    """word_counts() of the texts of cuts()."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_lines(words), pa.string()), pa.array(np.frombuffer(counts, np.int64))], names=["w", "n"])

    return map_arrow(rows.select("words", "counts"), run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def encoded_cuts(rows: DataFrame, vocabulary: Vocabulary, kept: T.StructType, name: str = "ids") -> DataFrame:
    """encoded() of the texts of cuts(), whose columns had the schema `kept`: a word is looked up once for all its places."""
    import pyarrow as pa

    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)  # fixed size
    schema = T.StructType([*kept, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.encoder().__getitem__
        for b in batches:
            for columns, words, lengths, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = _lines(words)
                ids = np.fromiter(map(get, words), np.uint16, len(words))[np.frombuffer(places, np.uint32)]
                ends, at = [0, *np.cumsum(np.frombuffer(lengths, np.int64)).tolist()], 0
                for k in pa.ipc.open_stream(columns):
                    own = ends[at : at + k.num_rows + 1]
                    out = [ids[x:y].tobytes() for x, y in zip(own[:-1], own[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([*k.columns, pa.array(out, pa.binary())], names=[f.name for f in schema])
                    at += k.num_rows

    return map_arrow(rows.select("kept", "words", "lengths", "places"), run, schema)


class Vocabulary:
    """Ids of tokens, their counts, and how many words an id stands for."""

    def __init__(self, top: list[tuple[str, int]], total: int, distinct: int | None = None):
        self.ids = {w: i for i, (w, _) in enumerate(top)}
        count = np.full(PAD, 0.5)
        count[: len(top)] += [n for _, n in top]
        count[WORDS:] += max(total - sum(n for _, n in top), 0) / HASHED
        words = np.ones(PAD)
        words[WORDS:] = max(((distinct or 0) - len(top)) / HASHED, 1.0)
        self.counts, self.log_words = count, np.log(words).astype(np.float32)

    def encoder(self):
        """The id of each word, as a mapping that fills as it is asked."""
        return _Ids(self.ids)


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        i = WORDS + zlib.crc32(word.encode("utf-8", "surrogatepass")) % HASHED
        if len(word) <= LONGEST and len(self) < WORDS + MEMORY:
            self[word] = i
        return i


class Network:
    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray | None = None):
        sizes = [(len(PLACES), IDS, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, EACH), (CLASSES, EACH)]
        n = [int(np.prod(s)) for s in sizes]
        fresh = weights is None
        if fresh:
            weights = (np.random.default_rng(11).standard_normal(sum(n)) * 0.1).astype(np.float32)
        self.weights = weights
        self.e, self.b, self.w, self.c, self.v, self.d = (p.reshape(s) for p, s in zip(np.split(weights, np.cumsum(n)[:-1]), sizes, strict=True))
        if fresh:
            count = vocabulary.counts.reshape(EACH, CLASSES).T
            mass = count.sum(axis=1)
            self.c[:] = np.log(mass / mass.sum())
            self.d[:] = np.log(count / mass[:, None])
        self.grad: list[np.ndarray] = []

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """context: ids by place, one column for each position."""
        context = context.astype(np.intp)  # take() converts other integers slowly
        h = self.e[0].take(context[0], axis=0)
        for k in range(1, len(PLACES)):
            h += self.e[k].take(context[k], axis=0)
        h += self.b
        return np.tanh(h, out=h)

    def _plain(self) -> tuple[bool, np.ndarray]:
        """Whether the exponentials of the logits of the class, and of the tokens in each class, sum to finite numbers above 0 as they are, as squashed
        values lie between -1 and 1."""

        def bounded(w, c):
            most = np.abs(w).sum(axis=-2)
            return ((c + most).max(axis=-1) < LIMIT) & ((c - most).max(axis=-1) > -LIMIT)

        return bool(bounded(self.w, self.c)), bounded(self.v, self.d)

    @staticmethod
    def _exp(z: np.ndarray, plain: bool) -> np.ndarray | float:
        """Makes logits their exponentials, and gives what was taken off them before that."""
        top = 0.0
        if not plain:
            top = z.max(axis=1)
            z -= top[:, None]
        np.exp(z, out=z)
        return top

    def log_probabilities(self, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of the ids at the positions, given the ids around them."""
        one = np.ones(max(CLASSES, EACH), np.float32)

        def chosen(z, at, plain):
            own = z[np.arange(len(at)), at]
            top = self._exp(z, plain)
            return own - top - np.log(z @ one[: z.shape[1]])

        h = self.hidden(context)
        plain, each = self._plain()
        kind, place = (ids % CLASSES).astype(np.uint8), (ids // CLASSES).astype(np.int64)
        z = h @ self.w
        z += self.c
        out = chosen(z, kind, plain)
        order, ends = _by_class(kind)
        h, place = h.take(order, axis=0), place[order]
        inside = np.empty(len(ids), np.float32)
        for k, a, b in ends:
            z = h[a:b] @ self.v[k]
            z += self.d[k]
            inside[a:b] = chosen(z, place[a:b], each[k])
        out[order] += inside
        return out

    def learn(self, context: np.ndarray, ids: np.ndarray) -> None:
        """One step of Adagrad."""
        if not self.grad:
            self.grad = [np.full_like(x, START) for x in (self.e, self.b, self.w, self.c, self.v, self.d)]
        one = np.ones(max(CLASSES, EACH, BATCH), np.float32)

        def step(x, s, g):
            s += g * g
            g *= RATE
            g /= np.sqrt(s)
            x -= g

        scale = np.float32(1 / len(ids))

        def off(z, at, plain):
            """From logits, in their place: the probabilities less 1 for the target, times scale."""
            self._exp(z, plain)
            z *= (scale / (z @ one[: z.shape[1]]))[:, None]
            z[np.arange(len(at)), at] -= scale
            return z

        h = self.hidden(context)
        plain, each = self._plain()
        kind, place = (ids % CLASSES).astype(np.uint8), (ids // CLASSES).astype(np.int64)
        p = h @ self.w
        p += self.c
        p = off(p, kind, plain)
        back = p @ self.w.T
        step(self.w, self.grad[2], h.T @ p)
        step(self.c, self.grad[3], one[: len(p)] @ p)
        order, ends = _by_class(kind)
        x, place = np.ones((len(h), HIDDEN + 1), np.float32), place[order]  # the last column is for the biases
        x[:, :-1] = h.take(order, axis=0)
        both = np.concatenate((self.v, self.d[:, None]), axis=1)
        inside, g = np.empty_like(h), np.zeros_like(both)
        for k, a, b in ends:
            q = off(x[a:b] @ both[k], place[a:b], each[k])
            np.matmul(q, self.v[k].T, out=inside[a:b])
            np.matmul(x[a:b].T, q, out=g[k])
        step(self.v, self.grad[4], g[:, :-1])
        step(self.d, self.grad[5], g[:, -1])
        x = np.empty_like(back)
        x[order] = inside
        back += x
        back *= 1 - h * h
        step(self.b, self.grad[1], back.sum(axis=0))
        for k in range(len(PLACES)):
            order = np.argsort(context[k], kind="stable")  # of 16-bit integers: a radix sort
            rows = context[k][order]
            first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            # two numbers at a time, as a complex one: reduceat takes each column by itself
            g, at = np.add.reduceat(back.take(order, axis=0).view(np.complex64), first, axis=0).view(np.float32), rows[first].astype(np.intp)
            s = self.grad[0][k].take(at, axis=0)
            s += g * g
            self.grad[0][k][at] = s
            g *= RATE
            g /= np.sqrt(s, out=s)
            self.e[k][at] -= g


def _by_class(kind: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The positions by class, and of each class that occurs where it begins and ends among them."""
    order = np.argsort(kind, kind="stable")
    ends = np.cumsum(np.bincount(kind, minlength=CLASSES)).tolist()
    return order, [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if b > a]


def positions(texts: list[str | None], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' ids in one array with EDGE pads around each, the places of tokens in it, and the texts' numbers of tokens."""
    pads, stream, n = [PAD] * EDGE, [PAD] * EDGE, []
    get = ids.__getitem__
    for t in texts:
        words = tokens_of(t)
        stream += map(get, words)
        stream += pads
        n.append(len(words))
    stream, n = np.array(stream, np.uint16), np.array(n, np.int64)
    shift = EDGE * (1 + np.arange(len(n)))
    return stream, np.arange(n.sum()) + np.repeat(shift, n), n


def contexts(stream: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([stream[at + p] for p in PLACES])


#: Characters of texts that are encoded together.
TOGETHER = 1 << 19


def _together(texts: list[str | None]) -> Iterator[list[str | None]]:
    few, size = [], 0
    for t in texts:
        few.append(t)
        size += len(t or "")
        if size >= TOGETHER:
            yield few
            few, size = [], 0
    if few:
        yield few


def laid_out(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """positions() of texts whose ids are known."""
    n, pads = np.array([len(x) for x in lists], np.int64), np.full(EDGE, PAD, np.uint16)
    stream = np.concatenate([pads, *(p for x in lists for p in (x, pads))])
    return stream, np.arange(n.sum()) + np.repeat(EDGE * (1 + np.arange(len(n))), n), n


def _streams(column, ids: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """positions() of an Arrow column of texts, or of encoded() ones, some at a time."""
    import pyarrow as pa

    known = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    for few in _together(column.to_pylist()):
        yield laid_out([np.frombuffer(x or b"", np.uint16) for x in few]) if known else positions(few, ids)


def encoded(docs: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",), text: str = "text", name: str = "ids") -> DataFrame:
    """The columns of `keep` and the texts' ids, of 16 bits, as binary column `name`, which train() and score() take in place of texts."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # fixed size
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.encoder().__getitem__
        for b in slices(batches):
            out = [np.fromiter(map(get, words := tokens_of(t)), np.uint16, len(words)).tobytes() for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], names=[f.name for f in schema])

    return map_arrow(docs.select(*keep, docs[text].alias(free_name(keep, "text"))), run, schema)


def train(docs: DataFrame, vocabulary: Vocabulary, text: str) -> np.ndarray:
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        v, n = shared.value, 0
        net, ids = Network(v), v.encoder()
        held, targets, waiting = [], [], 0
        for b in slices(batches):
            for stream, at, _ in _streams(b.column(0), ids):
                held.append(contexts(stream, at))
                targets.append(stream[at])
                waiting += len(at)
                if waiting >= BATCH:
                    x, y = np.concatenate(held, axis=1), np.concatenate(targets)
                    end = len(y) - len(y) % BATCH
                    for a in range(0, end, BATCH):
                        net.learn(x[:, a : a + BATCH], y[a : a + BATCH])
                    n += end
                    held, targets, waiting = [x[:, end:]], [y[end:]], len(y) - end
        if waiting:
            net.learn(np.concatenate(held, axis=1), np.concatenate(targets))
            n += waiting
        if n:
            parts = np.array_split(net.weights.astype(np.float64) * n, CHUNKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([n] * CHUNKS, pa.int64())], names=["chunk", "sums", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        n: Counter = Counter()
        for b in batches:
            for k, s, m in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                x = np.frombuffer(s.as_buffer(), np.float64)
                sums[k] = sums[k] + x if k in sums else x
                n[k] += m
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary()), pa.array([n[k] for k in sums], pa.int64())], names=["chunk", "sums", "n"])

    schema = "chunk int, sums binary, n long"
    parts = map_arrow(docs.select(text), run, schema).withColumn("g", F.spark_partition_id() % 32)
    some = map_arrow(parts.repartition("chunk", "g").select("chunk", "sums", "n"), add, schema)
    rows = sorted(map_arrow(some.repartition("chunk"), add, schema).collect(), key=lambda r: r.chunk)  # one model
    if not rows:
        return Network(vocabulary).weights
    return np.concatenate([np.frombuffer(r.sums, np.float64) / r.n for r in rows]).astype(np.float32)


def scores(net: Network, vocabulary: Vocabulary, ids: dict[str, int], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens and summed conditional log-probabilities of the texts."""
    return _sums(net, vocabulary, *positions(texts, ids))


def _sums(net: Network, vocabulary: Vocabulary, stream: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    logs = np.empty(len(at), np.float64)
    for a in range(0, len(at), BATCH):
        some = at[a : a + BATCH]
        own = stream[some]
        logs[a : a + BATCH] = net.log_probabilities(contexts(stream, some), own) - vocabulary.log_words[own]
    total = np.concatenate(([0.0], np.cumsum(logs)))
    ends = np.cumsum(n)
    return n, total[ends] - total[ends - n]


def score(docs: DataFrame, vocabulary: Vocabulary, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns of `keep`, n_tokens, the summed conditional log-probability and its mean over tokens. No shuffle."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights))  # fixed size
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("pseudo_log_likelihood", T.DoubleType()), T.StructField("mean_log_probability", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        v, net = shared.value[0], Network(*shared.value)
        ids = v.encoder()
        for b in slices(batches):
            found = [_sums(net, v, *some) for some in _streams(b.column(b.num_columns - 1), ids)]
            n, sums = (np.concatenate(x) for x in zip(*found, strict=True))
            mean = pa.array(sums / np.maximum(n, 1), pa.float64(), mask=n == 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), pa.array(sums, pa.float64()), mean], names=[f.name for f in schema])

    return map_arrow(docs.select(*keep, docs[text].alias(free_name(keep, "text"))), run, schema)


def vocabulary_of(docs: DataFrame, text: str = "text") -> Vocabulary:
    return _vocabulary(word_counts(docs, text))


def _vocabulary(counts: DataFrame) -> Vocabulary:
    counts = materialize(counts, "word-counts")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    top = [(r.w, r.n) for r in counts.orderBy(F.desc("n"), "w").limit(WORDS).collect()]
    free(counts)
    return Vocabulary(top, total or 0, distinct)


def fit(docs: DataFrame, text: str = "text") -> tuple[Vocabulary, np.ndarray]:
    v = vocabulary_of(docs, text)
    return v, train(docs, v, text)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = materialize(cuts(docs), "cuts")  # texts are cut into tokens once for counts, training and scores
    v = _vocabulary(counts_of_cuts(cut))
    ids = materialize(encoded_cuts(cut, v, docs.select("doc_id").schema), "ids")
    free(cut)
    return score(ids, v, train(ids, v, "ids"), text="ids")


QUERIES = {"op7_lm_score": op7_lm_score}
ORACLE_SQL: dict[str, str] = {}
