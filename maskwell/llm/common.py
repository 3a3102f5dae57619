"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes hashed at once, so that temporaries stay near 24 MB whatever the length of a text.
SEGMENT = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, in local mode only."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{os.environ.setdefault('MASKWELL_LOCAL_SHARED', tempfile.mkdtemp(prefix='maskwell-'))}"
    return path.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Lets go of a query's shuffle files as soon as its result is written, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> None:
    """df as Parquet; its shuffle files go when it is done."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)


def materialize(df: DataFrame, what: str = "stage") -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder; its size then is known to the planner. free() deletes it."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    write_table(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes tables of materialize(), on whatever file system they are. Nothing that is still to run may read them."""
    for t in tables:
        spark, path = t.sparkSession, t._table_path
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shrink_executors(spark: SparkSession) -> None:
    """Executors collect their garbage and give the heap that it took back to the system: it else stays as large as the work before made it,
    beside the Python workers of the work that follows. A task for each core, so that each executor that is free has one."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


# ---------------------------------------------------------------- Python workers

#: What a worker process keeps over its tasks: one operator's objects at a time.
_KEPT: dict[str, object] = {}


def kept(owner: str, make):
    """make() of this owner, kept over the tasks of a worker process until another owner's work comes to it."""
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = make()
    return _KEPT[owner]


def drop_others(owner: str | None) -> None:
    for other in [k for k in _KEPT if k != owner]:
        del _KEPT[other]


def give_back() -> None:
    """Freed memory goes back to the system, so that idle workers stay small."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def keep_freed(most: int = 1 << 26) -> None:
    """From now on a worker's freed arrays of up to so many bytes stay for its next ones, until give_back(): else each comes in fresh pages."""
    import ctypes

    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):  # another C library
        return
    mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD, its greatest
    mallopt(-1, most)  # M_TRIM_THRESHOLD


def map_arrow(df: DataFrame, run, schema, owner: str | None = None) -> DataFrame:
    """df.mapInArrow(run, schema) whose workers drop what other owners keep, and give memory back at a task's end."""

    def task(batches: Iterator) -> Iterator:
        drop_others(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def free_name(taken, base: str) -> str:
    """A column name that none of `taken` clashes with, whatever the case."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def in_train_fold(doc_id: str = "doc_id"):
    """True for the rows that a model may learn labels from: crc32(doc_id as text) mod 5 is not 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


# ---------------------------------------------------------------- word and shingle hashes

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWERED = _BYTE[_LOWER]
_POWERS: dict[str, np.ndarray] = {}


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done, step = 1, base
    while done < n:
        m = min(done, n - done)
        with np.errstate(over="ignore"):
            out[done : done + m] = out[:m] * np.uint64(step)
        done += m
        step = step * step % (1 << 64)
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n."""
    if not _POWERS or len(_POWERS["up"]) < n:
        m = 1 << max(20, (n - 1).bit_length())
        _POWERS["up"], _POWERS["down"] = _geometric(_BASE, m), _geometric(pow(_BASE, -1, 1 << 64), m)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of MurmurHash3)."""
    with np.errstate(over="ignore"):
        y = x >> np.uint64(33)
        y ^= x
        y *= np.uint64(0xFF51AFD7ED558CCD)
        y ^= y >> np.uint64(33)
        y *= np.uint64(0xC4CEB9FE1A85EC53)
        y ^= y >> np.uint64(33)
        return y


def _segment_words(buf: np.ndarray, spans: bool):
    gap = np.ones(len(buf) + 2, bool)
    _SPACE.take(buf, out=gap[1:-1], mode="clip")
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start, end
    up, down = _powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, np.uint64)
        values = _LOWERED.take(buf)
        values *= up[: len(buf)]
        np.cumsum(values, out=total[1:])
        h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
    return mix(h), start, end


def word_hashes(data: bytes, spans: bool = False):
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of UTF-8 text, A-Z lower-cased; with spans also byte starts and ends.

    Long texts are hashed a segment at a time, cut at white space.
    """
    parts, at, n = [], 0, len(data)
    while at < n:
        to = min(n, at + SEGMENT)
        if to < n:  # back to white space, or on to the next one
            cut = max(data.rfind(c, at, to) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut <= at:
                later = [p for p in (data.find(c, to) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0]
                cut = min(later, default=n)
            to = cut if cut > at else n
        h, s, e = _segment_words(np.frombuffer(data, np.uint8, to - at, at), spans)
        parts.append((h, s + at, e + at))
        at = to
    if not parts:
        empty = np.empty(0, np.int64)
        return (np.empty(0, np.uint64), empty, empty) if spans else np.empty(0, np.uint64)
    if spans:
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))
    return np.concatenate([p[0] for p in parts])


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of the k words from each position; a shorter sequence gives one hash of all its words, none gives nothing."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += words[i : len(words) - k + 1 + i]
    return mix(out + np.uint64(k))


def shingle_lists(texts: list[bytes | None], k: int = 5) -> Iterator[np.ndarray]:
    """Of each text the hashes of the k words from each position, none where it has fewer words; texts are hashed together, a segment's worth at a time."""
    group, size = [], 0

    def flush():
        n = np.array([len(t or b"") for t in group])
        words, start, _ = word_hashes(b"\n".join(t or b"" for t in group), spans=True)
        edge = np.append(np.searchsorted(start, np.cumsum(n + 1) - n - 1), len(words)).tolist()
        every = shingles(words, k) if len(words) >= k else words[:0]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield every[a : max(a, b - k + 1)]

    for t in texts:
        group.append(t)
        size += len(t or b"")
        if size >= SEGMENT >> 1:
            yield from flush()
            group, size = [], 0
    if group:
        yield from flush()


def shingle_set(data: bytes | None, k: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; null and blank texts have none."""
    return np.unique(shingles(word_hashes(data), k)) if data else np.empty(0, np.uint64)


def _few_sets(texts: list[bytes | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t or b"") for t in texts])
    words, start, _ = word_hashes(b"\n".join(t or b"" for t in texts), spans=True)
    edge = np.append(np.searchsorted(start, np.cumsum(size + 1) - size - 1), len(words))
    n = np.diff(edge)
    place = np.arange(len(words))
    keep = place + k <= np.repeat(edge[1:], n)
    out = np.zeros(len(words), np.uint64)
    if len(words) >= k:
        out[: len(words) - k + 1] = shingles(words, k)
    for d in np.flatnonzero((n > 0) & (n < k)):
        out[edge[d]], keep[edge[d]] = shingles(words[edge[d] : edge[d + 1]], k)[0], True
    out, ends = out[keep], np.concatenate(([0], np.cumsum(np.where(n >= k, n - k + 1, n > 0))))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[ends[:-1][np.diff(ends) > 0]] = True
    return out[new], np.concatenate(([0], np.cumsum(new)))[ends]


def shingle_sets(texts: list[bytes | None], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """shingle_set() of each text, one after the other, and their len(texts) + 1 ends: texts are hashed together, a segment's worth at a time."""
    values, ends, group, size = [], [np.zeros(1, np.int64)], [], 0

    def flush():
        v, e = _few_sets(group, k)
        values.append(v)
        ends.append(e[1:] + ends[-1][-1])

    for t in texts:
        group.append(t)
        size += len(t or b"")
        if size >= SEGMENT >> 1:
            flush()
            group, size = [], 0
    if group:
        flush()
    return (np.concatenate(values) if values else np.empty(0, np.uint64)), np.concatenate(ends).astype(np.int64)


def binary_texts(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes, without decoding."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator, rows: int = 500) -> Iterator:
    """Cuts Arrow batches so that few long texts are alive at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
