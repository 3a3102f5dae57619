"""Token-id files of fixed-width bit-packed ids.

A file is a run of frames. A frame holds, all little-endian: the magic `MWI1`, bits per id (u32), ids per block (u32),
documents (u32), ids (u64), bytes of packed data (u64); then for each document its id (i64) and number of ids (u64); then
the byte offset of each block in the packed data (u64); then the packed data; then one line feed. Each id takes the
fewest bits that hold the vocabulary, least significant bit first. A block starts on a byte, so any id is found from
its block's offset without reading what comes before, and a block is unpacked with whole-array operations.

Frames are written through Spark's own text sink (a frame is a record, the line feed its end), so that tasks commit
atomically on any Hadoop file system and a lost executor's tasks simply run again. Files are read with the binaryFile source.

Rows come in ascending doc_id order over all files. A null text is empty and has only the end id. A null doc_id comes
first and stays null. Repeated ids are repeated documents. A document is never split, so a frame is as long as its
longest document at least.
"""

from __future__ import annotations

import gc
import struct
import zlib
from collections.abc import Iterator
from itertools import count, islice
from unicodedata import normalize

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwell.llm.common import fresh_path, kept, map_arrow, materialize, slices, table

MAGIC = b"MWI1"
HEAD = struct.Struct("<4sIIIQQ")
NULL_ID = -(1 << 63)
BLOCK = 4096
FRAME_IDS = 1 << 20
#: Runs remembered by each worker, and characters that a remembered run has at most.
CACHE, LONGEST = 500_000, 100


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids below 2**bits, least significant bit first, padded to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    raw = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = raw
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(n)


def frame(documents: list[tuple[int, np.ndarray]], bits: int, block: int = BLOCK) -> bytes:
    """A frame without its line feed."""
    ids = np.concatenate([x for _, x in documents]) if documents else np.empty(0, np.uint32)
    blocks = [pack(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u8")
    index = np.array([(d, len(x)) for d, x in documents], dtype=[("d", "<i8"), ("n", "<u8")])
    data = b"".join(blocks)
    return HEAD.pack(MAGIC, bits, block, len(documents), len(ids), len(data)) + index.tobytes() + offsets.tobytes() + data


class Frame:
    """A view of one frame in a buffer."""

    def __init__(self, buffer: memoryview, at: int):
        magic, self.bits, self.block, docs, self.n, size = HEAD.unpack_from(buffer, at)
        if magic != MAGIC:
            raise ValueError(f"no frame at byte {at}")
        self.index = np.frombuffer(buffer, [("d", "<i8"), ("n", "<u8")], docs, at + HEAD.size)
        at += HEAD.size + self.index.nbytes
        self.offsets = np.frombuffer(buffer, "<u8", -(-self.n // self.block), at)
        at += self.offsets.nbytes
        self.data, self.end = buffer[at : at + size], at + size + 1
        self.starts = np.cumsum(np.concatenate(([0], self.index["n"].astype(np.int64))))

    def read(self, first: int, n: int) -> np.ndarray:
        """ids first .. first + n, unpacking only the blocks that hold them."""
        if not n:
            return np.empty(0, "<u4")
        a, b = first // self.block, (first + n - 1) // self.block
        out = []
        for k in range(a, b + 1):
            held = min(self.block, self.n - k * self.block)
            at = int(self.offsets[k])
            out.append(unpack(self.data[at : at + -(-held * self.bits // 8)], self.bits, held))
        return np.concatenate(out)[first - a * self.block :][:n]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.index["n"][k]))

    def documents(self) -> Iterator[np.ndarray]:
        """document() of each, one after the other: every block is unpacked once, and some are held at a time."""
        at, held, first = 0, np.empty(0, "<u4"), 0
        for start, n in zip(self.starts[:-1].tolist(), self.index["n"].tolist(), strict=True):
            if start + n > first + len(held):
                more = min(self.n, max(start + n, at + 64 * self.block))
                held, first = np.concatenate((held[start - first :], self.read(at, more - at))), start
                at = more
            yield held[start - first : start - first + n]


def frames(content: bytes) -> Iterator[Frame]:
    at, view = 0, memoryview(content)
    while at < len(view):
        yield (f := Frame(view, at))
        at = f.end


class WordEncoder:
    """Encodes with the tokenizers library, each run of non-space characters once.

    The tokenizer drops white space, and neither its normaliser nor its split looks across it, so a text's ids are those
    of its runs in order. The rare separators that Python splits at and the tokenizer doesn't send the text through whole.
    """

    ODD = "\x1c\x1d\x1e\x1f"
    #: Marks that end a word without changing how its letters are split; an apostrophe would.
    MARKS = ".,;:!?#$%&*+-=/|\\~^@_`\"()[]{}"
    #: Letter runs asked for in one string, and characters of texts whose new runs are asked for together.
    JOINED, GROUP = 256, 1 << 20

    def __init__(self, path: str, cache: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.cache_size = Tokenizer.from_file(path), cache
        #: Strings that the tokenizer cuts out of a text; runs that hold one are asked for whole.
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        if suffix:
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask_letters(self, words: list[str]) -> list[bytes]:
        """Ids of runs of letters, many in one string. Each gives one pre-token at least, whose last id is of a word's end, so
        that as many ends as words mean one for each; else they are asked for one by one."""
        out = []
        for at in range(0, len(words), self.JOINED):
            some = words[at : at + self.JOINED]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            out += [raw[x:y] for x, y in zip([0, *cut], cut)] if len(cut) == len(some) and cut[-1] == len(raw) else self._ask(some)  # noqa: B905
        return out

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit integers; new runs of about GROUP characters of texts are learnt together."""
        at = 0
        while at < len(texts):
            to, n = at, 0
            while to < len(texts) and (to == at or n < self.GROUP):
                n += len(texts[to] or "")
                to += 1
            split = [None if t and any(c in t for c in self.ODD) else (t or "").split() for t in texts[at:to]]
            if new := set().union(*(w for w in split if w)).difference(self.known):
                collects = gc.isenabled()
                gc.disable()  # hundreds of thousands of tuples and strings without a cycle are made, which it would look through again and again
                try:
                    self._learn(new, any(a in t for t in texts[at:to] if t for a in self.added))
                finally:
                    if collects:
                        gc.enable()
            of = self.known.__getitem__
            for t, words in zip(texts[at:to], split, strict=True):
                yield self._ask([t])[0] if words is None else b"".join(map(of, words))
            if new and max(map(len, new)) > LONGEST:
                for w in [w for w in self.known if len(w) > LONGEST]:
                    del self.known[w]
            if len(self.known) > self.cache_size:  # the words met first, the frequent ones among them, stay
                self.known = dict(islice(self.known.items(), self.cache_size // 2))
            at = to

    def _learn(self, words: set[str], added: bool) -> None:
        """Letters and the marks that follow them are separate pre-tokens, so they are asked for once each. added: some may hold an added token."""
        known, cut, letters, rest = self.known, [], set(), set()
        for w in words:
            if not added and w.isascii() and w.isalpha():  # most words, and most of these in lower case
                core = w.lower()
                letters.add(core)
                if core != w:
                    cut.append((w, core, ""))
                continue
            core = w.rstrip(self.MARKS)
            if added and any(a in w for a in self.added) or not core.isalpha() or not (core.isascii() or normalize("NFC", core).lower().isalpha()):  # a combining mark would join the marks
                rest.add(w)
                continue
            marks = w[len(core) :]
            core = core.lower() if core.isascii() else core
            letters.add(core)
            if marks:
                rest.add(marks)
            cut.append((w, core, marks))
        ask = list(letters.difference(known))
        known.update(zip(ask, self._ask_letters(ask), strict=True))
        ask = list(rest.difference(known))
        known.update(zip(ask, self._ask(ask), strict=True))
        for w, core, marks in cut:
            known[w] = known[core] + known[marks] if marks else known[core]


OWNER = "packed-ids"


def encoder_of(path: str) -> WordEncoder:
    """One per worker process, kept over its tasks."""
    encoders = kept(OWNER, dict)
    if path not in encoders:
        encoders[path] = WordEncoder(path)
    return encoders[path]


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, text: str = "text", frame_ids: int = FRAME_IDS, block: int = BLOCK, frames_per_file: int = 8) -> None:
    """Encodes `text`, appends the end id and writes the files, in ascending doc_id order."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        bits, end = bits_for(max(encoder.size, end_id + 1)), np.array([end_id], "<u4").tobytes()
        held: list[tuple[int, np.ndarray]] = []
        n = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([frame(held, bits, block)], pa.binary())], names=["frame"])

        for b in slices(batches):
            for d, raw in zip(b.column(0).to_pylist(), encoder.encode_all(b.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(raw + end, "<u4")
                if held and n + len(ids) > frame_ids:
                    yield flush()
                    held, n = [], 0
                held.append((d, ids))
                n += len(ids)
        if held:
            yield flush()

    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("d"), docs[text].alias("t"))
    rows = rows.repartitionByRange("d").sortWithinPartitions("d")
    out = map_arrow(rows, run, "frame binary", OWNER).select(F.col("frame").cast("string").alias("value"))
    out.write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", frames_per_file).text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids, all from the files."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at, seq = 0, count()
                for f in frames(content.as_buffer()):
                    n = f.index["n"].astype(np.int64)
                    crc = [zlib.crc32(x) for x in f.documents()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(n), pa.string()), pa.array([next(seq) for _ in n], pa.int64()), pa.array(f.index["d"]), pa.array(at + f.starts[:-1]), pa.array(n), pa.array(crc, pa.int64())],
                        names=["file", "k", "doc_id", "at", "n_tokens", "ids_crc32"],
                    )
                    at += int(f.starts[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    rows = materialize(map_arrow(files, run, "file string, k long, doc_id long, at long, n_tokens long, ids_crc32 long"), "read-ids")
    return rows.join(bases(rows), "file").select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


#: Parts of the written table whose files are added up in one task.
PARTS = 1000


def bases(rows: DataFrame) -> DataFrame:
    """A row for each file: ids in all files before it, in the order of the names' part numbers. Added up within every PARTS parts, then over these."""
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    sums = sums.withColumns({"part": F.regexp_extract("file", r"part-(\d+)-", 1).cast("long"), "piece": F.regexp_extract("file", r"-c(\d+)\.", 1).cast("long")})
    sums = sums.withColumn("group", F.expr(f"part div {PARTS}"))
    before = (Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("part", "piece").rowsBetween(*before)), F.lit(0))
    groups = sums.groupBy("group").agg(F.sum("n").alias("n"))  # one row for PARTS parts
    groups = groups.select(F.col("group").alias("g"), F.coalesce(F.sum("n").over(Window.orderBy("group").rowsBetween(*before)), F.lit(0)).alias("all_before"))
    return sums.withColumn("inside", inside).join(groups, F.col("group") == F.col("g")).select("file", (F.col("inside") + F.col("all_before")).alias("base"))


def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = fresh_path(spark, "packed-ids")
    write_ids(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), path)
    return read_ids(spark, path)


QUERIES = {"op9_packed_ids": op9_packed_ids}
ORACLE_SQL: dict[str, str] = {}
