"""Byte-level BPE: a sentencepiece model serialised straight from a rank vocabulary.

Every byte stands for one printable character, every vocabulary entry becomes a piece with the score -rank,
and normalisation is the identity, so that sentencepiece's merge order (best score first, then leftmost) is the
rank order. Pre-tokens are encoded one by one; decoding maps ids back to bytes.

Null texts count as empty; an empty text has no ids. Texts of any length are encoded whole. Repeated rows give
repeated results; an empty table gives no rows; other columns are left out unless named in `keep`.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from maskwell.llm.common import free_name, kept, map_arrow, slices, table

#: Bytes of pre-tokens and their ids remembered by each worker, about; beyond it the memory starts anew.
CACHE = 64_000_000
OWNER = "byte-bpe"


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in rank order, from a tiktoken rank file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return tokens


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it prints, else the next free one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float | str) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """The serialised model: piece i is token i with score -i; the unknown piece, never used, comes last."""
    char = byte_characters()
    pieces = [_field(1, "".join(char[b] for b in t)) + _field(2, float(-i)) + _field(3, 1) for i, t in enumerate(tokens)]
    pieces.append(_field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    bpe, no = 2, 0
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(i, -1) for i in (41, 42, 43))
    normalizer = _field(1, "identity") + b"".join(_field(i, no) for i in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBPE:
    """Encoder and decoder for one vocabulary and one pre-token pattern."""

    def __init__(self, tokens: list[bytes], pattern: str, cache: int = CACHE):
        import regex
        import sentencepiece

        self.tokens, self.cache_size = tokens, cache
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.map = {i: c for i, c in enumerate(byte_characters())}
        self.known: dict[str, list[int]] = {}
        self.held = 0

    def encode(self, text: str | None) -> list[int]:
        words = self.split(text or "")
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            if self.held > self.cache_size:
                known.clear()
                self.held = 0
                new = list(set(words))
            self._learn(new)
        return list(chain.from_iterable(map(known.__getitem__, words)))

    def _learn(self, new: list[str]) -> None:
        ask = []
        for w in new:
            b = w.encode("utf-8", "surrogatepass")
            if (i := self.whole.get(b)) is not None:  # a pre-token that is a token needs no merges
                self.known[w] = [i]
                self.held += 300 + len(b)
            else:
                ask.append((w, b.decode("latin-1").translate(self.map)))
        if ask:
            for (w, m), ids in zip(ask, self.model.encode([m for _, m in ask], out_type=int, num_threads=1), strict=True):
                self.known[w] = ids
                self.held += 300 + 4 * len(m) + 40 * len(ids)  # a list, its integers, a string and their place in the memory

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def coder_of(vocabulary: str, pattern: str) -> ByteBPE:
    """One per worker process, kept over its tasks."""
    coders = kept(OWNER, dict)
    if (vocabulary, pattern) not in coders:
        coders[vocabulary, pattern] = ByteBPE(read_ranks(vocabulary), pattern)
    return coders[vocabulary, pattern]


def encoded_schema(docs: DataFrame, keep: list[str], ids: bool, text: str) -> T.StructType:
    extra = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []
    return T.StructType(
        [docs.schema[c] for c in keep]
        + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
        + extra
        + ([T.StructField("decoded", T.StringType())] if text else [])
    )


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False, decoded: bool = False) -> DataFrame:
    """Encodes `text` and decodes the ids again. Rows stay where they are: no shuffle.

    Gives the columns of `keep`, n_tokens, the digests of ids and decoded bytes, and if asked the ids and the text decoded.
    """
    import pyarrow as pa

    schema = encoded_schema(docs, list(keep), ids, decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder_of(vocabulary, pattern)
        names = [str(i) for i in range(len(bpe.tokens))]
        for b in slices(batches):
            n, a, d, every, back = [], [], [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                got = bpe.encode(t)
                plain = bpe.decode(got)
                n.append(len(got))
                a.append(hashlib.sha256(",".join(map(names.__getitem__, got)).encode()).hexdigest())
                d.append(hashlib.sha256(plain).hexdigest())
                if ids:
                    every.append(got)
                if decoded:
                    back.append(plain.decode("utf-8", "replace"))
            columns = [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            columns += [pa.array(every, pa.list_(pa.int32()))] if ids else []
            columns += [pa.array(back, pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return map_arrow(docs.select(*keep, docs[text].alias(free_name(keep, "text"))), run, schema, OWNER)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encode_decode(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
