"""Name lists of any size: a join of the documents' phrases with a table of names."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.operators.nlp import TOKENS

HITS = "array<struct<entity_type:string,start:int,end:int,score:double>>"


def read_names(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """name: trimmed lines of text files, or a column of Parquet tables; empty ones are left out."""
    rows = spark.read.parquet(path).select(F.col(column).alias("name")) if column else spark.read.text(path).select(F.col("value").alias("name"))
    return rows.select(F.trim("name").alias("name")).where("name <> ''")


#: The words of GazetteerRecognizer: letters and numbers, then these, apostrophes and hyphens.
WORD = re.compile(r"[^\W_](?:[^\W_]|['\-])*")


def _phrases(rows: DataFrame, min_len: int, max_words: int, proper_noun: bool, pos: tuple[str, ...]) -> DataFrame:
    """From k, h, text and tokens: k, h and each run of up to max_words words as i, w, start, end and phrase, words joined by single spaces. An Arrow
    function: texts have thousands of words, for which folding arrays would take quadratic time."""
    import pyarrow as pa

    schema = T.StructType([rows.schema["k"], T.StructField("h", T.LongType()), *(T.StructField(n, T.IntegerType()) for n in ("i", "w", "start", "end")), T.StructField("phrase", T.StringType())])

    def fits(head: str, start: int, tokens) -> bool:
        tag = next((t["pos"] for t in tokens or () if t["start"] <= start < t["end"]), "") if pos else ""
        return tag in pos if tag else not (proper_noun and head[0].islower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, 500) for at in range(0, b.num_rows, 500)):
                out, row = [], []
                for r, (text, tokens) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text or "")]
                    before = len(out)
                    for i, (start, _, head) in enumerate(words):
                        if (pos or proper_noun) and not fits(head, start, tokens):
                            continue
                        for w in range(1, min(max_words, len(words) - i) + 1):
                            phrase = head if w == 1 else " ".join(x for _, _, x in words[i : i + w])
                            if len(phrase) >= min_len:
                                out.append((i, w, start, words[i + w - 1][1], phrase))
                    row += [r] * (len(out) - before)
                cols = list(zip(*out, strict=True)) or [[]] * 5
                kinds = [pa.int32()] * 4 + [pa.string()]
                keys = [part.column(c).take(pa.array(row, pa.int64())) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x, kind) for x, kind in zip(cols, kinds, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)


def gazetteer_spans(docs: DataFrame, names: DataFrame, entity: str, key: str = "doc_id", text: str = "text", output: str = "ner_entities", score: float = 0.3, min_len: int = 3, max_words: int = 1, case_sensitive: bool = False, proper_noun: bool = False, pos: tuple[str, ...] = (), tokens: str | None = None) -> DataFrame:
    """docs with the array of entities (entity_type, start, end, score) in `output`: the longest names from left to right, as GazetteerRecognizer
    finds them with a list in the plan. names: a table with the column `name`.

    pos: parts of speech that a name's first word may have, by the column `tokens` (see nlp.tokens); where a tag is unknown, proper_noun decides.
    Phrases are shuffled to their names, and documents to their hits. `key` tells rows apart; rows that
    repeat a key and a text have the same spans. Null texts have none.
    """
    fold = (lambda c: c) if case_sensitive else F.lower
    taken = {c.lower() for c in docs.columns} | {output.lower()}
    k, h, hits = (next(f"{c}{'_' * i}" for i in range(99) if f"{c}{'_' * i}" not in taken) for c in ("k", "h", "hits"))
    known = names.select(fold(F.col("name")).alias("n")).where("n IS NOT NULL").distinct()
    tags = F.col(tokens) if tokens and pos else F.lit(None).cast(TOKENS)
    rows = _phrases(docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t"), tags.alias("tags")), min_len, max_words, proper_noun, pos)
    found = rows.join(known, fold(F.col("phrase")) == F.col("n")).groupBy(F.col("k").alias(k), F.col("h").alias(h)).agg(F.array_sort(F.collect_set(F.struct("i", (-F.col("w")).alias("w"), "start", "end"))).alias(hits))  # longest first

    def step(a: Column, x: Column) -> Column:
        span = F.struct(F.lit(entity).alias("entity_type"), x["start"].alias("start"), x["end"].alias("end"), F.lit(float(score)).alias("score"))
        return F.when(x["i"] < a["next"], a).otherwise(F.struct((x["i"] - x["w"]).alias("next"), F.concat(a["out"], F.array(span)).alias("out")))

    start = F.struct(F.lit(0).alias("next"), F.array().cast(HITS).alias("out"))
    found = found.select(k, h, F.aggregate(hits, start, step, lambda a: a["out"]).alias(hits))
    joined = docs.join(found, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(docs[text]) == F.col(h)), "left")
    return joined.withColumn(output, F.coalesce(hits, F.array().cast(HITS))).select(*docs.columns, output)
