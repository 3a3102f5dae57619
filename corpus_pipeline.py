"""A corpus pipeline of five stages over `documents`: toxicity, near duplicates, repeated passages, source mixing, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. A null text stays and counts as empty; extra columns pass through unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm import bpe, jaccard, passages, raking, toxicity
from maskwell.llm.common import free, free_name, fresh_path, materialize, shrink_executors, table, write_table

#: The mixing stage lifts source, language and topic shares to this power and keeps this share of the tokens.
MIX_POWER, MIX_SHARE = 0.9, 0.9


#: Rows of texts that a Python worker is given at once; Spark's default of 10,000 takes some 30 MB for each of a task's buffers.
ROWS_AT_ONCE = 1000


def begin(spark: SparkSession) -> None:
    """Few rows at once, and no memory that the stage before has left. Stages are written by whoever runs them, so the session's setting
    holds from here on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_AT_ONCE:
        spark.conf.set(key, str(ROWS_AT_ONCE))
    shrink_executors(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is at least 0.5 go."""
    begin(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    names = tuple(free_name(docs.columns, n) for n in ("score", "predicted", "segments"))
    return toxicity.score(docs, model, keep=tuple(docs.columns), names=names).where(F.col(names[1]) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays; rows with a null doc_id stay. Of rows that repeat the id that
    stays, all stay."""
    begin(spark)
    found = jaccard.near_duplicates(docs, links=False)
    gone = materialize(found.where("component_id <> doc_id").select("doc_id").distinct(), "near-duplicates")
    free(*found._tables)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a document of which nothing is left goes."""
    begin(spark)
    found = materialize(passages.repeated_passages(docs), "passages")
    mark = free_name(docs.columns, "spans")
    rows = passages.without_passages(docs, found, mark=mark)
    rows = rows.where(F.col(mark).isNull() | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    changed = {"n_chars": F.when(F.col(mark).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return rows.withColumns(changed).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn to tempered source, language and topic shares; one drawn more than once is repeated as rows."""
    begin(spark)
    sums, prefix = raking.cell_sums(docs), "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    rows = raking.mix(docs, raking.own_targets(sums, MIX_POWER), MIX_SHARE, sums=sums, prefix=prefix)
    return rows.withColumn(f"{prefix}copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{prefix}repeats")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, with the digests of ids and decoded bytes."""
    begin(spark)
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: The stages are learnt, iterative or hash-based, which SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        write_table(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
    return docs
