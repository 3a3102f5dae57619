"""Tokens, label decoding, byte offsets and streams."""

import pytest
from pyspark.sql import functions as F

from maskwell.operators import nlp
from maskwell.operators.analyzer import Analyzer, Registry
from maskwell.operators.recognizers import predefined
from maskwell.streaming import deidentify, write

PREDICTIONS = "p array<struct<start:int,end:int,label:string,score:double,is_special:boolean>>"


@pytest.mark.parametrize(
    ("labels", "want"),
    [
        ("B-PER I-PER", [("PER", 0, 3)]), ("B-PER B-LOC", [("PER", 0, 1), ("LOC", 2, 3)]), ("B-ORG O B-ORG", [("ORG", 0, 1), ("ORG", 4, 5)]),
        ("I-PER", [("PER", 0, 1)]), ("PER", [("PER", 0, 1)]), ("B-PER I-LOC", [("PER", 0, 1), ("LOC", 2, 3)]), ("B-PER # I-PER", [("PER", 0, 1), ("PER", 4, 5)]), ("", []),
    ],
)
def test_decode_bio(spark, labels, want):
    rows = [(2 * i, 2 * i + 1, x, 0.5 + i / 4, x == "#") for i, x in enumerate(labels.split())]
    got = spark.createDataFrame([(rows,)], PREDICTIONS).select(nlp.decode_bio(F.col("p")).alias("e")).first().e
    assert [(e.entity_type, e.start, e.end) for e in got] == want
    if labels == "B-PER I-PER":
        assert got[0].score == 0.625


def test_null_predictions_and_postprocess(spark):
    df = spark.createDataFrame([(None,), ([(0, 1, "B-MISC", 0.9, False), (2, 3, "B-PER", 0.2, False), (4, 5, "B-X", 0.9, False)],)], PREDICTIONS)
    got = [[e.entity_type for e in r.e] for r in df.select(nlp.postprocess(nlp.decode_bio(F.col("p")), min_score=0.5).alias("e")).collect()]
    assert got == [[], ["NRP", "X"]]


def test_tokens_and_bytes(spark):
    df = spark.createDataFrame([("The é_1, Öl",), (None,), ("",)], "text string")
    got = [[tuple(t) for t in r.t] for r in df.select(nlp.tokens(F.col("text")).alias("t")).collect()]
    assert got == [[("The", "the", 0, 3, True, ""), ("é_1", "é_1", 4, 7, False, ""), ("Öl", "öl", 9, 11, False, "")], [], []]
    b = df.limit(1).select(nlp.byte_offsets(nlp.tokens(F.col("text")), F.col("text")).alias("t")).first().t
    assert [(t.start, t.end) for t in b] == [(0, 3), (4, 8), (10, 13)]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "mail a@b.com now"), (2, None), (3, "")], "id long, text string").write.parquet(str(tmp_path / "in"))
    a = Analyzer(Registry([r for r in predefined() if r.entity == "EMAIL_ADDRESS"]))
    s = deidentify(spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in")), a)
    write(s, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination(60)
    got = {r.id: (r.text, r.n_items) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == ("mail <EMAIL_ADDRESS> now", 1) and got[3] == ("", 0) and got[2] == (None, 0)
