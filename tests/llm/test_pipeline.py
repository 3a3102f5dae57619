"""The pipeline's stages on planted documents, and on the odd ones."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from maskwell.llm.common import shingle_set

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = {c: "q" for c in ("score", "Predicted", "segments", "__text", "__spans", "spans", "__s", "__topic", "__tokens", "__copy", "d", "h", "ids_x", "component_id", "s", "l", "m")}


LETTERS = str.maketrans("0123456789", "abcdefghij")


def words(rng, n, size=1 << 30):
    return " ".join(f"w{i}" for i in rng.integers(0, size, n)).translate(LETTERS)


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(1)
    texts, toxic = [words(rng, int(n), 3000) for n in rng.integers(20, 120, 400)], set()
    for i in range(0, 400, 8):
        texts[i] += " you vile scum, worthless vermin" * 2
        toxic.add(i)
    near = [(i, t + " tail") for i, t in enumerate(texts[:40]) if i not in toxic]
    passage = words(rng, 70)
    texts += [t for _, t in near] + texts[1:8] + [f"{words(rng, 30)} {passage} {words(rng, 30)}" for _ in range(5)] + [None, "", " \n", "one"]
    rows = [(i, t, ["en", None, "fr"][i % 3], ["a", "a", None, "b"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return rows, toxic, passage


@pytest.fixture(scope="module")
def sf_dir(spark, planted, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rows, toxic, _ = planted
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i in toxic)) for i in range(400)] + [(None, 1), (5, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_toxic_documents_go(spark, docs, sf_dir, planted):
    rows, toxic, _ = planted
    kept = by_id(STAGES["toxicity"](spark, docs, sf_dir))
    gone = {d for d, *_ in rows} - set(kept)
    held_out = {d for d in toxic if zlib.crc32(str(d).encode()) % 5 == 0}
    assert len(gone & toxic) > 0.95 * len(toxic) and len(gone & held_out) > 0.9 * len(held_out) and len(gone - toxic) < 0.02 * len(rows)


def test_one_near_copy_stays(spark, docs, sf_dir, planted):
    rows, *_ = planted
    sets = {d: set(shingle_set((t or "").encode()).tolist()) for d, t, *_ in rows}
    least: dict[int, int] = {}
    for d in sorted(sets):  # near copies of one document here are copies of each other
        least[d] = next((e for e in sorted(sets) if e < d and sets[d] and 100 * len(sets[d] & sets[e]) >= 75 * len(sets[d] | sets[e])), d)
    assert set(by_id(STAGES["near_duplicates"](spark, docs, sf_dir))) == {d for d, e in least.items() if d == e}


def test_repeats_of_a_passage_are_cut(spark, sf_dir, planted):
    rows, _, passage = planted
    some = [r for r in rows if r[1] and passage in r[1]] + [(1000, passage, "en", "a", len(passage)), (1001, None, "en", "a", 0), (1002, "", "en", "a", 0), (None, passage, None, None, None)]
    got = STAGES["repeated_passages"](spark, spark.createDataFrame(some, SCHEMA), sf_dir).collect()
    held = {r.doc_id: r for r in got}
    first = min(r[0] for r in some if r[0] is not None)
    assert passage in held[first].text and held[None].text == passage and held[1001].text is None and held[1002].text == "" and 1000 not in held
    for d, t, *_ in some[1:5]:
        assert held[d].text.split() == t.replace(passage, "").split() and held[d].n_chars == len(held[d].text)


def test_rows_that_repeat_an_id_are_cut_by_their_own_text(spark, sf_dir, planted):
    rng = np.random.default_rng(3)
    passage = words(rng, 60)
    some = [(1, f"{words(rng, 9)} {passage}", None, None, 1), (2, f"{words(rng, 5)} {passage} {words(rng, 80)}", None, None, 1), (2, words(rng, 8), None, None, 1)]
    got = STAGES["repeated_passages"](spark, spark.createDataFrame(some, SCHEMA), sf_dir).collect()
    assert sorted(len(r.text.split()) for r in got) == [8, 69, 85]


def test_drawn_rows_have_the_columns(spark, docs, sf_dir):
    got = STAGES["mix_sources"](spark, docs, sf_dir)
    assert got.columns == docs.columns and set(by_id(got)) <= set(by_id(docs)) and got.count() > 0.5 * docs.count()


def test_tokens_decode_to_the_text(spark, docs, sf_dir, planted):
    rows, *_ = planted
    got = by_id(STAGES["encode"](spark, docs, sf_dir))
    assert {d: r.decoded_sha256 for d, r in got.items()} == {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t, *_ in rows}


def test_whole_pipeline(spark, sf_dir, planted):
    rows, toxic, _ = planted
    out = corpus_pipeline.run(spark, sf_dir)
    ids = [r.doc_id for r in out.collect()]
    assert not set(ids) & {d for d in toxic if d not in ids} and 0.5 * len(rows) < len(ids) < len(rows)
    assert len(set(ids) & toxic) < 0.05 * len(toxic)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables_and_clashing_columns(spark, docs, sf_dir, name):
    empty = spark.createDataFrame([], SCHEMA)
    assert STAGES[name](spark, empty, sf_dir).count() == 0
    few = docs.where("doc_id < 60 OR doc_id > 430").repartition(2)
    from pyspark.sql import functions as F

    wide = few.withColumns({c: F.lit(v) for c, v in CLASH.items()})
    got, plain = STAGES[name](spark, wide, sf_dir), STAGES[name](spark, few, sf_dir)
    if name != "encode":
        assert got.columns == wide.columns and {tuple(r[c] for c in CLASH) for r in got.collect()} == {tuple(CLASH.values())}
    same = [c for c in plain.columns if c != "ids"]
    assert sorted(got.select(same).collect(), key=str) == sorted(plain.select(same).collect(), key=str)


def test_stages_begin_without_what_others_left(spark, docs, sf_dir, monkeypatch, tmp_path):
    from maskwell.llm import common

    begun = []
    monkeypatch.setattr(corpus_pipeline, "shrink_executors", lambda s: begun.append(common.shrink_executors(s)))
    monkeypatch.setenv("MASKWELL_LOCAL_SHARED", str(tmp_path))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).count()
    assert len(begun) == len(corpus_pipeline.STAGES)
    assert not [p.name for p in tmp_path.iterdir() if p.name.split("-")[0] in ("sets", "components")]
