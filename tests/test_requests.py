"""Name lists, taggers, requests and the command line."""

import json

from pyspark.sql import functions as F

from maskwell.__main__ import main
from maskwell.operators import nlp
from maskwell.operators.analyzer import Analyzer, Registry
from maskwell.operators.recognizers import GazetteerRecognizer, predefined
from maskwell.operators.requests import analyze_request, anonymize_request, anonymize_text_request, entity_names
from maskwell.sources.gazetteer import gazetteer_spans, read_names


def test_joined_list_equals_the_one_in_the_plan(spark, tmp_path):
    names = ["new york", "york", "san francisco", "san", "rose", "de la cruz"]
    (tmp_path / "names.txt").write_text("\n".join(f" {n} " for n in names) + "\n\n")
    texts = ["flew from New York to San Francisco", "York york NEW  YORK", "i will mark the rose", "San. Francisco, San-Francisco", None, "", "maria de la cruz san", "Rose"] * 2
    df = spark.createDataFrame([(i // 2 if i > 3 else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, k int")
    for proper in (False, True):
        r = GazetteerRecognizer("N", "NAME", tuple(names), max_words=3, proper_noun=proper)
        want = [(t, [(s.start, s.end) for s in x]) for t, x in df.select("text", r.spans(F.coalesce("text", F.lit("")), 0)).collect()]
        got = gazetteer_spans(df, read_names(spark, str(tmp_path)), "NAME", max_words=3, proper_noun=proper)
        assert got.columns == [*df.columns, "ner_entities"]
        assert sorted(want, key=str) == sorted(((r.text, [(s.start, s.end) for s in r.ner_entities]) for r in got.collect()), key=str)


def test_tags_gate_names(spark):
    r = GazetteerRecognizer("N", "NAME", ("mark", "rose"), proper_noun=True, pos=("PROPN",))
    token = lambda s, e, pos: ("", "", s, e, False, pos)
    df = spark.createDataFrame([("mark Rose mark Rose", [token(0, 4, "PROPN"), token(5, 9, "VERB"), token(10, 14, "")])], f"text string, tokens {nlp.TOKENS}")
    assert [(s.start, s.end) for s in Analyzer(Registry([r])).analyze(df).first().spans] == [(0, 4), (15, 19)]


def test_taggers_by_language(spark):
    def says(label):
        return lambda text: F.when(text.isNotNull(), F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit(label).alias("label"), F.lit(0.9).alias("score"), F.lit(False).alias("is_special"))))

    df = spark.createDataFrame([("Ann", "en"), ("Ann", "fr"), ("Ann", None), (None, "fr")], "text string, lang string")
    of = lambda taggers: [[e.entity_type for e in r.ner_entities] for r in nlp.tagged(df, taggers, lang="lang").collect()]
    assert of({"*": says("B-PER"), "fr": says("B-LOC")}) == [["PERSON"], ["LOCATION"], ["PERSON"], []]
    assert of({"fr": says("B-LOC")}) == [[], ["LOCATION"], [], []]
    assert nlp.label_names('{"id2label": {"10": "c", "0": "O", "2": "b"}}') == ["O", "b", "c"]
    vocabulary = {"un": 0, "##aff": 1, "##able": 2, "a": 3}
    assert nlp.word_pieces(vocabulary, "unaffable") == ["un", "##aff", "##able"] and nlp.word_pieces(vocabulary, "unx") == ["[UNK]"] and nlp.word_pieces(vocabulary, "a" * 101) == ["[UNK]"]


def few():
    return Analyzer(Registry([r for r in predefined() if r.entity in ("EMAIL_ADDRESS", "US_SSN")]))


def test_requests(spark):
    got = analyze_request(spark, {"text": "email me at a@b.com", "entities": entity_names([" email_address ", ""])}, few())
    assert [(r["entity_type"], r["start"], r["end"], r["score"]) for r in got] == [("EMAIL_ADDRESS", 12, 19, 0.85)] and "metadata" not in got[0] and got[0]["explanation"]["original_score"] == 0.5
    assert analyze_request(spark, {"text": "a@b.com", "allow_list": ["A@B.com"]}, few()) == []
    assert anonymize_request(spark, {"text": "hello John", "analyzer_results": [{"entity_type": "PERSON", "start": 6, "end": 10}], "anonymizers": {"PERSON": {"type": "mask", "chars_to_mask": 2}, "X": 5}})["text"] == "hello **hn"
    assert anonymize_text_request(spark, {"text": "to a@b.com", "operator": "mask", "masking_char": "#"}, few())["text"] == "to #######"


def test_command_line(spark, capsys):
    assert main(["entities"]) == 0 and "EMAIL_ADDRESS" in capsys.readouterr().out.split()
    main(["analyze", "--text", "to a@b.com", "--entities", "email_address"])
    assert [r["entity_type"] for r in json.loads(capsys.readouterr().out)] == ["EMAIL_ADDRESS"]
    main(["anonymize", "--text", "to a@b.com", "--entities", "email_address", "--operator", "replace", "--new-value", "x"])
    got = capsys.readouterr()
    assert got.out.strip() == "to x" and json.loads(got.err[got.err.index("{") :])["items"][0]["text"] == "x"
