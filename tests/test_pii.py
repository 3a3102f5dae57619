"""Detection, scoring and de-identification on sentences."""

import re

import pytest
from pyspark.sql import functions as F

from maskwell.operators.analyzer import Analyzer, Registry
from maskwell.operators.anonymizer import SURROGATES, Anonymizer, Factory, OperatorConfig, OperatorError, surrogate
from maskwell.operators.catalog import PATTERNS
from maskwell.operators.phone import PhoneRecognizer
from maskwell.operators.recognizers import ContextEnhancer, GazetteerRecognizer, NerRecognizer, Pattern, PatternRecognizer, predefined

SPANS = "array<struct<entity_type:string,start:int,end:int,score:double>>"


def spans(spark, text, recognizers, lang="en", enhancer=None, **options):
    a = Analyzer(Registry(recognizers), enhancer or ContextEnhancer())
    df = spark.createDataFrame([(text, lang)], "text string, lang string")
    return [(s.entity_type, s.start, s.end, round(s.score, 6)) for s in a.analyze(df, lang="lang", **options).first().spans]


def of(*entities):
    return [r for r in predefined() if r.entity in entities]


def test_catalogue():
    assert len(PATTERNS) == 60 and len(predefined()) == 56
    assert len(Registry.with_predefined().supported_entities()) == 61


def test_card_email_ssn(spark):
    assert spans(spark, "carte 4095-2609-9393-4932, courriel a@b.fr", of("CREDIT_CARD", "EMAIL_ADDRESS"), "fr") == [("CREDIT_CARD", 6, 25, 1.0), ("EMAIL_ADDRESS", 36, 42, 0.5)]
    assert spans(spark, "his social security number is 078-05-1120", of("US_SSN")) == [("US_SSN", 30, 41, 0.75)]
    assert spans(spark, "email me at a@b.com", of("EMAIL_ADDRESS")) == [("EMAIL_ADDRESS", 12, 19, 0.85)]


def test_null_and_empty(spark):
    assert spans(spark, None, of("EMAIL_ADDRESS")) == [] == spans(spark, "", of("EMAIL_ADDRESS"))


def test_context_window(spark):
    r = [PatternRecognizer("Card", "CARD", (Pattern("four", r"\b\d{4}\b", 0.1),), context=("card",))]
    one = ContextEnhancer(prefix=1)
    assert spans(spark, "card xxxx yyyy 1234", r, enhancer=one)[0][3] == 0.1
    assert spans(spark, "aaaa yyyy card 1234", r, enhancer=one)[0][3] == pytest.approx(0.45)
    assert spans(spark, "code 1234", r, context=["card"])[0][3] == pytest.approx(0.45)


def test_dedup_conflicts_case_deny(spark):
    r = PatternRecognizer("D", "D", (Pattern("four", r"\d{4}", 0.9), Pattern("two", r"\d{2}", 0.3)))
    assert spans(spark, "1234", [r]) == [("D", 0, 4, 0.9)]
    assert spans(spark, "ab AB", [PatternRecognizer("U", "U", (Pattern("u", "[A-Z]{2}", 0.5),))]) == [("U", 3, 5, 0.5)]
    assert [s[0] for s in spans(spark, "our CEO and CTO", [PatternRecognizer("T", "TITLE").with_deny_list(["ceo", "cto"], 0.8)])] == ["TITLE"] * 2


def test_allow_lists(spark):
    assert spans(spark, "mail a@b.com", of("EMAIL_ADDRESS"), allow_list=["A@B.com"]) == []
    assert spans(spark, "write john@example.com now", of("EMAIL_ADDRESS"), allow_list=[r"[a-z.]+@example\.com", "("], allow_list_match="regex") == []
    assert len(spans(spark, "x ab", [PatternRecognizer("W", "W", (Pattern("w", "ab", 0.5),))], allow_list=["a|ab"], allow_list_match="regex")) == 1


def test_ad_hoc_language_is_strict(spark):
    zip_code = PatternRecognizer("Zip", "US_ZIP", (Pattern("zip", r"\b\d{5}\b", 0.5),))
    assert spans(spark, "zip 94103 here", [], ad_hoc=[zip_code]) == [("US_ZIP", 4, 9, 0.5)]
    assert spans(spark, "zip 94103 here", [], "fr", ad_hoc=[zip_code]) == []


@pytest.mark.parametrize(("text", "n"), [("call 202-555-0143 now", 1), ("ring +44 20 7946 0958", 1), ("+33 6 12 34 56 78", 1), ("ssn 078-05-1120", 0), ("order number 12 34", 0)])
def test_phones(spark, text, n):
    assert len(spans(spark, text, [PhoneRecognizer()], "xx")) == n


def test_gazetteer_takes_longest(spark):
    g = GazetteerRecognizer("Cities", "LOCATION", ("new york", "york", "san francisco"), max_words=2)
    assert [s[1:3] for s in spans(spark, "flew from New York to San Francisco", [g])] == [(10, 18), (22, 35)]
    g = GazetteerRecognizer("Names", "FIRST_NAME", ("will", "mark", "rose"), proper_noun=True)
    assert spans(spark, "i will mark the rose", [g]) == []


def test_ner_labels(spark):
    df = spark.sql("select 'Ann met NATO' text, array(named_struct('entity_type','PER','start',0,'end',3,'score',0.9D), named_struct('entity_type','MISC','start',8,'end',12,'score',0.9D)) ner_entities")
    got = Analyzer(Registry([NerRecognizer()])).analyze(df).first().spans
    assert [(s.entity_type, s.metadata) for s in got] == [("PERSON", {"recognizer_name": "NerRecognizer"})]


def anonymized(spark, text, found, operators):
    df = spark.createDataFrame([(text, found)], f"text string, spans {SPANS}")
    return Anonymizer().anonymize(df, operators).select("anonymized.*")


C = OperatorConfig


@pytest.mark.parametrize(
    ("config", "expected"),
    [(C("replace"), "hello <PERSON>"), (C("replace", {"new_value": "x"}), "hello x"), (C("redact"), "hello "), (C("keep"), "hello John"), (C("mask", {"chars_to_mask": 2}), "hello **hn"), (C("mask", {"chars_to_mask": 2, "from_end": True, "masking_char": "#"}), "hello Jo##"), (C("mask", {"chars_to_mask": 2.5}), "hello ****")],
)
def test_operators(spark, config, expected):
    assert anonymized(spark, "hello John", [("PERSON", 6, 10, 0.5)], {"PERSON": config}).first().text == expected


def test_hash_conflict_and_items(spark):
    r = anonymized(spark, "0123456789", [("A", 0, 5, 0.5), ("B", 2, 8, 0.9)], {"DEFAULT": C("hash")}).first()
    assert len(r["items"]) == 1 and r["items"][0].entity_type == "B" and len(r["items"][0].text) == 64
    assert r.text[r["items"][0].start : r["items"][0].end] == r["items"][0].text


def test_encrypt_round_trip_and_errors(spark):
    key = {"key": "1234567890123456"}
    r = anonymized(spark, "name: Bond", [("PERSON", 6, 10, 0.5)], {"PERSON": C("encrypt", key)})
    assert Anonymizer().deanonymize(r, {"PERSON": C("decrypt", key)}).select("restored.text").first()[0] == "name: Bond"
    with pytest.raises(OperatorError):
        anonymized(spark, "x", [], {"DEFAULT": C("decrypt", key)})
    with pytest.raises(OperatorError):
        anonymized(spark, "x", [], {"DEFAULT": C("encrypt", {"key": "short"})})


def test_surrogates(spark):
    texts = [f"{i}95" for i in range(60)]
    rows = [(e, t) for e in [*SURROGATES, "OTHER", None] for t in texts]
    df = spark.createDataFrame(rows, "e string, t string").select("e", "t", surrogate(F.col("e"), F.col("t")).alias("s"))
    got = {(r.e, r.t): r.s for r in df.collect()}
    forms = {"PERSON": r"[A-Z][a-z]+ [A-Z][a-z]+", "EMAIL_ADDRESS": r"[a-z]+\.[a-z]+@example\.com", "PHONE_NUMBER": r"\+1 \(\d{3}\) \d{3}-\d{4}", "CREDIT_CARD": r"\d{16}", "US_SSN": r"\d{3}-\d\d-\d{4}", "IP_ADDRESS": r"\d+(\.\d+){3}", "DATE_TIME": r"(19|20)\d\d-\d\d-\d\d", "OTHER": "<OTHER>", None: "<ENTITY>"}
    assert all(re.fullmatch(forms.get(e, ".+"), s) for (e, _), s in got.items())
    assert all(spark.createDataFrame([(got["CREDIT_CARD", t],) for t in texts], "c string").selectExpr("bool_and(luhn_check(c))").first())
    assert len({got["PERSON", t] for t in texts}) > 30 and {tuple(r) for r in df.collect()} == {(e, t, s) for (e, t), s in got.items()}


def test_digits_of_other_scripts(spark):
    found = [("P", 9, 18, 0.5)]
    number = PatternRecognizer("P", "P", (Pattern("nine", r"\b\d{9}\b", 0.5),))
    arabic = "passport \u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669"
    assert spans(spark, arabic, [number]) == spans(spark, arabic + " room 5", [number]) == found
    maybe = PatternRecognizer("M", "M", (Pattern("maybe", r"\b\d?x{3}\b", 0.5), Pattern("or", r"yyy|@[a-z]+", 0.5)))
    assert [s[1:3] for s in spans(spark, "xxx yyy", [maybe])] == [(0, 3), (4, 7)]


def test_allow_list_skips_what_the_jvm_cannot_compile(spark):
    r = PatternRecognizer("D", "D", (Pattern("d", r"\d{3}", 0.5),))
    assert spans(spark, "123 456", [r], allow_list=["(?P<a>1)", "[", "1.."], allow_list_match="regex") == [("D", 4, 7, 0.5)]


def test_streamed_columns_pass(spark):
    from maskwell.streaming import deidentify

    df = spark.createDataFrame([(1, "mail a@b.com", "kept", "t", 7), (2, None, "x", "u", 8)], "id int, body string, spans string, text string, anonymized int")
    got = deidentify(df, Analyzer(Registry([r for r in predefined() if r.entity == "EMAIL_ADDRESS"])), text="body")
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, "mail <EMAIL_ADDRESS>", "kept", "t", 7, 1), (2, None, "x", "u", 8, 0)]
    with pytest.raises(ValueError):
        deidentify(df.withColumn("N_items", F.lit(1)), Analyzer(), text="body")


def test_custom_operator(spark):
    a = Anonymizer(Factory().add("shout", lambda text, entity, c: F.upper(text)))
    df = spark.createDataFrame([("hello John", [("PERSON", 6, 10, 0.5)])], f"text string, spans {SPANS}")
    assert a.anonymize(df, {"DEFAULT": C("shout")}).select("anonymized.text").first()[0] == "hello JOHN"
