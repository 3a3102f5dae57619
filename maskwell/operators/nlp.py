"""Tokens of the text column, and entities from the labels that a token classifier gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions.columns import matches
from maskwell.operators.recognizers import TOKEN

# fixed values: stop words
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in",
    "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with",
    "my", "your", "his", "her", "our", "their", "this", "these", "those",
)

# fixed values: labels of the usual classifiers
LABELS = {"PER": "PERSON", "PERSON": "PERSON", "LOC": "LOCATION", "LOCATION": "LOCATION", "GPE": "LOCATION", "ORG": "ORGANIZATION", "ORGANIZATION": "ORGANIZATION", "MISC": "NRP", "NORP": "NRP", "DATE": "DATE_TIME", "TIME": "DATE_TIME"}

TOKENS = "array<struct<text:string,lemma:string,start:int,end:int,is_stop:boolean,pos:string>>"
ENTITIES = "array<struct<entity_type:string,start:int,end:int,score:double>>"
_OPEN = "struct<entity_type:string,start:int,end:int,total:double,n:int>"


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores with offsets, lemma (lower case) and stop-word flag; pos is "" (unknown). Null texts have none."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])

    def one(m: Column) -> Column:
        lemma = F.lower(m["match"])
        return F.struct(m["match"].alias("text"), lemma.alias("lemma"), m["start"].alias("start"), m["end"].alias("end"), F.array_contains(stop, lemma).alias("is_stop"), F.lit("").alias("pos"))

    return F.transform(matches(F.coalesce(text, F.lit("")), f"{TOKEN}+"), one)


def decode_bio(predictions: Column) -> Column:
    """Entities from an array of structs (start, end, label, score, is_special), in order.

    I-x goes on with an open entity of type x; O and special tokens close it; any other label opens one, a label without
    prefix under its whole name. An entity's score is the mean of its tokens'. A null array has no entities.
    """
    nothing = F.lit(None).cast(_OPEN)

    def closed(a: Column) -> Column:
        o = a["open"]
        e = F.struct(o["entity_type"].alias("entity_type"), o["start"].alias("start"), o["end"].alias("end"), (o["total"] / o["n"]).alias("score"))
        return F.when(o.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(e)))

    def state(out: Column, now: Column) -> Column:
        return F.struct(out.alias("out"), now.alias("open"))

    def step(a: Column, t: Column) -> Column:
        dash = F.instr(t["label"], "-")
        kind = F.when(dash > 0, F.substring(t["label"], dash + 1, F.length(t["label"]))).otherwise(t["label"])
        o, score = a["open"], t["score"].cast("double")
        more = F.struct(o["entity_type"], o["start"], t["end"].cast("int"), o["total"] + score, o["n"] + 1).cast(_OPEN)
        new = F.struct(kind, t["start"].cast("int"), t["end"].cast("int"), score, F.lit(1)).cast(_OPEN)
        goes_on = F.coalesce(t["label"].startswith("I-") & (o["entity_type"] == kind), F.lit(False))
        ends = t["is_special"] | (t["label"] == "O")
        return F.when(ends, state(closed(a), nothing)).when(goes_on, state(a["out"], more)).otherwise(state(closed(a), new))

    start = state(F.array().cast(ENTITIES), nothing)
    return F.coalesce(F.aggregate(predictions, start, step, closed), F.array().cast(ENTITIES))


def postprocess(entities: Column, labels: dict[str, str] | None = None, min_score: float = 0.0) -> Column:
    """Entities of at least min_score, with mapped labels; labels that the map doesn't have pass."""
    of = F.create_map(*[F.lit(x) for kv in (LABELS if labels is None else labels).items() for x in kv]) if labels != {} else None
    kept = F.filter(entities, lambda e: e["score"] >= F.lit(float(min_score)))
    return kept if of is None else F.transform(kept, lambda e: e.withField("entity_type", F.coalesce(F.try_element_at(of, e["entity_type"]), e["entity_type"])))


def contains(a: Column, b: Column) -> Column:
    return (a["start"] <= b["start"]) & (a["end"] >= b["end"])


def intersects(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def same_span(a: Column, b: Column) -> Column:
    return (a["start"] == b["start"]) & (a["end"] == b["end"])


def byte_offsets(spans: Column, text: Column) -> Column:
    """Spans with UTF-8 byte offsets in place of character offsets."""
    at = lambda i: F.octet_length(F.substring(text, F.lit(1), i)).cast("int")
    return F.transform(spans, lambda s: s.withField("start", at(s["start"])).withField("end", at(s["end"])))


def route(taggers: dict[str, Callable[[Column], Column]], text: Column, lang: Column | None = None) -> Column:
    """The result of the tagger of the row's language, else of that under "*", else null. A tagger makes a Column of the text: built-in
    functions, or an Arrow function of a model. Rows of other languages give it null."""
    if lang is None:
        return taggers["*"](text) if "*" in taggers else F.lit(None)
    named = [l for l in taggers if l != "*"]
    parts = [taggers[l](F.when(lang == l, text)) for l in named]
    known = F.coalesce(lang.isin(named), F.lit(False)) if named else F.lit(False)
    if "*" in taggers:
        parts.append(taggers["*"](F.when(~known, text)))
    if not parts:
        return F.lit(None)
    whens = [(lang == l, x) for l, x in zip(named, parts, strict=False)]
    out = F.when(~known, parts[-1]) if "*" in taggers else F.when(F.lit(False), parts[-1])
    for test, x in whens:
        out = out.when(test, x)
    return out


def tagged(df: DataFrame, taggers: dict[str, Callable[[Column], Column]], text: str = "text", lang: str | None = None, labels: dict[str, str] | None = None, min_score: float = 0.0, output: str = "ner_entities") -> DataFrame:
    """df with the entities of token classifiers: each tagger makes an array of labelled tokens (see decode_bio) of a text."""
    found = route(taggers, F.col(text), F.col(lang) if lang else None)
    return df.withColumn(output, postprocess(decode_bio(found), labels, min_score))


def label_names(config: str) -> list[str]:
    """The labels of a classifier's configuration (JSON with "id2label"), in the order of their ids."""
    import json

    of = json.loads(config).get("id2label") or {}
    return [of[k] for k in sorted(of, key=int)]


def word_pieces(vocabulary: dict[str, int], word: str, unknown: str = "[UNK]", longest: int = 100) -> list[str]:
    """A word's pieces: the longest prefix that the vocabulary has, again and again; those after the first are marked ##."""
    out, at = [], 0
    while at < len(word) <= longest:
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
        if end is None:
            return [unknown]
        out.append(("##" if at else "") + word[at:end])
        at = end
    return out if out or not word else [unknown]
