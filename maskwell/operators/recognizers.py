"""Recognizers: each makes an array of spans from the text column.

A span has character offsets, half-open. byte_len and ord (registration order) decide conflicts and are dropped at the end.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwell.functions.columns import let, matches
from maskwell.functions.validators import VALIDATORS
from maskwell.operators.catalog import PATTERNS

EXPLANATION = "struct<recognizer:string,pattern_name:string,pattern:string,original_score:double,score:double,textual_explanation:string,score_context_improvement:double,supportive_context_word:string,validation_result:boolean>"
RESULT = f"array<struct<entity_type:string,start:int,end:int,score:double,explanation:{EXPLANATION},metadata:map<string,string>,byte_len:int,ord:int>>"
TOKEN = r"[\p{IsAlphabetic}\p{N}_]"


def none() -> Column:
    return F.array().cast(RESULT)


def explanation(recognizer: str, score: Column, name: str | None = None, pattern: str | None = None, original: float | None = None, text: Column | None = None, validation: Column | None = None) -> Column:
    null = F.lit(None)
    values = [F.lit(recognizer), F.lit(name), F.lit(pattern), F.lit(original), score, null if text is None else text, F.lit(0.0), null, null if validation is None else validation]
    return F.struct(*values).cast(EXPLANATION)


def result(entity: Column | str, start: Column, end: Column, score: Column, explained: Column | None, match: Column, order: int, metadata: Column | None = None) -> Column:
    entity = F.lit(entity) if isinstance(entity, str) else entity
    return F.struct(
        entity.alias("entity_type"), start.alias("start"), end.alias("end"), score.cast("double").alias("score"),
        (F.lit(None).cast(EXPLANATION) if explained is None else explained).alias("explanation"),
        (F.lit(None).cast("map<string,string>") if metadata is None else metadata).alias("metadata"),
        F.octet_length(match).alias("byte_len"), F.lit(order).alias("ord"),
    )


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    score: float

    def __post_init__(self):
        re.compile(self.regex)  # a bad expression fails here, on the driver


@dataclass(frozen=True)
class PatternRecognizer:
    name: str
    entity: str
    patterns: tuple[Pattern, ...] = ()
    validator: Callable[[Column], Column] | None = None
    context: tuple[str, ...] = ()
    deny_list: tuple[str, ...] = ()
    deny_list_score: float = 1.0
    language: str = "en"
    agnostic: bool = True

    @property
    def entities(self) -> tuple[str, ...]:
        return (self.entity,)

    def with_deny_list(self, words, score: float = 1.0) -> PatternRecognizer:
        return replace(self, deny_list=tuple(words), deny_list_score=score)

    def spans(self, text: Column, order: int, columns: dict[str, Column] | None = None) -> Column:
        parts = [self._scan(text, p, order) for p in self.patterns]
        if self.deny_list:
            words = "|".join(re.escape(w) for w in self.deny_list)
            found = matches(text, rf"(?i)\b(?:{words})\b")
            parts.append(F.transform(found, lambda s: result(self.entity, s["start"], s["end"], F.lit(self.deny_list_score), None, s["match"], order)))
        if len(parts) == 1:
            return parts[0]
        return remove_contained(F.concat(*parts)) if parts else none()

    def _scan(self, text: Column, p: Pattern, order: int) -> Column:
        gate = None  # a cheap test that every match passes
        if "|" not in p.regex and re.match(r"(?:\(\?i\))?\\b\\d(?![*?{])|(?:\(\?i\))?\\b\\d\{[1-9]", p.regex):
            gate = text.rlike(r"(?U)\d")
        elif "@[" in p.regex and not re.search(r"[|(]", p.regex):
            gate = text.contains("@")
        found = matches(text, p.regex, gate)

        def one(s: Column, verdict: Column) -> Column:
            score = F.when(verdict, 1.0).otherwise(p.score) if self.validator else F.lit(p.score)
            return result(self.entity, s["start"], s["end"], score, explanation(self.name, score, p.name, p.regex, p.score, validation=verdict), s["match"], order)

        if not self.validator:
            return F.transform(found, lambda s: one(s, F.lit(None).cast("boolean")))
        checked = F.transform(found, lambda s: let(self.validator(s["match"]), lambda v: F.struct(s.alias("s"), v.alias("v"))))
        return F.transform(F.filter(checked, lambda x: x["v"].isNull() | x["v"]), lambda x: one(x["s"], x["v"]))


def _order(*keys: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for k in reversed(keys):
            x, y = k(a), k(b)
            out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
        return out

    return compare


def remove_contained(spans: Column) -> Column:
    """Of one recognizer's spans, those inside another with as high a score go; a wider one with a lower score takes nothing away."""
    inside = lambda k, s: (k["start"] <= s["start"]) & (k["end"] >= s["end"]) & (k["score"] >= s["score"])

    def several(spans: Column) -> Column:
        ordered = F.array_sort(spans, _order(lambda s: s["start"], lambda s: -s["byte_len"], lambda s: -s["score"]))
        kept = F.aggregate(ordered, none(), lambda kept, s: F.when(F.exists(kept, lambda k: inside(k, s)), kept).otherwise(F.concat(kept, F.array(s))))
        return F.when(F.size(spans) < 2, spans).otherwise(kept)

    return let(spans, several)


def resolve_conflicts(spans: Column) -> Column:
    """Greedy by score, then length in bytes, then start, then registration: what overlaps a kept span goes. In order of start, longer first."""
    meets = lambda k, s: (k["start"] < s["end"]) & (s["start"] < k["end"])

    def several(spans: Column) -> Column:
        ordered = F.array_sort(spans, _order(lambda s: -s["score"], lambda s: -s["byte_len"], lambda s: s["start"], lambda s: s["ord"]))
        kept = F.aggregate(ordered, none(), lambda kept, s: F.when(F.exists(kept, lambda k: meets(k, s)), kept).otherwise(F.concat(kept, F.array(s))))
        return F.when(F.size(spans) < 2, spans).otherwise(F.array_sort(kept, _order(lambda s: s["start"], lambda s: -s["end"])))

    return let(spans, several)


@dataclass(frozen=True)
class ContextEnhancer:
    factor: float = 0.35
    floor: float = 0.4
    prefix: int = 5
    suffix: int = 0

    def words_before(self, text: Column, start: Column) -> Column:
        """The last `prefix` tokens that end at or before start, in order, lower-cased."""
        back = F.reverse(F.substring(text, F.lit(1), start))
        inside = F.substring(text, start + 1, F.lit(1)).rlike(TOKEN)
        back = F.when(inside, F.regexp_replace(back, f"^{TOKEN}++", "")).otherwise(back)  # a token cut by the span's start
        near = F.regexp_extract(back, f"^(?:[^\\p{{IsAlphabetic}}\\p{{N}}_]*+{TOKEN}++){{0,{self.prefix}}}", 0)
        return F.regexp_extract_all(F.lower(F.reverse(near)), F.lit(f"{TOKEN}+"), F.lit(0))

    def words_after(self, text: Column, end: Column) -> Column:
        rest = F.substring(text, end + 1, F.length(text))
        cut = F.substring(text, end, F.lit(1)).rlike(TOKEN)
        rest = F.when(cut, F.regexp_replace(rest, f"^{TOKEN}++", "")).otherwise(rest)
        near = F.regexp_extract(rest, f"^(?:[^\\p{{IsAlphabetic}}\\p{{N}}_]*+{TOKEN}++){{0,{self.suffix}}}", 0)
        return F.regexp_extract_all(F.lower(near), F.lit(f"{TOKEN}+"), F.lit(0))

    def boost(self, spans: Column, text: Column, context: tuple[str, ...], extra: tuple[str, ...] = ()) -> Column:
        """Spans below score 1 with a context word near them, or in the caller's list, rise by `factor`, to `floor` at least."""
        if not context:
            return spans
        words = F.array(*[F.lit(w.lower()) for w in context])
        listed = [w for w in dict.fromkeys(x.lower() for x in context) if w in {x.lower() for x in extra}]

        def one(s: Column) -> Column:
            near = self.words_before(text, s["start"])
            near = F.concat(near, self.words_after(text, s["end"])) if self.suffix else near
            found = F.get(F.filter(near, lambda w: F.array_contains(words, w)), 0)
            found = F.coalesce(found, F.lit(listed[0])) if listed else found

            def raised(w: Column) -> Column:
                new = F.greatest(F.least(s["score"] + F.lit(self.factor), F.lit(1.0)), F.lit(self.floor))
                e = s["explanation"].withField("score", new).withField("score_context_improvement", new - s["score"]).withField("supportive_context_word", w)
                return F.when(w.isNull(), s).otherwise(s.withField("score", new).withField("explanation", F.when(s["explanation"].isNotNull(), e)))

            return F.when(s["score"] >= 1.0, s).otherwise(let(found, raised))

        return F.transform(spans, one)


def predefined() -> list[PatternRecognizer]:
    out: dict[str, PatternRecognizer] = {}
    for entity, name, pattern, regex, score, validator, context in PATTERNS:
        p = Pattern(pattern, regex, score)
        if name in out:
            out[name] = replace(out[name], patterns=(*out[name].patterns, p))
        else:
            out[name] = PatternRecognizer(name, entity, (p,), VALIDATORS.get(validator), tuple(context.split(", ")))
    return list(out.values())


@dataclass(frozen=True)
class NerRecognizer:
    """Maps the labels of an entity column, made by a tagger of the caller's, to entity types; others are skipped."""

    column: str = "ner_entities"
    # fixed values: labels that are mapped
    labels: dict[str, str] = field(default_factory=lambda: {"PERSON": "PERSON", "PER": "PERSON", "LOC": "LOCATION", "LOCATION": "LOCATION", "GPE": "LOCATION", "ORG": "ORGANIZATION", "ORGANIZATION": "ORGANIZATION", "NORP": "NRP", "DATE": "DATE_TIME", "TIME": "DATE_TIME"})
    name: str = "NerRecognizer"
    context: tuple[str, ...] = ()
    language: str = "en"
    agnostic: bool = True

    @property
    def entities(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.labels.values()))

    def spans(self, text: Column, order: int, columns: dict[str, Column] | None = None) -> Column:
        if not columns or self.column not in columns:
            return none()
        of = F.create_map(*[F.lit(x) for kv in self.labels.items() for x in kv])
        said = F.filter(columns[self.column], lambda e: F.try_element_at(of, e["entity_type"]).isNotNull())
        meta = F.create_map(F.lit("recognizer_name"), F.lit(self.name))
        return F.coalesce(F.transform(said, lambda e: result(F.try_element_at(of, e["entity_type"]), e["start"], e["end"], e["score"], None, F.substring(text, e["start"] + 1, e["end"] - e["start"]), order, meta)), none())


def gazetteer_gate(start: Column, head: Column, proper_noun: bool, pos: tuple[str, ...], tokens: Column | None) -> Column:
    """Whether a name may start with this word: by the tag of the token over `start`, where it has one, else by its case."""
    cased = ~head.rlike(r"^\p{IsLowercase}") if proper_noun else F.lit(True)
    if not pos or tokens is None:
        return cased
    tag = F.get(F.filter(tokens, lambda t: (t["start"] <= start) & (t["end"] > start)), 0)["pos"]
    return F.when(F.coalesce(tag, F.lit("")) != "", tag.isin(*pos)).otherwise(cased)


@dataclass(frozen=True)
class GazetteerRecognizer:
    """Longest runs of words that a name list has, from left to right, at most max_words words each.

    The list is a set in the plan; it must be small (a few thousand names). Larger lists go through sources.gazetteer.gazetteer_spans().
    pos: parts of speech that the first word may have, by a column of tokens; where it has no tag, proper_noun decides.
    """

    name: str
    entity: str
    names: tuple[str, ...]
    score: float = 0.3
    min_len: int = 3
    max_words: int = 1
    case_sensitive: bool = False
    proper_noun: bool = False
    context: tuple[str, ...] = ()
    language: str = "en"
    agnostic: bool = True
    pos: tuple[str, ...] = ()
    tokens_column: str = "tokens"
    WORD = r"[\p{L}\p{N}][\p{L}\p{N}'\-]*"

    @property
    def entities(self) -> tuple[str, ...]:
        return (self.entity,)

    def spans(self, text: Column, order: int, columns: dict[str, Column] | None = None) -> Column:
        fold = (lambda c: c) if self.case_sensitive else F.lower
        known = F.map_from_arrays(F.array(*[F.lit(n) for n in dict.fromkeys(n if self.case_sensitive else n.lower() for n in self.names)]), F.array(*[F.lit(True)] * len(dict.fromkeys(n if self.case_sensitive else n.lower() for n in self.names))))
        words = matches(text, self.WORD)
        tagged = (columns or {}).get(self.tokens_column)

        def at(i: Column) -> Column:
            out = F.lit(None).cast("int")
            for w in range(1, self.max_words + 1):  # later ones are tried first: longest match
                phrase = F.array_join(F.transform(F.slice(words, i + 1, w), lambda x: x["match"]), " ")
                ok = (i + w <= F.size(words)) & (F.length(phrase) >= self.min_len) & F.try_element_at(known, fold(phrase)).isNotNull()
                ok = ok & gazetteer_gate(F.get(words, i)["start"], F.get(words, i)["match"], self.proper_noun, self.pos, tagged)
                out = F.when(ok, F.lit(w)).otherwise(out)
            return out

        start = F.struct(F.lit(0).alias("next"), none().alias("out"))

        def step(a: Column, i: Column) -> Column:
            def hit(w: Column) -> Column:
                s, e = F.get(words, i)["start"], F.get(words, i + w - 1)["end"]
                r = result(self.entity, s, e, F.lit(self.score), explanation(self.name, F.lit(self.score), original=self.score, text=F.concat(F.lit("'"), F.array_join(F.transform(F.slice(words, i + 1, w), lambda x: x["match"]), " "), F.lit("' found in gazetteer"))), F.substring(text, s + 1, e - s), order)
                return F.when(w.isNull(), F.struct((i + 1).alias("next"), a["out"].alias("out"))).otherwise(F.struct((i + w).alias("next"), F.concat(a["out"], F.array(r)).alias("out")))

            return F.when(i < a["next"], a).otherwise(let(at(i), hit))

        places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, start, step, lambda a: a["out"])


