"""The analyzer: recognizers, context, threshold, allow list and conflicts as one projection over the text column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions.columns import java_regex
from maskwell.operators.phone import PhoneRecognizer
from maskwell.operators.recognizers import ContextEnhancer, NerRecognizer, none, predefined, resolve_conflicts

PUBLIC = "array<struct<entity_type:string,start:int,end:int,score:double,explanation:struct<recognizer:string,pattern_name:string,pattern:string,original_score:double,score:double,textual_explanation:string,score_context_improvement:double,supportive_context_word:string,validation_result:boolean>,metadata:map<string,string>>>"


def compiles(pattern: str) -> bool:
    """Whether the JVM, which runs the expression, can compile it; others are skipped."""
    from py4j.protocol import Py4JJavaError
    from pyspark import SparkContext
    from pyspark.errors import PySparkException

    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(java_regex(pattern))
    except (Py4JJavaError, PySparkException):
        return False
    return True


@dataclass
class Registry:
    recognizers: list = field(default_factory=list)

    @classmethod
    def with_predefined(cls) -> Registry:
        return cls([*predefined(), PhoneRecognizer(), NerRecognizer()])

    def add(self, recognizer) -> Registry:
        self.recognizers.append(recognizer)
        return self

    def for_language(self, language: str) -> list:
        return [r for r in self.recognizers if r.agnostic or r.language == language]

    def supported_entities(self, language: str = "en") -> list[str]:
        return sorted({e for r in self.for_language(language) for e in r.entities})


@dataclass
class Analyzer:
    """Rows of different languages share one plan; recognizers that are not language-agnostic run on theirs only."""

    registry: Registry = field(default_factory=Registry.with_predefined)
    enhancer: ContextEnhancer = field(default_factory=ContextEnhancer)
    score_threshold: float = 0.0

    def spans(self, text: Column, *, lang: Column | None = None, entities=None, score_threshold: float | None = None, allow_list=(), allow_list_match: str = "exact", context=(), ad_hoc=(), columns: dict[str, Column] | None = None) -> Column:
        """An array of spans for each text, in order of start. Null texts have none.

        Recognizers that the request doesn't need are left out of the plan. Ad-hoc recognizers come after the registered ones and
        run only on rows of their own language.
        """
        text = F.coalesce(text, F.lit(""))
        wanted = set(entities) if entities is not None else None
        parts = []
        for i, r in enumerate([*self.registry.recognizers, *ad_hoc]):
            if wanted is not None and not wanted & set(r.entities):
                continue
            columns_ = dict(columns or {}) | ({"lang": lang} if lang is not None else {})
            found = self.enhancer.boost(r.spans(text, i, columns_), text, r.context, tuple(context))
            if wanted is not None and len(r.entities) > 1:
                found = F.filter(found, lambda s: s["entity_type"].isin(*wanted))
            if i >= len(self.registry.recognizers) or not r.agnostic:
                found = F.when((F.lit("en") if lang is None else lang) == r.language, found).otherwise(none())
            parts.append(found)
        found = F.concat(*parts) if parts else none()
        least = self.score_threshold if score_threshold is None else score_threshold
        if least > 0:
            found = F.filter(found, lambda s: s["score"] >= F.lit(float(least)))
        allowed = self._allowed(text, allow_list, allow_list_match)
        if allowed is not None:
            found = F.filter(found, lambda s: ~allowed(F.substring(text, s["start"] + 1, s["end"] - s["start"])))
        drop = lambda s: F.struct(*[s[c].alias(c) for c in ("entity_type", "start", "end", "score", "explanation", "metadata")])
        return F.transform(resolve_conflicts(found), drop)

    @staticmethod
    def _allowed(text: Column, allow_list, match: str):
        if not allow_list:
            return None
        if match == "exact":
            words = F.array(*[F.lit(w.lower()) for w in allow_list])
            return lambda t: F.array_contains(words, F.lower(t))
        good = [java_regex(p) for p in allow_list if compiles(p)]
        if not good:
            return None

        def hit(t: Column) -> Column:
            out = F.lit(False)
            for p in good:
                out = out | ((F.regexp_extract(t, f"({p})", 1) == t) & (F.length(t) > 0))
            return out

        return hit

    def analyze(self, df: DataFrame, text: str = "text", lang: str | None = None, output: str = "spans", **options) -> DataFrame:
        columns = {c: F.col(c) for c in df.columns if c in ("ner_entities", "tokens")}
        return df.withColumn(output, self.spans(F.col(text), lang=F.col(lang) if lang else None, columns=columns, **options))


def exploded(df: DataFrame, key: str = "doc_id", spans: str = "spans", text: str = "text") -> DataFrame:
    """Long form: one row for each span, offsets as longs."""
    s = F.col("s")
    return df.select(key, text, F.explode(spans).alias("s")).select(key, s["entity_type"].alias("entity_type"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), s["score"].alias("score"), F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"]).alias("match"))
