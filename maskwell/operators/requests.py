"""Requests and results in the shapes of JSON, one text at a time or a column of them."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from maskwell.operators.analyzer import Analyzer
from maskwell.operators.anonymizer import Anonymizer, OperatorConfig, config_of

SPANS = "array<struct<entity_type:string,start:int,end:int,score:double>>"


def results_json(spans: Column) -> Column:
    """Spans as a JSON string; a null explanation and empty metadata are left out."""
    return F.to_json(F.transform(spans, lambda s: s.withField("metadata", F.when(F.size(s["metadata"]) > 0, s["metadata"]))))


def _row(spark: SparkSession, text: str, language: str):
    return spark.createDataFrame([(text, language)], "text string, lang string")


def analyze_request(spark: SparkSession, request: dict[str, Any], analyzer: Analyzer | None = None) -> list[dict]:
    """{text, language?, entities?, score_threshold?, allow_list?, context?} to a list of results."""
    a = analyzer or Analyzer()
    df = a.analyze(
        _row(spark, request["text"], request.get("language", "en")), lang="lang", entities=request.get("entities"), score_threshold=request.get("score_threshold"), allow_list=request.get("allow_list") or (), context=tuple(request.get("context") or ())
    )
    return json.loads(df.select(results_json(F.col("spans"))).first()[0])


def _anonymized(spark: SparkSession, df, operators: dict[str, OperatorConfig]) -> dict:
    got = Anonymizer().anonymize(df, operators).select(F.to_json("anonymized")).first()[0]
    return json.loads(got)


def anonymize_request(spark: SparkSession, request: dict[str, Any]) -> dict:
    """{text, analyzer_results?, anonymizers?} to {text, items}."""
    spans = [(r["entity_type"], r["start"], r["end"], float(r.get("score", 0.0))) for r in request.get("analyzer_results") or []]
    return _anonymized(spark, spark.createDataFrame([(request["text"], spans)], f"text string, spans {SPANS}"), config_of(request.get("anonymizers") or {}))


def anonymize_text_request(spark: SparkSession, request: dict[str, Any], analyzer: Analyzer | None = None) -> dict:
    """{text, language?, operator?, new_value?, masking_char?, entities?, score_threshold?}: detected and de-identified with one operator."""
    names = {"replace": ("new_value",), "mask": ("masking_char",)}
    operator = request.get("operator", "replace")
    params = {n: request[n] for n in names.get(operator, ()) if request.get(n) is not None}
    df = (analyzer or Analyzer()).analyze(_row(spark, request["text"], request.get("language", "en")), lang="lang", entities=request.get("entities"), score_threshold=request.get("score_threshold"))
    return _anonymized(spark, df, {"DEFAULT": OperatorConfig(operator, params)})


def entity_names(names) -> list[str] | None:
    """Entity types as asked for by a caller: trimmed and in upper case; empty ones are left out, None asks for all."""
    return None if names is None else [n.strip().upper() for n in names if n.strip()]
