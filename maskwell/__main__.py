"""Command line: analyze, anonymize and entities."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="maskwell")
    commands = out.add_subparsers(dest="command", required=True)
    analyze = commands.add_parser("analyze", help="print the spans found in a text as JSON")
    anonymize = commands.add_parser("anonymize", help="print a text without what was found; the items go to standard error")
    for p in (analyze, anonymize):
        p.add_argument("--text", required=True)
        p.add_argument("--language", default="en")
        p.add_argument("--entities", help="entity types, with commas between them")
        p.add_argument("--min-score", type=float)
    analyze.add_argument("--allow-list", help="words that are no personal data, with commas between them")
    analyze.add_argument("--context", help="further context words, with commas between them")
    anonymize.add_argument("--operator", default="replace", choices=["replace", "redact", "mask", "hash", "keep"])
    anonymize.add_argument("--new-value")
    anonymize.add_argument("--masking-char", default="*")
    commands.add_parser("entities", help="list the entity types")
    return out


def main(argv: list[str] | None = None) -> int:
    from maskwell.operators.analyzer import Registry
    from maskwell.operators.requests import analyze_request, anonymize_text_request, entity_names

    args = parser().parse_args(argv)
    if args.command == "entities":
        print("\n".join(Registry.with_predefined().supported_entities()))
        return 0
    from pyspark.sql import SparkSession

    listed = lambda s: [w.strip() for w in (s or "").split(",") if w.strip()]
    spark = SparkSession.getActiveSession() or SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    request = {"text": args.text, "language": args.language, "entities": entity_names(args.entities.split(",")) if args.entities is not None else None, "score_threshold": args.min_score}
    if args.command == "analyze":
        print(json.dumps(analyze_request(spark, request | {"allow_list": listed(args.allow_list), "context": listed(args.context)}), indent=2))
    else:
        got = anonymize_text_request(spark, request | {"operator": args.operator, "new_value": args.new_value, "masking_char": args.masking_char})
        print(got["text"])
        print(json.dumps({"items": got["items"]}, indent=2), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
