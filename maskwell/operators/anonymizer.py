"""De-identification: operators as Columns, spliced into the text by one fold over a document's spans; and the way back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions.columns import let
from maskwell.operators.recognizers import EXPLANATION, RESULT, resolve_conflicts

ITEMS = "array<struct<start:int,end:int,entity_type:string,text:string,operator:string,score:double>>"
ANONYMIZE, DEANONYMIZE = "anonymize", "deanonymize"


class OperatorError(ValueError):
    """Unknown operator or bad parameters."""


@dataclass(frozen=True)
class OperatorConfig:
    operator: str
    params: dict[str, Any] = field(default_factory=dict)

    def text(self, name: str) -> str | None:
        v = self.params.get(name)
        return v if isinstance(v, str) else None

    def integer(self, name: str) -> int | None:
        v = self.params.get(name)
        return v if isinstance(v, int) and not isinstance(v, bool) else None

    def boolean(self, name: str) -> bool | None:
        v = self.params.get(name)
        return v if isinstance(v, bool) else None


def _replace(text: Column, entity: Column, c: OperatorConfig) -> Column:
    return F.lit(c.text("new_value")) if c.text("new_value") else F.concat(F.lit("<"), F.coalesce(entity, F.lit("ENTITY")), F.lit(">"))


def _redact(text: Column, entity: Column, c: OperatorConfig) -> Column:
    return F.lit("")


def _keep(text: Column, entity: Column, c: OperatorConfig) -> Column:
    return text


def _mask(text: Column, entity: Column, c: OperatorConfig) -> Column:
    char = c.text("masking_char") if c.text("masking_char") is not None else "*"
    if len(char) != 1:
        raise OperatorError("masking_char must be one character")
    n = c.integer("chars_to_mask")
    if n is not None and n < 0:
        raise OperatorError("chars_to_mask must not be negative")
    size = F.length(text)
    k = size if n is None else F.least(F.lit(n), size)
    bar = F.repeat(F.lit(char), k)
    return F.concat(F.substring(text, F.lit(1), size - k), bar) if c.boolean("from_end") else F.concat(bar, F.substring(text, k + 1, size))


def _hash(text: Column, entity: Column, c: OperatorConfig) -> Column:
    kind = c.text("hash_type") or "sha256"
    if kind not in ("sha256", "sha512"):
        raise OperatorError(f"unknown hash_type {kind}")
    return F.sha2(text, int(kind[3:]))


def _key(c: OperatorConfig) -> str:
    key = c.text("key")
    if key is None or len(key.encode()) not in (16, 24, 32):
        raise OperatorError("key must have 16, 24 or 32 bytes")
    return key


def _encrypt(text: Column, entity: Column, c: OperatorConfig) -> Column:
    """AES-CBC with a random vector in front, as one line of Base64."""
    return F.regexp_replace(F.base64(F.aes_encrypt(text, F.lit(_key(c)), F.lit("CBC"), F.lit("PKCS"))), "[\r\n]", "")


def _decrypt(text: Column, entity: Column, c: OperatorConfig) -> Column:
    return F.validate_utf8(F.aes_decrypt(F.unbase64(F.trim(text)), F.lit(_key(c)), F.lit("CBC"), F.lit("PKCS")).cast("string"))


# ---------------------------------------------------------------- surrogates

# Names that surrogates are drawn from.
FIRST = ["Avery", "Blake", "Casey", "Drew", "Ellis", "Finley", "Gray", "Harper", "Indigo", "Jules", "Kai", "Lane", "Morgan", "Noel", "Oakley", "Parker"]
LAST = ["Archer", "Bishop", "Carver", "Dalton", "Easton", "Fletcher", "Granger", "Holloway", "Ingram", "Keller", "Lawson", "Mercer", "Norwood", "Porter", "Sawyer", "Thatcher"]
CITIES = ["Ashford", "Brookhaven", "Cedarville", "Dunmore", "Eastport", "Fairview", "Glenwood", "Harborview"]
COMPANIES = ["Alder Works", "Beacon Group", "Cobalt Labs", "Delta Partners", "Ember Systems", "Foxglove Ltd", "Granite Holdings", "Harbor Trading"]

#: What a surrogate is put together from: literals, lists to pick from, and ranges (least, beyond the last, digits at least).
DIGIT = (0, 10, 1)
SURROGATES: dict[str, list] = {
    "PERSON": [FIRST, " ", LAST],
    "EMAIL_ADDRESS": [[x.lower() for x in FIRST], ".", [x.lower() for x in LAST], "@example.com"],
    "PHONE_NUMBER": ["+1 (", *[DIGIT] * 3, ") ", *[DIGIT] * 3, "-", *[DIGIT] * 4],
    "CREDIT_CARD": [DIGIT] * 15,
    "US_SSN": [*[DIGIT] * 3, "-", *[DIGIT] * 2, "-", *[DIGIT] * 4],
    "IP_ADDRESS": [(1, 224, 1), ".", (0, 256, 1), ".", (0, 256, 1), ".", (1, 255, 1)],
    "LOCATION": [CITIES],
    "ORGANIZATION": [COMPANIES],
    "NRP": [COMPANIES],
    "DATE_TIME": [(1950, 2020, 4), "-", (1, 13, 2), "-", (1, 29, 2)],
}


def luhn_digit(body: Column) -> Column:
    """The digit that makes a string of digits pass the Luhn test."""
    twice = F.transform(F.reverse(F.split(body, "")), lambda c, i: F.when(i % 2 == 0, F.element_at(F.array(*[F.lit(2 * x // 10 + 2 * x % 10) for x in range(10)]), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(twice, F.lit(0), lambda a, x: a + x), F.lit(10)).cast("string")


def surrogate(entity: Column, text: Column) -> Column:
    """A made-up value of the entity's form, drawn by the text's SHA-256, so that one text always has the same one. The k-th draw is its
    k-th group of four hexadecimal digits; a form has 16 draws at most."""

    def of(digest: Column) -> Column:
        def made(parts: list) -> Column:
            out, k = [], 0
            for p in parts:
                if isinstance(p, str):
                    out.append(F.lit(p))
                    continue
                draw, k = F.conv(F.substring(digest, 4 * k + 1, 4), 16, 10).cast("int"), k + 1
                if isinstance(p, list):
                    out.append(F.element_at(F.array(*[F.lit(x) for x in p]), draw % len(p) + 1))
                else:
                    number = (draw % (p[1] - p[0]) + p[0]).cast("string")
                    out.append(F.lpad(number, p[2], "0") if p[2] > 1 else number)
            return F.concat(*out)

        out = F.concat(F.lit("<"), F.coalesce(entity, F.lit("ENTITY")), F.lit(">"))
        for e, parts in SURROGATES.items():
            value = made(parts)
            out = F.when(entity == e, let(value, lambda b: F.concat(b, luhn_digit(b))) if e == "CREDIT_CARD" else value).otherwise(out)
        return out

    return let(F.sha2(text, 256), of)


def _surrogate(text: Column, entity: Column, c: OperatorConfig) -> Column:
    return surrogate(entity, text)


# ---------------------------------------------------------------- engines

Operator = Callable[[Column, Column, OperatorConfig], Column]


class Factory:
    """Operators by name and direction; later ones replace earlier ones of the same name."""

    def __init__(self):
        self._by: dict[tuple[str, str], Operator] = {(n, ANONYMIZE): f for n, f in (("replace", _replace), ("redact", _redact), ("mask", _mask), ("hash", _hash), ("keep", _keep), ("encrypt", _encrypt), ("surrogate", _surrogate))}
        self._by["decrypt", DEANONYMIZE] = _decrypt

    def add(self, name: str, operator: Operator, direction: str = ANONYMIZE) -> Factory:
        """operator(text, entity_type, config) -> Column. Built-in functions stay in the JVM; wrap a pandas UDF around whole columns elsewhere."""
        self._by[name, direction] = operator
        return self

    def names(self, direction: str = ANONYMIZE) -> list[str]:
        return sorted(n for n, d in self._by if d == direction)

    def get(self, name: str, direction: str) -> Operator:
        if (name, direction) not in self._by:
            raise OperatorError(f"no operator {name} to {direction}")
        return self._by[name, direction]


@dataclass
class Anonymizer:
    factory: Factory = field(default_factory=Factory)

    def _apply(self, s: Column, piece: Column, operators: dict[str, OperatorConfig], fallback: str, direction: str) -> Column:
        """The new text and the operator's name for one span: by entity, else DEFAULT, else the fallback."""
        rest = operators.get("DEFAULT", OperatorConfig(fallback))

        def one(c: OperatorConfig) -> Column:
            return F.struct(self.factory.get(c.operator, direction)(piece, s["entity_type"], c).alias("text"), F.lit(c.operator).alias("operator"))

        named = [(e, c) for e, c in operators.items() if e != "DEFAULT"]
        try:
            out = one(rest)
        except OperatorError as e:
            if "DEFAULT" in operators:
                raise
            out = F.struct(F.raise_error(F.lit(str(e))).cast("string").alias("text"), F.lit(fallback).alias("operator"))  # the fallback lacks parameters: only its use fails
        for e, c in reversed(named):
            out = F.when(s["entity_type"] == e, one(c)).otherwise(out)
        return out

    def _splice(self, text: Column, spans: Column, operators, fallback: str, direction: str) -> Column:
        """text and items, the last first; a span that meets the one before it is skipped."""
        start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"), F.array().cast(ITEMS).alias("items"))

        def step(a: Column, s: Column) -> Column:
            piece = F.substring(text, s["start"] + 1, s["end"] - s["start"])

            def put(new: Column) -> Column:
                before = F.concat(a["out"], F.substring(text, a["pos"] + 1, s["start"] - a["pos"]))
                at = F.length(before)
                score = s["score"] if direction == ANONYMIZE else F.lit(None).cast("double")
                item = F.struct(at.alias("start"), (at + F.length(new["text"])).alias("end"), s["entity_type"].alias("entity_type"), new["text"].alias("text"), new["operator"].alias("operator"), score.alias("score"))
                return F.struct(s["end"].alias("pos"), F.concat(before, new["text"]).alias("out"), F.concat(a["items"], F.array(item)).alias("items"))

            bad = (s["start"] < 0) | (s["end"] < s["start"]) | (s["end"] > F.length(text))
            done = F.when(s["start"] < a["pos"], a).otherwise(let(self._apply(s, piece, operators, fallback, direction), put))
            return F.when(bad, F.raise_error(F.lit("a span lies outside its text"))).otherwise(done)

        end = lambda a: F.struct(F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))).alias("text"), F.reverse(a["items"]).alias("items"))
        return F.aggregate(spans, start, step, end)

    def anonymize(self, df: DataFrame, operators: dict[str, OperatorConfig] | None = None, text: str = "text", spans: str = "spans", output: str = "anonymized") -> DataFrame:
        """Adds a struct of the new text and its items. Null texts stay null; conflicts among the spans are resolved first."""
        operators = operators or {}
        for c in operators.values():
            self.factory.get(c.operator, ANONYMIZE)
        nothing = F.lit(None).cast(EXPLANATION), F.lit(None).cast("map<string,string>")

        def span(x: Column) -> Column:
            start, end = x["start"].cast("int"), x["end"].cast("int")
            size = F.octet_length(F.substring(F.col(text), start + 1, end - start))
            values = (x["entity_type"], start, end, x["score"].cast("double"), *nothing, size, F.lit(0))
            names = ("entity_type", "start", "end", "score", "explanation", "metadata", "byte_len", "ord")
            return F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])

        kept = resolve_conflicts(F.transform(spans, span))
        new = let(F.coalesce(kept, F.array().cast(RESULT)), lambda k: self._splice(F.col(text), k, operators, "replace", ANONYMIZE))
        return df.withColumn(output, F.when(F.col(text).isNotNull(), new))

    def deanonymize(self, df: DataFrame, operators: dict[str, OperatorConfig] | None = None, text: str = "text", items: str = "items", output: str = "restored") -> DataFrame:
        """The way back, from the items of anonymize(): in order of start, without conflict resolution."""
        operators = operators or {}
        for c in operators.values():
            self.factory.get(c.operator, DEANONYMIZE)
        ordered = F.array_sort(F.col(items), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
        new = self._splice(F.col(text), ordered, operators, "decrypt", DEANONYMIZE)
        return df.withColumn(output, F.when(F.col(text).isNotNull(), new))


def config_of(request: dict[str, dict]) -> dict[str, OperatorConfig]:
    """Operators from a JSON-shaped request {entity: {"type": ..., parameters}}; what isn't an object is skipped."""
    return {e: OperatorConfig(c.get("type", "replace"), {k: v for k, v in c.items() if k != "type"}) for e, c in request.items() if isinstance(c, dict)}
