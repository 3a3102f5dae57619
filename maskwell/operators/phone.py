"""Phone numbers: native candidates, an Arrow function for the numbering plans.

The plans below are a compact approximation of the public numbering plans of some countries: lengths and leading digits, no
lists of assigned areas (of the North American plan the area and exchange must start with 2-9). If the `phonenumbers`
package can be imported it decides instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwell.functions.columns import matches
from maskwell.operators.recognizers import explanation, result

try:
    import phonenumbers as pn
except ImportError:
    pn = None

CANDIDATE = r"\+?\(?\d[\d\-\.\s()]{6,}\d"
SCORE = 0.75

#: region: country code, trunk prefix, expression of the national number, and lengths of its groups as written
PLANS = {
    "US": ("1", "1", r"[2-9]\d{2}[2-9]\d{6}", [(3, 3, 4)]),
    "GB": ("44", "0", r"(?:1\d{8,9}|2\d{9}|3\d{9}|7\d{9}|8\d{9})", [(2, 4, 4), (3, 3, 4), (4, 6), (4, 3, 3), (5, 5)]),
    "FR": ("33", "0", r"[1-79]\d{8}", [(1, 2, 2, 2, 2), (2, 2, 2, 2, 2)]),
    "DE": ("49", "0", r"(?:1[5-7]\d{8,9}|[2-9]\d{6,10})", [(2, 8), (3, 7), (3, 8), (4, 6), (4, 7)]),
    "ES": ("34", "", r"[6-9]\d{8}", [(3, 2, 2, 2), (3, 3, 3), (2, 3, 2, 2)]),
    "IT": ("39", "", r"(?:0\d{5,10}|3\d{8,9})", [(3, 3, 4), (2, 8), (3, 7)]),
    "NL": ("31", "0", r"[1-79]\d{8}", [(2, 3, 4), (1, 8), (3, 3, 3)]),
    "PT": ("351", "", r"[29]\d{8}", [(3, 3, 3)]),
    "IN": ("91", "0", r"[6-9]\d{9}", [(5, 5)]),
    "AU": ("61", "0", r"[2-478]\d{8}", [(1, 4, 4), (2, 4, 4), (3, 3, 3)]),
}

#: Regions that are tried for a language, first to last; others try all.
REGIONS = {"en": ["US", "GB", "AU", "IN"], "fr": ["FR"], "de": ["DE"], "es": ["ES"], "it": ["IT"], "nl": ["NL"], "pt": ["PT"]}


def national(candidate: str, region: str) -> str | None:
    code, trunk, rule, _ = PLANS[region]
    d = re.sub(r"\D", "", candidate)
    if candidate.lstrip().startswith(("+", "(+")):
        if not d.startswith(code):
            return None
        d = d[len(code) :]
    elif trunk and d.startswith(trunk):
        d = d[len(trunk) :]
    return d if re.fullmatch(rule, d) else None


def lenient(candidate: str, region: str) -> bool:
    """Written with a plus, without separators (9 to 15 digits), or in the groups of the national form."""
    t = candidate.strip()
    if t.startswith("+"):
        return True
    groups = [len(g) for g in re.findall(r"\d+", t)]
    if len(groups) == 1:
        return 9 <= groups[0] <= 15
    trunk = PLANS[region][1]
    allowed = [list(g) for g in PLANS[region][3]]
    allowed += [[g[0] + len(trunk), *g[1:]] for g in allowed] if trunk else []
    allowed += [[len(trunk), *g] for g in allowed] if trunk else []
    return groups in allowed


def region_of(candidate: str, regions: list[str]) -> str | None:
    for r in regions:
        if pn:
            try:
                n = pn.parse(candidate, r)
            except pn.NumberParseException:
                continue
            if pn.is_valid_number(n) and lenient(candidate, r if r in PLANS else "US"):
                return r
        elif national(candidate, r) and lenient(candidate, r):
            return r
    return None


def _regions(found: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for candidates, languages in found:
        out = []
        for c, lang in zip(candidates, languages, strict=True):
            regions = REGIONS.get(re.split("[-_]", (lang or "").lower())[0], list(PLANS))
            out.append([region_of(x, regions) for x in c])
        yield pd.Series(out)


@dataclass(frozen=True)
class PhoneRecognizer:
    name: str = "PhoneRecognizer"
    entity: str = "PHONE_NUMBER"
    context: tuple[str, ...] = ("phone", "number", "telephone", "cell", "mobile", "call", "tel")
    language: str = "en"
    agnostic: bool = True
    lang_column: str = "lang"

    @property
    def entities(self) -> tuple[str, ...]:
        return (self.entity,)

    def spans(self, text: Column, order: int, columns: dict[str, Column] | None = None) -> Column:
        found = matches(text, CANDIDATE)
        lang = (columns or {}).get(self.lang_column, F.lit("en"))
        said = F.pandas_udf(_regions, "array<string>")(F.transform(found, lambda s: s["match"]), lang)
        both = F.filter(F.arrays_zip(found.alias("s"), said.alias("r")), lambda x: x["r"].isNotNull())

        def one(x: Column) -> Column:
            s, why = x["s"], F.concat(F.lit("validated as a "), x["r"], F.lit(" phone number"))
            return result(self.entity, s["start"], s["end"], F.lit(SCORE), explanation(self.name, F.lit(SCORE), original=SCORE, text=why, validation=F.lit(True)), s["match"], order)

        return F.transform(both, one)
