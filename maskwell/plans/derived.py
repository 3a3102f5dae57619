"""Every pattern recognizer over texts derived from the orders' keys, and the same in SQL: its expression, checksum and score.

A template makes a text for each key: `#` is a digit, `A` and `a` letters, `[xyz]` one of x, y and z, all drawn by the key; the rest stands for itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions.validators import HETU_LETTERS, NIF_LETTERS
from maskwell.operators.analyzer import exploded
from maskwell.operators.catalog import PATTERNS
from maskwell.operators.recognizers import predefined
from maskwell.plans.queries import _LUHN, _SUMS, _scan_sql, docs, query

DIGITS, UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

TEMPLATES = {
    "CREDIT_CARD": ["4###-####-####-####", "5[12345]##############"], "CRYPTO": ["0x" + "[0123456789abcdef]" * 40, "bc1q" + "[023456789acdefghj]" * 20],
    "EMAIL_ADDRESS": ["aa.a##@aaaa.example.org"], "IBAN_CODE": ["DE## #### #### #### #### ##", "GB##AAAA##############"],
    "IP_ADDRESS": ["1##.##.2[01234]#.#", "fe##:[0123456789abcdef]###:0:#:#:#:#:1#"], "MAC_ADDRESS": ["##:a#:b#:##:0#:ff"], "URL": ["https://aaa.example.org/a##?q=#"],
    "DATE_TIME": ["1#/0[123456789]/19##", "20##-1[012]-0#"], "IMEI": ["##-######-######-#", "###############"], "VIN": ["[123456789ABCDEFGHJKLMNPRSTUVWXYZ]#A#B#C#[0123456789X]########"],
    "US_SSN": ["###-##-####", "9## ## ####"], "UK_NHS": ["### ### ####"], "UK_NINO": ["[ABCE][ABCE] ## ## ## [ABCD]"], "ES_NIF": ["########[TRWAGMYFPDXBNJZSQVHLCKE]"], "ES_NIE": ["[XYZ]#######[TRWAGMYFPDXBNJZSQVHLCKE]"],
    "PL_PESEL": ["###########"], "SG_NRIC_FIN": ["[STFG]#######[ABCDEFGHIJZ]"], "SG_UEN": ["########A", "#########A"], "AU_ABN": ["## ### ### ###"], "AU_TFN": ["### ### ###"], "AU_ACN": ["### ### ###"],
    "AU_MEDICARE": ["[23456]### ##### #"], "IN_AADHAAR": ["[23456789]### #### ####"], "IN_PAN": ["AAAAA####A"], "IN_VOTER": ["AAA#######"], "IN_PASSPORT": ["A#######"], "IN_VEHICLE_REGISTRATION": ["AA##AA####"],
    "IT_FISCAL_CODE": ["AAAAAA##A##A###A"], "IT_VAT_CODE": ["###########"], "IT_DRIVER_LICENSE": ["AA#######A"], "FI_PERSONAL_IDENTITY_CODE": ["######[-+AB]###[0123456789ABCDEFHJKLMNPRSTUVWXY]"], "CA_SIN": ["### ### ###"],
    "US_ITIN": ["9##-##-####"], "US_PASSPORT": ["#########"], "US_DRIVER_LICENSE": ["A########"], "US_BANK_NUMBER": ["############"], "BR_CPF": ["###.###.###-##"], "BR_CNPJ": ["##.###.###/####-##"], "NL_BSN": ["#########"],
    "TR_TCKN": ["[123456789]##########"], "BE_NRN": ["##.##.##-###.##"], "PT_NIF": ["#########"], "CN_RIC": ["#################[0123456789Xx]"], "RU_SNILS": ["###-###-### ##"], "DE_TAX_ID": ["###########"], "SE_PERSONNUMMER": ["######-####"],
    "ZA_ID": ["#############"], "KR_RRN": ["######-#######"], "JP_MYNUMBER": ["#### #### ####"], "MX_RFC": ["AAAA######A##"], "MX_CURP": ["AAAA######AAAAAA##"], "TW_NATIONAL_ID": ["A#########"],
    "CZ_BIRTH_NUMBER": ["######/####", "######/###"], "CA_POSTAL_CODE": ["[KLMN]#[ABC] #[EGH]#"], "ZA_COMPANY_REGISTRATION": ["20##/######/##"], "ZA_VAT_NUMBER": ["4#########"],
}


def alphabets(template: str) -> list[str]:
    """The characters that each place of a template is drawn from; one character stands for itself."""
    kinds = {"#": DIGITS, "A": UPPER, "a": UPPER.lower()}
    out = []
    for m in re.finditer(r"\[([^\]]+)\]|(.)", template):
        out.append(m[1] or kinds.get(m[2], m[2]))
    return out


def _draws(template: str):
    """(alphabet, multiplier, addend) for each place."""
    return [(a, 7919 * i + 104_729, 31 * i + 17) for i, a in enumerate(alphabets(template))]


def derived_text(templates: list[str], key: Column) -> Column:
    """The templates in turn, between words; a key takes the one of its remainder."""
    out = F.lit(None).cast("string")
    for k, t in enumerate(templates):
        parts = [F.lit(a) if len(a) == 1 else F.substring(F.lit(a), ((key * p + c) % 10_007 % len(a) + 1).cast("int"), F.lit(1)) for a, p, c in _draws(t)]
        out = F.when(key % len(templates) == k, F.concat(F.lit("ref "), *parts, F.lit(" (end)"))).otherwise(out)
    return out


def derived_sql(templates: list[str]) -> str:
    cases = []
    for k, t in enumerate(templates):
        parts = [f"'{a}'" if len(a) == 1 else f"substr('{a}', CAST((k * {p} + {c}) % 10007 % {len(a)} + 1 AS INT), 1)" for a, p, c in _draws(t)]
        cases.append(f"WHEN {k} THEN concat('ref ', {', '.join(parts)}, ' (end)')")
    return f"(SELECT k, CASE k % {len(templates)} {' '.join(cases)} END AS text FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders))"


def _verhoeff() -> tuple[list[int], list[int]]:
    """The products of the dihedral group of order 10, and the powers of the scheme's permutation, from the definitions."""
    turn = lambda a, b: (a + b) % 5 if a < 5 and b < 5 else (a + b - 5) % 5 + 5 if a < 5 else (a - b - 5) % 5 + 5 if b < 5 else (a - b) % 5
    power, powers = list(range(10)), []
    for _ in range(8):
        powers += power
        power = [(1, 5, 7, 6, 2, 8, 3, 0, 9, 4)[x] for x in power]  # fixed values: the permutation
    return [turn(a, b) for a in range(10) for b in range(10)], powers


def _sum(weights: list[int], of: str) -> str:
    return "(" + " + ".join(f"{w} * CAST({of}[{i + 1}] AS INT)" for i, w in enumerate(weights)) + ")"


_PRODUCT, _POWERS = _verhoeff()
_ALNUM = "upper(regexp_replace(match, '[^0-9A-Za-z]', '', 'g'))"
_NIF = f"('{NIF_LETTERS}')[CAST(CAST({{n}} AS BIGINT) % 23 + 1 AS INT)]"

#: verdict of a match: of its digits `id` (and `d`, their list), or of its upper-case letters and digits `u`. Weights and letters are fixed values.
VERDICTS = {
    "us_ssn": "CASE WHEN id[1:3] IN ('000', '666') OR id[1] = '9' OR id[4:5] = '00' OR id[6:9] = '0000' THEN FALSE END",
    "iban": "list_reduce(list_prepend(0, list_transform(string_split(concat(u[5:], u[1:4]), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda r, v: (r * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97) = 1",
    "vin": """CASE WHEN CASE WHEN {w} % 11 = 10 THEN 'X' ELSE CAST({w} % 11 AS VARCHAR) END = u[9] THEN TRUE WHEN u[1] BETWEEN '1' AND '5' THEN FALSE END""".format(w=_sum([8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2], "translate(u, 'ABCDEFGHJKLMNPRSTUVWXYZ', '12345678123457923456789')")),
    "es_nif": f"{_NIF.format(n='u[1:8]')} = u[9]",
    "es_nie": f"{_NIF.format(n='''translate(u[1:8], 'XYZ', '012')''')} = u[9]",
    "sg_nric": f"(CASE WHEN u[1] IN ('S', 'T') THEN 'JZIHGFEDCBA' ELSE 'XWUTRQPNMLK' END)[({_sum([2, 7, 6, 5, 4, 3, 2], 'u[2:8]')} + CASE WHEN u[1] IN ('T', 'G') THEN 4 ELSE 0 END) % 11 + 1] = u[9]",
    "aadhaar": f"list_reduce(list_prepend(0, list_transform(range(0, 12), lambda i: {_POWERS}[(i % 8) * 10 + CAST(id[12 - i] AS INT) + 1])), lambda c, p: {_PRODUCT}[c * 10 + p + 1]) = 0",
    "fi_hetu": f"CASE WHEN upper(match)[7] IN ('-', '+', 'A') THEN ('{HETU_LETTERS}')[CAST(CAST(concat(match[1:6], match[8:10]) AS BIGINT) % 31 + 1 AS INT)] = upper(match)[11] ELSE FALSE END",
    "cn_ric": f"CASE WHEN (12 - {_sum([7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2], 'u')} % 11) % 11 = 10 THEN 'X' ELSE CAST((12 - {_sum([7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2], 'u')} % 11) % 11 AS VARCHAR) END = u[18]",
    "tw_national_id": f"((strpos('ABCDEFGHJKLMNPQRSTUVXYWZIO', u[1]) + 9) // 10 + (strpos('ABCDEFGHJKLMNPQRSTUVXYWZIO', u[1]) + 9) % 10 * 9 + {_sum([8, 7, 6, 5, 4, 3, 2, 1, 1], 'u[2:10]')}) % 10 = 0",
    "crypto": "CAST(NULL AS BOOLEAN)",
}


def _verdict_sql(validator: str) -> str:
    if validator in VERDICTS:
        return VERDICTS[validator]
    n, formula = _SUMS[validator]
    if formula is None:
        return _LUHN.replace("length(d)", "length(id)").replace("CAST(d[i]", "CAST(id[i]")
    if validator == "cz_birth_number":
        return f"CASE WHEN length(id) = 9 THEN NULL ELSE {formula} END"
    return formula


def recognized_sql(entity: str) -> str:
    rows = [(r, s, v) for e, _, _, r, s, v, _ in PATTERNS if e == entity]
    parts = []
    for regex, score, validator in rows:
        found = _scan_sql(derived_sql(TEMPLATES[entity]), "k", "text", [regex], f"CAST({score} AS DOUBLE)")
        if validator:
            ids = f"""SELECT *, regexp_replace("match", '[^0-9]', '', 'g') AS id, {_ALNUM} AS u FROM ({found})"""
            lists = f"SELECT *, list_transform(list_filter(string_split(id, ''), lambda c: c <> ''), lambda c: CAST(c AS INT)) AS d FROM ({ids})"
            checked = f"SELECT *, {_verdict_sql(validator)} AS verdict FROM ({lists})"
            found = f'SELECT k, "start", "end", "match", CASE WHEN verdict THEN CAST(1.0 AS DOUBLE) ELSE score END AS score FROM ({checked}) WHERE verdict IS NULL OR verdict'
        parts.append(f'SELECT k AS o_orderkey, "start", "end", "match", score FROM ({found})')
    return " UNION ALL ".join(parts)


def _recognize(entity: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = next(r for r in predefined() if r.entity == entity)
        df = docs(spark, sf_dir, "orders").select("o_orderkey", derived_text(TEMPLATES[entity], F.col("o_orderkey").cast("long")).alias("text"))
        found = df.withColumn("spans", r.spans(F.col("text"), 0))
        return exploded(found, "o_orderkey").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "start", "end", "match", "score")

    return run


for _entity in TEMPLATES:
    query(f"recognize_{_entity.lower()}", recognized_sql(_entity))(_recognize(_entity))
