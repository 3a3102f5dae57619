"""Registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions.validators import VALIDATORS
from maskwell.operators.analyzer import Analyzer, Registry, exploded
from maskwell.operators.anonymizer import FIRST, LAST, Anonymizer, OperatorConfig
from maskwell.operators.catalog import PATTERNS
from maskwell.operators.nlp import decode_bio, tokens
from maskwell.operators.phone import PhoneRecognizer
from maskwell.operators.recognizers import GazetteerRecognizer, NerRecognizer, Pattern, PatternRecognizer, predefined
from maskwell.sources.gazetteer import gazetteer_spans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- scans

_REGEX = {(e, p): r for e, _, p, r, *_ in PATTERNS}


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _scan_sql(table: str, key: str, text: str, regexes: list[str], score: str = "CAST({base} AS DOUBLE)", where: str = "TRUE") -> str:
    one = []
    for r in regexes:
        re = _literal(r)
        one.append(f"""
SELECT {key}, "start", "start" + length("match") AS "end", "match" FROM (
  SELECT {key}, m[i] AS "match", CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS "start"
  FROM (SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, regexp_extract_all({text}, {re}) AS m, string_split_regex({text}, {re}) AS g FROM {table}))
)""")
    return f'SELECT {key}, "start", "end", "match", {score} AS score FROM ({" UNION ALL ".join(one)}) WHERE {where}'


_LUHN = """(list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 1 THEN CASE WHEN 2 * CAST(d[i] AS INT) > 9 THEN 2 * CAST(d[i] AS INT) - 9 ELSE 2 * CAST(d[i] AS INT) END ELSE CAST(d[i] AS INT) END)) % 10 = 0)"""


def _scan(entity: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = next(r for r in predefined() if r.entity == entity)
        df = docs(spark, sf_dir, table)
        found = df.select(key, F.col(text).alias("text"), r.spans(F.col(text), 0).alias("spans"))
        return exploded(found, key).select(key, "start", "end", "match", "score")

    return run


for _entity, _table, _key, _text in (
    ("EMAIL_ADDRESS", "documents", "doc_id", "text"), ("IP_ADDRESS", "documents", "doc_id", "text"), ("MAC_ADDRESS", "documents", "doc_id", "text"), ("DATE_TIME", "documents", "doc_id", "text"),
    ("US_BANK_NUMBER", "documents", "doc_id", "text"), ("URL", "pages", "page_id", "html"), ("UK_NINO", "documents", "doc_id", "text"), ("IN_PAN", "documents", "doc_id", "text"),
):
    _r = [(r, s) for e, _, _, r, s, *_ in PATTERNS if e == _entity]
    query(f"scan_{_entity.lower()}_{_table}", _scan_sql(_table, _key, _text, [r for r, _ in _r], f"CAST({_r[0][1]} AS DOUBLE)"))(_scan(_entity, _table, _key, _text))

_card = _scan_sql("documents", "doc_id", "text", [_REGEX["CREDIT_CARD", "All Credit Cards (weak)"]], "CAST(1.0 AS DOUBLE)")
query("scan_credit_card_documents", f"""SELECT doc_id, "start", "end", "match", score FROM (SELECT *, regexp_replace("match", '[^0-9]', '', 'g') AS d FROM ({_card})) WHERE length(d) BETWEEN 12 AND 19 AND {_LUHN}""")(_scan("CREDIT_CARD"))

# ---------------------------------------------------------------- validators on derived identifiers

_D = "list_transform(string_split(id, ''), lambda c: CAST(c AS INT))"


def _weights(w: list[int]) -> str:
    return "(" + " + ".join(f"({x}) * d[{i + 1}]" for i, x in enumerate(w)) + ")"


# Lengths, weights and moduli of the public checksums.
_SUMS = {
    "credit_card": (16, None), "imei": (15, None), "za_id": (13, None), "it_vat": (11, None), "ca_sin": (9, None), "se_pnr": (10, None),
    "nhs": (10, f"CASE 11 - {_weights(list(range(10, 1, -1)))} % 11 WHEN 11 THEN 0 ELSE 11 - {_weights(list(range(10, 1, -1)))} % 11 END = d[10]"),
    "pesel": (11, f"(10 - {_weights([1, 3, 7, 9, 1, 3, 7, 9, 1, 3])} % 10) % 10 = d[11]"),
    "au_abn": (11, f"(10 * (CASE WHEN d[1] = 0 THEN 255 ELSE d[1] - 1 END) + {_weights([0, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19])}) % 89 = 0"),
    "au_tfn": (9, f"{_weights([1, 4, 3, 7, 5, 8, 6, 9, 10])} % 11 = 0"),
    "au_acn": (9, f"(10 - {_weights([8, 7, 6, 5, 4, 3, 2, 1])} % 10) % 10 = d[9]"),
    "au_medicare": (10, f"d[1] BETWEEN 2 AND 6 AND {_weights([1, 3, 7, 9, 1, 3, 7, 9])} % 10 = d[9]"),
    "nl_bsn": (9, f"{_weights([9, 8, 7, 6, 5, 4, 3, 2, -1])} % 11 = 0"),
    "tr_tckn": (11, f"d[1] <> 0 AND (({_weights([7, -1, 7, -1, 7, -1, 7, -1, 7])} % 10) + 10) % 10 = d[10] AND {_weights([1] * 10)} % 10 = d[11]"),
    "be_nrn": (11, "CAST(id[10:11] AS BIGINT) IN (97 - CAST(id[1:9] AS BIGINT) % 97, 97 - (2000000000 + CAST(id[1:9] AS BIGINT)) % 97)"),
    "pt_nif": (9, f"CASE WHEN 11 - {_weights(list(range(9, 1, -1)))} % 11 >= 10 THEN 0 ELSE 11 - {_weights(list(range(9, 1, -1)))} % 11 END = d[9]"),
    "ru_snils": (11, f"CASE {_weights(list(range(9, 0, -1)))} % 101 WHEN 100 THEN 0 ELSE {_weights(list(range(9, 0, -1)))} % 101 END = 10 * d[10] + d[11]"),
    "kr_rrn": (13, f"(11 - {_weights([2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])} % 11) % 10 = d[13]"),
    "br_cpf": (11, f"len(list_distinct(d)) > 1 AND ({_weights(list(range(10, 1, -1)))} * 10) % 11 % 10 = d[10] AND ({_weights(list(range(11, 1, -1)))} * 10) % 11 % 10 = d[11]"),
    "br_cnpj": (14, f"len(list_distinct(d)) > 1 AND ({_weights([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} * 10) % 11 % 10 = d[13] AND ({_weights([6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} * 10) % 11 % 10 = d[14]"),
    "de_tax": (11, "(11 - list_reduce(list_prepend(10, d[1:10]), lambda p, x: CASE WHEN (x + p) % 10 = 0 THEN 10 ELSE (x + p) % 10 END * 2 % 11)) % 10 = d[11]"),
    "cz_birth_number": (10, "CAST(id AS BIGINT) % 11 = 0 OR (CAST(id AS BIGINT) // 10 % 11 = 10 AND d[10] = 0)"),
}


def _validate(name: str, n: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = docs(spark, sf_dir, "orders").select("o_orderkey", F.expr(f"lpad(cast((cast(o_orderkey as bigint) * 7919 + 13) * 104729 % {10 ** min(n, 15)} as string), {n}, '7')").alias("id"))
        return ids.select("o_orderkey", "id", VALIDATORS[name](F.col("id")).alias("verdict"))

    return run


for _name, (_n, _formula) in _SUMS.items():
    _ids = f"SELECT o_orderkey, lpad(CAST((CAST(o_orderkey AS BIGINT) * 7919 + 13) * 104729 % {10 ** min(_n, 15)} AS VARCHAR), {_n}, '7') AS id FROM orders"
    if _formula is None:
        _sql = f"SELECT o_orderkey, id, {_LUHN} AS verdict FROM (SELECT *, id AS d FROM ({_ids}))"
    else:
        _sql = f"SELECT o_orderkey, id, {_formula} AS verdict FROM (SELECT *, {_D} AS d FROM ({_ids}))"
    query(f"validate_{_name}", _sql)(_validate(_name, _n))

# ---------------------------------------------------------------- scoring, filters, conflicts

_EMAIL = _literal(_REGEX["EMAIL_ADDRESS", "Email (medium)"])


def _few(*entities: str) -> Analyzer:
    return Analyzer(Registry([r for r in predefined() if r.entity in entities]))


_EMAILS = "SELECT doc_id, unnest(regexp_extract_all(text, " + _EMAIL + ")) AS m FROM documents"


@query("allow_list_exact", "SELECT o_orderkey, 'A' || (o_orderkey % 5) || '@b.example' AS match FROM orders WHERE o_orderkey % 5 NOT IN (1, 3)")
def allow_list_exact(spark, sf_dir):
    """Two of five addresses are listed, whatever their case."""
    df = docs(spark, sf_dir, "orders").select("o_orderkey", F.format_string("mail A%d@b.example now", F.col("o_orderkey").cast("long") % 5).alias("text"))
    return exploded(_few("EMAIL_ADDRESS").analyze(df, allow_list=["a1@b.example", "A3@B.Example"]), "o_orderkey").select("o_orderkey", "match")


@query("allow_list_regex", f"SELECT doc_id, m AS match FROM ({_EMAILS}) WHERE NOT regexp_full_match(m, '[a-m].*')")
def allow_list_regex(spark, sf_dir):
    a = _few("EMAIL_ADDRESS")
    return exploded(a.analyze(docs(spark, sf_dir), allow_list=["[a-m].*"], allow_list_match="regex")).select("doc_id", "match")


@query("deny_list", "SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:^|[^\\p{L}\\p{N}_])(idiot|worthless|apache)\\b')) AS m FROM documents) GROUP BY doc_id")
def deny_list(spark, sf_dir):
    r = PatternRecognizer("Words", "TITLE").with_deny_list(["idiot", "worthless", "apache"], 0.8)
    found = docs(spark, sf_dir).select("doc_id", F.size(r.spans(F.col("text"), 0)).cast("long").alias("n"))
    return found.where("n > 0")


@query("threshold_after_boost", "SELECT o_orderkey, CAST(0.4 AS DOUBLE) AS score FROM orders WHERE o_orderkey % 2 = 0")
def threshold_after_boost(spark, sf_dir):
    """A base score of 0.05 passes a threshold of 0.4 when a context word raises it."""
    a = Analyzer(Registry([PatternRecognizer("Number", "NUMBER", (Pattern("nine", r"\b\d{9}\b", 0.05),), context=("passport",))]))
    text = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "passport ").otherwise("ticket "), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    df = docs(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return exploded(a.analyze(df, score_threshold=0.4), "o_orderkey").select("o_orderkey", "score")


@query("conflicts_by_score", """
SELECT o_orderkey, 'SMALL' AS entity_type, CAST(3 * i AS BIGINT) AS "start", CAST(3 * i + 3 AS BIGINT) AS "end"
FROM (SELECT o_orderkey, unnest(range(0, CAST((3 + o_orderkey % 7) // 3 AS BIGINT))) AS i FROM orders)""")
def conflicts_by_score(spark, sf_dir):
    """Runs of 3 to 9 letters: the short spans score higher, so that the long ones they meet go."""
    a = Analyzer(Registry([PatternRecognizer("Big", "BIG", (Pattern("b", "A{5}", 0.1),)), PatternRecognizer("Small", "SMALL", (Pattern("s", "A{3}", 0.9),))]))
    df = docs(spark, sf_dir, "orders").select("o_orderkey", F.repeat(F.lit("A"), (3 + F.col("o_orderkey") % 7).cast("int")).alias("text"))
    return exploded(a.analyze(df), "o_orderkey").select("o_orderkey", "entity_type", "start", "end")


@query("dedup_in_recognizer", "SELECT o_orderkey, CAST(o_orderkey % 9000 + 1000 AS VARCHAR) AS match, CAST(0.9 AS DOUBLE) AS score FROM orders")
def dedup_in_recognizer(spark, sf_dir):
    r = PatternRecognizer("Digits", "DIGITS", (Pattern("four", r"\d{4}", 0.9), Pattern("two", r"\d{2}", 0.3)))
    df = docs(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 9000 + 1000).cast("string").alias("text"))
    return exploded(df.select("*", r.spans(F.col("text"), 0).alias("spans")), "o_orderkey").select("o_orderkey", "match", "score")


# ---------------------------------------------------------------- de-identification

def _anonymized(spark, sf_dir, config: OperatorConfig) -> DataFrame:
    df = _few("EMAIL_ADDRESS").analyze(docs(spark, sf_dir))
    return Anonymizer().anonymize(df, {"DEFAULT": config}).select("doc_id", F.col("anonymized.text").alias("text"), F.size("anonymized.items").cast("long").alias("n"))


_COUNT = f"CAST(len(regexp_extract_all(text, {_EMAIL})) AS BIGINT) AS n"
query("anonymize_replace", f"SELECT doc_id, regexp_replace(text, {_EMAIL}, '<EMAIL_ADDRESS>', 'g') AS text, {_COUNT} FROM documents")(lambda s, d: _anonymized(s, d, OperatorConfig("replace")))
query("anonymize_new_value", f"SELECT doc_id, regexp_replace(text, {_EMAIL}, 'someone', 'g') AS text, {_COUNT} FROM documents")(lambda s, d: _anonymized(s, d, OperatorConfig("replace", {"new_value": "someone"})))
query("anonymize_redact", f"SELECT doc_id, regexp_replace(text, {_EMAIL}, '', 'g') AS text, {_COUNT} FROM documents")(lambda s, d: _anonymized(s, d, OperatorConfig("redact")))
query("anonymize_keep", f"SELECT doc_id, text, {_COUNT} FROM documents")(lambda s, d: _anonymized(s, d, OperatorConfig("keep")))
_DRAW = "CAST('0x' || sha256(m)[{a}:{b}] AS INT) % 16 + 1"
_FIRST, _LAST = (f"({[x.lower() for x in names]})[{_DRAW.format(a=4 * k + 1, b=4 * k + 4)}]" for k, names in enumerate((FIRST, LAST)))
query("anonymize_surrogate", f"""
SELECT doc_id, coalesce(string_agg(g || coalesce({_FIRST} || '.' || {_LAST} || '@example.com', ''), '' ORDER BY i), '') AS text, CAST(count(m) AS BIGINT) AS n
FROM (SELECT doc_id, unnest(range(1, len(gs) + 1)) AS i, unnest(gs) AS g, unnest(list_append(ms, NULL)) AS m
  FROM (SELECT doc_id, string_split_regex(text, {_EMAIL}) AS gs, regexp_extract_all(text, {_EMAIL}) AS ms FROM documents)) GROUP BY doc_id""")(lambda s, d: _anonymized(s, d, OperatorConfig("surrogate")))


def _items(config: OperatorConfig) -> Query:
    def run(spark, sf_dir):
        df = _few("EMAIL_ADDRESS").analyze(docs(spark, sf_dir))
        return Anonymizer().anonymize(df, {"DEFAULT": config}).select("doc_id", F.explode("anonymized.items").alias("i")).select("doc_id", F.col("i.text").alias("value"))

    return run


query("anonymize_hash", f"SELECT doc_id, sha256(m) AS value FROM ({_EMAILS})")(_items(OperatorConfig("hash")))
query("anonymize_hash512", f"SELECT doc_id, m AS value, CAST(128 AS INT) AS size FROM ({_EMAILS})")(lambda s, d: _hash512(s, d))
query("anonymize_mask_end", f"SELECT doc_id, m[1:greatest(length(m) - 5, 0)] || repeat('#', least(5, length(m))) AS value FROM ({_EMAILS})")(_items(OperatorConfig("mask", {"chars_to_mask": 5, "from_end": True, "masking_char": "#"})))
query("anonymize_mask", f"SELECT doc_id, repeat('*', least(4, length(m))) || m[least(4, length(m)) + 1:] AS value FROM ({_EMAILS})")(_items(OperatorConfig("mask", {"chars_to_mask": 4})))


def _hash512(spark, sf_dir):
    """The address that each digest of an item is the SHA-512 of, found by hashing the document's addresses."""
    df = _few("EMAIL_ADDRESS").analyze(docs(spark, sf_dir))
    df = Anonymizer().anonymize(df, {"DEFAULT": OperatorConfig("hash", {"hash_type": "sha512"})})
    found = df.select("doc_id", F.explode(F.arrays_zip(F.reverse("anonymized.items").alias("i"), F.transform("spans", lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])).alias("m"))).alias("e"))
    return found.where(F.sha2("e.m", 512) == F.col("e.i.text")).select("doc_id", F.col("e.m").alias("value"), F.length("e.i.text").alias("size"))


@query("encrypt_round_trip", f"SELECT doc_id, text, CAST(len(regexp_extract_all(text, {_EMAIL})) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_left, CAST(list_sum(list_transform(regexp_extract_all(text, {_EMAIL}), lambda m: 4 * ((16 + (length(m) // 16 + 1) * 16 + 2) // 3))) AS BIGINT) AS base64_length FROM documents")
def encrypt_round_trip(spark, sf_dir):
    """In between no address is left and each item has the length of a vector and padded blocks in Base64."""
    key, a = {"key": "1234567890123456"}, Anonymizer()
    df = a.anonymize(_few("EMAIL_ADDRESS").analyze(docs(spark, sf_dir)), {"DEFAULT": OperatorConfig("encrypt", key)})
    hidden = F.regexp_count("anonymized.text", F.lit(_REGEX["EMAIL_ADDRESS", "Email (medium)"])).cast("long")
    size = F.aggregate("anonymized.items", F.lit(0).cast("long"), lambda x, i: x + F.length(i["text"]))
    df = df.select("doc_id", F.col("anonymized.text").alias("text"), F.col("anonymized.items").alias("items"), hidden.alias("n_left"), F.when(F.size("anonymized.items") > 0, size).alias("base64_length"))
    return a.deanonymize(df, {"DEFAULT": OperatorConfig("decrypt", key)}).select("doc_id", F.col("restored.text").alias("text"), F.size("items").cast("long").alias("n"), "n_left", "base64_length")


@query("phone_numbers")
def phone_numbers(spark, sf_dir):
    a = Analyzer(Registry([PhoneRecognizer()]))
    return exploded(a.analyze(docs(spark, sf_dir), lang="lang")).select("doc_id", "start", "end", "match", "score")


# ---------------------------------------------------------------- tokens and labels

@query("tokens", """
SELECT doc_id, w AS text, lower(w) AS lemma, CAST(count(*) AS BIGINT) AS n
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+')) AS w FROM documents) GROUP BY doc_id, w""")
def token_counts(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", F.explode(tokens(F.col("text"))).alias("t"))
    return t.groupBy("doc_id", "t.text", "t.lemma").agg(F.count("*").alias("n"))


@query("decode_labels", """
SELECT o_orderkey, entity_type, "start", "end", score FROM (
  SELECT o_orderkey, 'PER' AS entity_type, CAST(0 AS BIGINT) AS "start", CAST(CASE WHEN o_orderkey % 2 = 0 THEN 9 ELSE 4 END AS BIGINT) AS "end", CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0.625 ELSE 0.5 END AS DOUBLE) AS score FROM orders
  UNION ALL SELECT o_orderkey, 'LOC', 5, 9, CAST(0.75 AS DOUBLE) FROM orders WHERE o_orderkey % 2 <> 0)""")
def decode_labels(spark, sf_dir):
    """Orders as two labelled tokens; an even key's second one goes on with the first's entity."""
    label = F.when(F.col("o_orderkey") % 2 == 0, "I-PER").otherwise("I-LOC")
    token = lambda s, e, x, p: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), x.alias("label"), F.lit(p).alias("score"), F.lit(False).alias("is_special"))
    found = decode_bio(F.array(token(0, 4, F.lit("B-PER"), 0.5), token(5, 9, label, 0.75)))
    return docs(spark, sf_dir, "orders").select("o_orderkey", F.explode(found).alias("e")).select("o_orderkey", "e.entity_type", F.col("e.start").cast("long").alias("start"), F.col("e.end").cast("long").alias("end"), "e.score")


# ---------------------------------------------------------------- name lists


@query("gazetteer_large_list", """
SELECT k AS o_orderkey, CAST(CASE WHEN k % 3 = 0 THEN 6 ELSE 10 END AS BIGINT) AS "start", CAST(14 + length(CAST(k AS VARCHAR)) AS BIGINT) AS "end",
  CASE WHEN k % 3 = 0 THEN 'New ' ELSE '' END || 'Name' || k AS match
FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders) WHERE k % 3 = 0 OR (k % 5 = 0 AND k % 2 = 0)""")
def gazetteer_large_list(spark, sf_dir):
    """A list of 120,000 names, those of two words before those of one; where the tag of a word is known, it must be a proper noun."""
    names = spark.range(0, 300_000, 3).select(F.format_string("New Name%d", "id").alias("name")).unionByName(spark.range(0, 300_000, 5).select(F.format_string("name%d", "id").alias("name")))
    k = F.col("o_orderkey").cast("long")
    df = docs(spark, sf_dir, "orders").select(k.alias("o_orderkey"), F.format_string("meet, New Name%d today", k).alias("text"))
    tag = lambda x, s, e, p: F.struct(x.alias("text"), x.alias("lemma"), F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(False).alias("is_stop"), p.alias("pos"))
    df = df.withColumn("tokens", F.array(tag(F.lit("New"), 6, 9, F.lit("")), tag(F.lit("Name"), 10, 14, F.when(k % 2 == 0, "PROPN").otherwise("VERB"))))
    found = gazetteer_spans(df, names, "PERSON", key="o_orderkey", max_words=2, proper_noun=True, pos=("PROPN",), tokens="tokens")
    return exploded(Analyzer(Registry([NerRecognizer(labels={"PERSON": "PERSON"})])).analyze(found), "o_orderkey").select("o_orderkey", "start", "end", "match")


@query("gazetteer_documents", """
WITH n AS (SELECT DISTINCT lower(w) AS name FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}][\\p{L}\\p{N}''\\-]*')) AS w FROM benchmark) WHERE length(w) >= 9),
d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}][\\p{L}\\p{N}''\\-]*')) AS w FROM documents)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM d WHERE lower(w) IN (SELECT name FROM n) GROUP BY doc_id""")
def gazetteer_documents(spark, sf_dir):
    """The long words of the benchmark texts in the documents."""
    words = docs(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(GazetteerRecognizer.WORD), F.lit(0))).alias("name")).where("length(name) >= 9")
    found = gazetteer_spans(docs(spark, sf_dir), words, "TERM")
    return found.select("doc_id", F.size("ner_entities").cast("long").alias("n")).where("n > 0")


# ---------------------------------------------------------------- reports

_MAIN = ("EMAIL_ADDRESS", "IP_ADDRESS", "CREDIT_CARD")


@query("entity_counts", f"""
SELECT entity_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs FROM (
  SELECT doc_id, 'EMAIL_ADDRESS' AS entity_type FROM ({ORACLE["scan_email_address_documents"]})
  UNION ALL SELECT doc_id, 'IP_ADDRESS' FROM ({ORACLE["scan_ip_address_documents"]})
  UNION ALL SELECT doc_id, 'CREDIT_CARD' FROM ({ORACLE["scan_credit_card_documents"]})
) GROUP BY entity_type""")
def entity_counts(spark, sf_dir):
    """Mails, addresses and payment cards by type, conflicts resolved."""
    found = exploded(_few(*_MAIN).analyze(docs(spark, sf_dir)))
    return found.groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("all_entities_by_source")
def all_entities_by_source(spark, sf_dir):
    """The whole registry over all documents."""
    found = Analyzer().analyze(docs(spark, sf_dir), lang="lang").select("source", F.explode("spans").alias("s"))
    return found.groupBy("source", F.col("s.entity_type").alias("entity_type")).agg(F.count("*").alias("n"))
