"""Language identification by Bayesian evidence fusion.

The posterior of a row's language is the product of: the text's likelihood under byte-trigram models, tempered because
neighbouring trigrams depend on each other; the chance of the language declared in the markup; that of the address's
suffix; and the host's prior. The last three come from grouped aggregation over all rows of first-pass posteriors:
declared and suffix tables are smoothed to the overall distribution, the host's prior to its domain's and that to the
overall one. A row's own share is taken out of its host's counts, so that no row is evidence for itself.

Trigram counts cover all labelled texts of the training fold. Null or empty text, missing or malformed markup, and null
or malformed addresses give no evidence of that kind; a row without any gets the overall distribution. Ties go to the
first language by name. Repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.llm.common import free, free_name, in_train_fold, map_arrow, materialize, slices, table

BUCKETS = 1 << 15
#: A text counts as this many independent trigrams at most, and each as TEMPER of one.
EFFECTIVE = 200.0
TEMPER = 0.5
KAPPA = 4.0
PART = 1 << 20
#: Languages that a model has at most; more are an error.
LANGUAGES = 512

_TAG = re.compile(rb"(?i)<(?:(script|style)\b|(!--))?")
_CLOSE = {k: re.compile(rb"(?i)</" + k + rb"\s*>") for k in (b"script", b"style")}


def visible(markup: bytes) -> bytes:
    """Text of a page without scripts, styles, comments and tags, entities resolved. What is never closed stays, but for its tag; each end
    is looked for once, so that the time is linear."""
    parts, at, missing = [], 0, set()

    def end_of(kind: bytes, start: int) -> int:
        if kind in missing:
            return -1
        m = _CLOSE[kind].search(markup, start) if kind in _CLOSE else None
        found = (m.end() if m else -1) if kind in _CLOSE else (markup.find(kind, start) + len(kind) or -1)
        if found < 0 or (kind not in _CLOSE and found == len(kind) - 1):
            missing.add(kind)
            return -1
        return found

    look = 0
    while m := _TAG.search(markup, look):
        to = -1
        if m[1]:
            to = end_of(m[1].lower(), m.end())
        elif m[2]:
            to = end_of(b"-->", m.end())
        if to < 0:
            to = end_of(b">", m.end())
        if to < 0:
            look = m.end()
            if b">" in missing and len(missing) == 4:
                break
            continue
        parts.append(markup[at : m.start()])
        at = look = to
    out = b" ".join([*parts, markup[at:]])
    return html.unescape(out.decode("utf-8", "replace")).encode() if b"&" in out else out


def trigram_counts(data: bytes, into: np.ndarray) -> int:
    """Adds the hashed byte trigrams of text with letters folded to lower case where ASCII; gives their number."""
    data, total = b" " + data.lower() + b" ", 0
    for at in range(0, max(len(data) - 2, 0), PART):
        b = np.frombuffer(data, np.uint8, min(PART + 2, len(data) - at), at).astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(17)
        into += np.bincount(h, minlength=BUCKETS)
        total += len(h)
    return total


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages by name and log-probabilities of the hashed trigrams, from all rows with a language."""
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for t, l in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                if l not in sums and len(sums) > LANGUAGES:  # an error below
                    continue
                trigram_counts(t or b"", sums.setdefault(l, np.zeros(BUCKETS, np.int64)))
        for l, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(x[at])], names=["lang", "bucket", "n"])

    parts = map_arrow(labelled.select(text, lang).where(F.col(lang).isNotNull()), count, "lang string, bucket int, n long")
    sums = materialize(parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    names = sorted(r.lang for r in sums.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages are labelled")
    if not names:
        return ["und"], np.zeros((1, BUCKETS), np.float32)
    got = sums.toArrow()  # a row for each language and bucket
    c = np.full((len(names), BUCKETS), 0.5)
    place = {l: i for i, l in enumerate(names)}
    np.add.at(c, ([place[l] for l in got.column("lang").to_pylist()], got.column("bucket").to_numpy()), got.column("n").to_numpy())
    free(sums)
    return names, np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(rows: DataFrame, model: tuple[list[str], np.ndarray], markup: bool, keep: list[str], text: str) -> DataFrame:
    """The columns of `keep`, ll: tempered log-likelihoods by language, p: their posterior under a flat prior."""
    import pyarrow as pa

    names, logs = model
    shared = rows.sparkSession.sparkContext.broadcast(logs.T.copy())  # fixed size for each language
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("ll", T.ArrayType(T.DoubleType())), T.StructField("declared", T.StringType())])
    declared = re.compile(rb"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for b in slices(batches):
            ll, said = [], []
            for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist():
                t = t or b""
                m = declared.search(t) if markup else None
                said.append(m[1].decode().lower() if m else None)
                n = trigram_counts(visible(t) if markup else t, counts := np.zeros(BUCKETS, np.int64))
                at = np.flatnonzero(counts)
                ll.append((counts[at] @ weights[at] * (TEMPER * min(1.0, EFFECTIVE / n))).tolist() if n > 2 else [0.0] * len(names))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ll, pa.list_(pa.float64())), pa.array(said, pa.string())], names=[f.name for f in schema])

    return map_arrow(rows.select(*keep, rows[text].alias(free_name(keep, "text"))), run, schema)


def _softmax(ll: Column) -> Column:
    e = F.transform(ll, lambda x: F.exp(x - F.array_max(ll)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _sums(n: int) -> list[Column]:
    return [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]


def _smooth(sums: Column, prior: Column, kappa: float) -> Column:
    total = F.aggregate(sums, F.lit(0.0), lambda a, y: a + y)
    return F.zip_with(sums, prior, lambda s, q: (s + kappa * q) / (total + kappa))


def fuse(rows: DataFrame, languages: list[str], kappa: float = KAPPA) -> DataFrame:
    """rows: ll, declared, suffix, domain, host. Adds lang, probability, text_lang."""
    n = len(languages)
    names = F.array(*[F.lit(x) for x in languages])
    rows = materialize(rows.withColumn("p", _softmax(F.col("ll"))), "evidence")
    total = [float(x or 0) for x in rows.agg(*_sums(n)).first()]
    overall = F.array(*[F.lit((x + 1.0) / (sum(total) + n)) for x in total])
    array = F.array(*[F.col(f"s{i}") for i in range(n)])
    # the host's counts, in its domain, in all: grouped sums, each joined by its key; hot keys are summed before the shuffle
    domains = materialize(rows.where("domain IS NOT NULL").groupBy("domain").agg(*_sums(n)).select("domain", _smooth(array, overall, kappa).alias("domain_p")), "domains")
    hosts = rows.where("host IS NOT NULL").groupBy("host").agg(F.min("domain").alias("domain"), *_sums(n)).select("host", "domain", array.alias("host_s"))
    hosts = materialize(hosts.join(domains, "domain", "left").select("host", "host_s", F.coalesce("domain_p", overall).alias("domain_p")), "hosts")
    # chance of each sign given the language, against its chance overall: P(sign | l) / P(sign) = P(l | sign) / P(l)
    said = materialize(rows.where("declared IS NOT NULL").groupBy("declared").agg(*_sums(n)).select("declared", _smooth(array, overall, kappa).alias("declared_p")), "declared")
    ends = materialize(rows.where("suffix IS NOT NULL").groupBy("suffix").agg(*_sums(n)).select("suffix", _smooth(array, overall, kappa).alias("suffix_p")), "suffixes")
    j = rows.join(hosts, "host", "left").join(said, "declared", "left").join(ends, "suffix", "left")
    own = F.zip_with("host_s", "p", lambda s, p: F.greatest(s - p, F.lit(0.0)))  # without the row itself
    prior = F.when(F.col("host_s").isNull(), overall).otherwise(_smooth(own, F.col("domain_p"), kappa))
    signs = [F.transform(prior, F.ln)]
    for c in ("declared_p", "suffix_p"):
        signs.append(F.when(F.col(c).isNull(), F.transform(overall, lambda x: F.lit(0.0))).otherwise(F.zip_with(F.col(c), overall, lambda a, b: F.ln(a / b))))
    fused = F.col("ll")
    for s in signs:
        fused = F.zip_with(fused, s, lambda a, b: a + b)
    best = lambda p: F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
    return j.withColumn("posterior", _softmax(fused)).withColumns({"lang": best(F.col("posterior")), "probability": F.array_max("posterior"), "text_lang": best(F.col("p"))})


def address_parts(rows: DataFrame, url: str) -> DataFrame:
    """host, domain (its last two labels) and suffix (the last) of an address; null where it has none."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    return rows.withColumns({"host": host, "domain": F.substring_index(host, ".", -2), "suffix": F.when(host.contains("."), F.substring_index(host, ".", -1))})


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages and documents. A document's source stands for its host; its lang column is only learnt from,
    in the training fold, and no evidence."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = fit(docs.where(in_train_fold()))
    null = lambda kind: F.lit(None).cast(kind)
    of_pages = text_evidence(address_parts(pages, "url"), model, True, ["page_id", "host", "domain", "suffix"], "html")
    of_docs = text_evidence(docs, model, False, ["doc_id", "source"], "text")
    rows = of_pages.withColumn("doc_id", null("long")).unionByName(
        of_docs.select(null("long").alias("page_id"), F.col("source").alias("host"), null("string").alias("domain"), null("string").alias("suffix"), "ll", "declared", "doc_id")
    )
    return fuse(rows, model[0]).select("doc_id", "page_id", "host", "declared", "suffix", "text_lang", "lang", "probability")


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}
