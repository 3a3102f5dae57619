"""Canonical exact fingerprints, with DataFrame functions only.

A text's canonical form is its compatibility composition (NFKC) with full case folding, runs of white space folded to one
space and none at the ends. Its digest is two seeded 64-bit xxhashes. Where several documents share a digest, their
canonical bytes are compared (least against greatest); a digest that stands for different bytes gets a suffix from the
bytes' SHA-256, so that equal fingerprints always mean equal canonical bytes. Likeness of exact fingerprints is 1 or 0.

Digest counts are summed before the shuffle, and only texts whose digest may repeat, by a bitmap of fixed size, are
compared; copies collapse in the partial aggregate. Null texts count as empty. Repeated rows and ties have equal
fingerprints; rows with a null doc_id come last in descending order. Empty tables give no rows; a single document is
its own next. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwell.llm.common import free_name, materialize, table

BITMAP_WORDS = 1 << 14
BUCKETS_PER_PARTITION = 4


def _icu(cls: str, method: str, c: Column, flag: bool) -> Column:
    return F.reflect(F.lit(cls), F.lit(method), c, F.lit(flag))


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC again (folding may leave sequences that compose), white space folded."""
    t = _icu("com.ibm.icu.text.Normalizer", "compose", F.coalesce(text, F.lit("")), True)
    t = _icu("com.ibm.icu.text.Normalizer", "compose", _icu("com.ibm.icu.lang.UCharacter", "foldCase", t, True), True)
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """32 hex digits: two xxhash64 with different seeds."""
    part = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0")
    return F.concat(part(1), part(2))


def _bitmap(digests: DataFrame) -> Column:
    """A literal bitmap of fixed size that has the digests' hashes."""
    h = F.xxhash64("d")
    word, bit = F.pmod(F.shiftrightunsigned(h, 6), F.lit(BITMAP_WORDS)), F.expr("shiftleft(1L, cast(pmod(xxhash64(d), 64) as int))")
    words = [0] * BITMAP_WORDS
    for r in digests.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).collect():  # at most BITMAP_WORDS rows
        words[r.w] = r.b
    return F.expr(f"cast(split('{','.join(map(str, words))}', ',') as array<bigint>)")


def collided(texts: DataFrame, digest_of=digest) -> DataFrame:
    """Digests (d) that stand for different canonical bytes among the column `text`; materialised, and normally empty."""
    rows = texts.select(canonical(F.col("text")).alias("canon")).withColumn("d", digest_of(F.col("canon")))
    often = materialize(rows.groupBy("d").count().where("count > 1").select("d"), "often")
    bits = _bitmap(often)
    h = F.xxhash64("d")
    may = F.element_at(bits, (F.pmod(F.shiftrightunsigned(h, 6), F.lit(BITMAP_WORDS)) + 1).cast("int")).bitwiseAND(F.expr("shiftleft(1L, cast(pmod(xxhash64(d), 64) as int))")) != 0
    compared = rows.where(may).groupBy("d").agg(F.min("canon").alias("a"), F.max("canon").alias("b"))
    return materialize(compared.where("a <> b").select("d"), "collided")


def resolve(rows: DataFrame, bad: DataFrame | None, d: str, canon: str, out: str) -> DataFrame:
    """The fingerprint: the digest, with a suffix where it stands for several texts."""
    if bad is None:
        return rows.withColumnRenamed(d, out)
    mark = free_name([*rows.columns, out], "bad")
    marked = rows.join(bad.select(F.col("d").alias(d), F.lit(True).alias(mark)), d, "left")
    return marked.withColumn(out, F.when(F.col(mark), F.concat(d, F.lit("-"), F.sha2(canon, 256))).otherwise(F.col(d))).drop(mark, d)


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digest_of=digest) -> DataFrame:
    """The columns of `keep` and fingerprint, equal exactly where canonical texts are."""
    bad = collided(docs.select(F.col(text).alias("text")), digest_of)
    bad = None if bad.isEmpty() else bad
    c, d = free_name(keep, "canon"), free_name(keep, "digest")
    rows = docs.select(*keep, canonical(F.col(text)).alias(c)).withColumn(d, digest_of(F.col(c)))
    return resolve(rows, bad, d, c, "fingerprint").drop(c)


def next_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next document in descending doc_id, after the last the first.

    The ids are cut into ranges by quantiles that are ids themselves; the greatest id of a range is also sent to the range
    above as what follows its last row, so that one shuffle is enough and no task sees more than its range.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("__k"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("k"))
    cuts = keys.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("q"), F.max("k").alias("m")).first()
    if cuts.m is None:
        return docs.select("doc_id", "text", F.col("text").alias("next_text"))
    bounds = sorted({*(cuts.q or []), cuts.m})
    n = len(bounds)
    array = F.expr(f"cast(split('{','.join(map(str, bounds))}', ',') as array<bigint>)")
    # binary search for the first bound that is not below k
    steps = F.sequence(F.lit(n.bit_length() - 1), F.lit(0), F.lit(-1))

    def step(at: Column, i: Column) -> Column:
        to = at + F.call_function("shiftleft", F.lit(1), i)
        return F.when((to <= n) & (F.get(array, F.least(to, F.lit(n)) - 1) < F.col("__k")), to).otherwise(at)

    bucket = F.aggregate(steps, F.lit(0), step)
    rows = rows.withColumn("__b", bucket)
    follows = F.get(array, F.col("__b")) == F.col("__k")  # the greatest of its range
    places = F.when(follows, F.array(F.struct(F.col("__b").alias("b"), F.lit(False).alias("ghost")), F.struct(((F.col("__b") + 1) % n).alias("b"), F.lit(True).alias("ghost")))).otherwise(F.array(F.struct(F.col("__b").alias("b"), F.lit(False).alias("ghost"))))
    dealt = rows.withColumn("__p", F.explode(places)).select("doc_id", "__k", "text", F.col("__p.b").alias("__b"), F.col("__p.ghost").alias("__ghost"))
    w = Window.partitionBy("__b").orderBy("__ghost", F.desc("__k"), F.xxhash64("text"))
    return dealt.withColumn("next_text", F.lead("text").over(w)).where(~F.col("__ghost")).select("doc_id", "text", "next_text")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bad = collided(docs)
    bad = None if bad.isEmpty() else bad
    n = F.length("text")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = next_texts(docs).withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring("next_text", F.lit(1), third)))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("c1"), canonical(F.col("edited")).alias("c2"), canonical(F.col("next_text")).alias("c3"),
    )
    rows = rows.withColumns({"d1": digest(F.col("c1")), "d2": digest(F.col("c2")), "d3": digest(F.col("c3"))})
    for d, c, out in (("d1", "c1", "fingerprint"), ("d2", "c2", "edited_fingerprint"), ("d3", "c3", "next_fingerprint")):
        rows = resolve(rows, bad, d, c, out)
    like = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    # bytes decide between a document and its own edited text, which the comparison of documents doesn't cover
    near = F.when(F.col("fingerprint") == F.col("edited_fingerprint"), (F.col("c1") == F.col("c2")).cast("double")).otherwise(0.0)
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near.alias("near_edited"), like("fingerprint", "next_fingerprint").alias("near_next"))


QUERIES = {"op8_fingerprints": op8_fingerprints}
ORACLE_SQL: dict[str, str] = {}
