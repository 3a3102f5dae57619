"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Token counts are summed by source, language and topic. Raking scales the cells until their weights have the target
marginals of all three; a document is drawn a number of times whose mean is proportional to its cell's weight per token, by
a hash of its id, so that a run repeated keeps the same rows. Targets name the categories; all others, and nulls, are
one category "(other)" of each margin, which keeps its share. A table of at most LOCAL_CELLS cells is raked on the driver. A larger one
has many sources: it stays in the cluster, a row for each source, where a source's factor follows from the factors of languages and
topics alone, so that a round is one pass without joins whose result has a row for each language and topic. Both give the same weights.

The expected tokens, with repeats, are `share` of all. A cell that needs more than its tokens has its documents repeated,
so that the drawn tokens have the target marginals however skewed the corpus is. A margin
whose target can't be met (no rows) gives its weight to the others in proportion. Null texts have no tokens and are
drawn with their cell's probability; a null id counts as the id 'null' in the draw; repeated rows fall alike. An empty
table gives no rows. Extra columns pass unchanged; the names of the added ones must not be among them.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm.common import free_name, materialize, table

OTHER = "(other)"
SHARE = 0.6
ROUNDS = 200
#: Cells that the driver rakes at most; more are raked in the cluster.
LOCAL_CELLS = 100_000
TOLERANCE = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from a text's form: table, contact, legal, code-like, list or prose."""
    t = F.coalesce(text, F.lit(""))
    lines = F.regexp_count(t, F.lit("\n")) + 1
    return (
        F.when(t.contains(" | "), "table")
        .when(t.contains("@"), "contact")
        .when(t.rlike("(?i)licen[sc]e|copyright"), "legal")
        .when(t.rlike(r"[{};]\s*\n"), "code")
        .when(F.length(t) < lines * 60, "list")
        .otherwise("prose")
    )


def rake(cells: dict[tuple, float], targets: list[dict[str, float]], rounds: int = ROUNDS) -> dict[tuple, float]:
    """Weights of the cells with the target marginals, nearest to the given ones in relative entropy."""
    weight = {k: v for k, v in cells.items() if v > 0}
    total = sum(weight.values())
    weight = {k: v / total for k, v in weight.items()}
    for _ in range(rounds):
        worst = 0.0
        for axis, target in enumerate(targets):
            sums: dict[str, float] = {}
            for k, v in weight.items():
                sums[k[axis]] = sums.get(k[axis], 0.0) + v
            there = sum(target.get(c, 0.0) for c in sums)
            factor = {c: target.get(c, 0.0) / there / s if there and s else 0.0 for c, s in sums.items()}
            worst = max([worst, *(abs(f - 1) for f in factor.values())])
            weight = {k: v * factor[k[axis]] for k, v in weight.items()}
        if worst < TOLERANCE:
            return weight
    if weight:
        warnings.warn(f"margins are off by a factor of up to {1 + worst:.3g} after {rounds} rounds", stacklevel=2)
    return weight


def multiples(cells: dict[tuple, float], weight: dict[tuple, float], share: float) -> dict[tuple, float]:
    """How often each cell's documents are drawn in the mean, so that the expected tokens have the weights and are `share` of all."""
    total = sum(cells.values())
    return {k: share * total * weight.get(k, 0.0) / v if v > 0 else 0.0 for k, v in cells.items()}


def tempered(sums: dict[str, float], power: float) -> dict[str, float]:
    """Shares in proportion to the token counts to a power below 1, which lifts the small ones."""
    raised = {k: v**power for k, v in sums.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def cell_sums(docs: DataFrame, text: str = "text") -> DataFrame:
    """source, lang, topic, n: token sums from one pass over the texts, as a table."""
    rows = docs.select("source", "lang", topic_of(F.col(text)).alias("topic"), n_words(F.col(text)).alias("w"))
    return materialize(rows.groupBy("source", "lang", "topic").agg(F.sum("w").alias("n")), "cells")


Targets = tuple[dict[str, float] | DataFrame, dict[str, float], dict[str, float]]


def _scaled(target: dict[str, float], rest: float) -> dict[str, float]:
    """Targets beside the share `rest` of what they don't name."""
    total = sum(target.values()) or 1.0
    return {k: v * (1 - rest) / total for k, v in target.items()} | ({OTHER: rest} if rest else {})


def _factors(weight: dict[str, float], target: dict[str, float]) -> dict[str, float]:
    there = sum(target.get(k, 0.0) for k, v in weight.items() if v)
    return {k: target.get(k, 0.0) / there / v if there and v else 0.0 for k, v in weight.items()}


def rake_many(cells: DataFrame, sources: DataFrame, lang: dict[str, float], topic: dict[str, float], rounds: int = ROUNDS) -> DataFrame:
    """s, l, t, n, w: the cells (s, l, t, n) with weights that have the targets; sources: s, target. Only languages and topics are held by the driver."""
    of = cells.groupBy("s").agg(F.collect_list(F.struct("l", "t", "n")).alias("cells")).join(sources, "s", "left")
    there = float(of.agg(F.sum("target")).first()[0] or 0.0) or 1.0
    of = materialize(of.withColumn("target", F.coalesce("target", F.lit(0.0)) / there), "source-cells")
    b, c = dict.fromkeys(lang, 1.0), dict.fromkeys(topic, 1.0)

    def weights() -> DataFrame:
        look = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
        scaled = F.transform("cells", lambda e: F.struct(e["l"].alias("l"), e["t"].alias("t"), e["n"].alias("n"), (e["n"] * F.try_element_at(look(b), e["l"]) * F.try_element_at(look(c), e["t"])).alias("w")))
        rows = of.select("s", "target", scaled.alias("cells")).withColumn("total", F.aggregate("cells", F.lit(0.0), lambda a, e: a + F.coalesce(e["w"], F.lit(0.0))))
        return rows.select("s", F.explode("cells").alias("e"), "target", "total").select("s", "e.l", "e.t", "e.n", F.when(F.col("total") > 0, F.coalesce("e.w", F.lit(0.0)) * F.col("target") / F.col("total")).otherwise(0.0).alias("w"))

    worst = 0.0
    for _ in range(rounds):
        got = {(r.l, r.t): r.w for r in weights().groupBy("l", "t").agg(F.sum("w").alias("w")).collect()}  # a row for each language and topic
        worst = 0.0
        for axis, target, held in ((0, lang, b), (1, topic, c)):
            sums: dict[str, float] = {}
            for k, w in got.items():
                sums[k[axis]] = sums.get(k[axis], 0.0) + w
            f = _factors(sums, target)
            worst = max([worst, *(abs(v - 1) for k, v in f.items() if sums[k])])
            for k, v in f.items():
                held[k] = held.get(k, 1.0) * v
            got = {k: w * f[k[axis]] for k, w in got.items()}
        if worst < TOLERANCE:
            return weights()
    warnings.warn(f"margins are off by a factor of up to {1 + worst:.3g} after {rounds} rounds", stacklevel=2)
    return weights()


def cell_multiples(sums: DataFrame, targets: Targets, share: float, local: int = LOCAL_CELLS) -> DataFrame:
    """source, lang, topic (nulls among them) of cell_sums() and `multiple`: how often the cell's documents are drawn in the mean. A table."""
    spark = sums.sparkSession
    source, lang, topic = targets
    if isinstance(source, dict):
        source = spark.createDataFrame([(k, float(v)) for k, v in source.items()], "source string, target double")
    named = lambda c, t: F.when(F.col(c).isin(list(t)), F.col(c)).otherwise(OTHER) if t else F.lit(OTHER)
    cells = sums.join(source.withColumnRenamed("source", "k"), F.col("source") == F.col("k"), "left")
    cells = cells.select("source", "lang", "topic", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).cast("double").alias("n"), F.when(F.col("k").isNotNull(), F.col("k")).otherwise(OTHER).alias("s"), named("lang", lang).alias("l"), named("topic", topic).alias("t"), "target")
    cells = materialize(cells, "named-cells")
    count, total = cells.agg(F.count("*"), F.sum("n")).first()
    if not count:
        return cells.select("source", "lang", "topic", F.lit(0.0).alias("multiple"))
    off = {c: float(cells.where(F.col(c) == OTHER).agg(F.sum("n")).first()[0] or 0) / total for c in "slt"}
    lang, topic = _scaled(lang, off["l"]), _scaled(topic, off["t"])
    grouped = cells.groupBy("s", "l", "t").agg(F.sum("n").alias("n"), F.max("target").alias("target"))
    asked = float(source.agg(F.sum("target")).first()[0] or 0) or 1.0
    if count <= local:
        got = grouped.collect()  # at most `local` rows
        wanted = {r.s: (r.target or 0.0) * (1 - off["s"]) / asked for r in got} | ({OTHER: off["s"]} if off["s"] else {})
        held = {(r.s, r.l, r.t): r.n for r in got}
        p = multiples(held, rake(held, [wanted, lang, topic]), share)
        out = F.broadcast(spark.createDataFrame([(*k, v) for k, v in p.items()], "s string, l string, t string, multiple double"))
    else:
        of = cells.groupBy("s").agg(F.max(F.when(F.col("s") == OTHER, off["s"]).otherwise(F.col("target") * (1 - off["s"]) / asked)).alias("target"))
        out = rake_many(grouped.drop("target"), of, lang, topic).select("s", "l", "t", (share * total * F.col("w") / F.col("n")).alias("multiple"))
    return materialize(cells.join(out, ["s", "l", "t"]).select("source", "lang", "topic", "multiple"), "multiples")


def mix(docs: DataFrame, targets: Targets, share: float = SHARE, seed: int = 7, text: str = "text", sums: DataFrame | None = None, prefix: str = "__", local: int = LOCAL_CELLS) -> DataFrame:
    """The rows of docs that are drawn, with topic, tokens, probability and repeats (1 at least) added, their names after `prefix`. sums: cell_sums(docs), if at hand."""
    topic, tokens, probability, repeats = (prefix + c for c in ("topic", "tokens", "probability", "repeats"))
    if clash := {c.lower() for c in docs.columns} & {topic, tokens, probability, repeats}:
        raise ValueError(f"docs has columns {sorted(clash)}: choose another prefix")
    sums = cell_sums(docs, text) if sums is None else sums
    taken = [*docs.columns, topic, tokens, probability, repeats]
    s, l, t, m = (free_name(taken, c) for c in ("s", "l", "t", "m"))
    cells = cell_multiples(sums, targets, share, local).toDF(s, l, t, m)
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    rows = docs.withColumn(topic, topic_of(F.col(text)))
    rows = rows.join(cells, F.col("source").eqNullSafe(F.col(s)) & F.col("lang").eqNullSafe(F.col(l)) & (F.col(topic) == F.col(t)))
    whole = F.floor(m)
    rows = rows.withColumns({probability: F.least(m, F.lit(1.0)), repeats: (whole + (drawn < F.col(m) - whole).cast("int")).cast("long")}).where(F.col(repeats) > 0)
    return rows.withColumn(tokens, n_words(F.col(text))).drop(s, l, t, m)


def own_targets(sums: DataFrame, power: float) -> Targets:
    """Targets tempered from the corpus itself, whose cell_sums() are given, for every source (a table), language and topic."""

    def of(c: str) -> DataFrame:
        return sums.where(F.col(c).isNotNull()).groupBy(c).agg(F.sum("n").cast("double").alias("n"))

    source = of("source").where("n > 0").select("source", F.pow("n", F.lit(power)).alias("target"))
    return source, *(tempered({r[0]: float(r[1] or 0) for r in of(c).collect()}, power) for c in ("lang", "topic"))  # languages and topics are few


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn when source, language and topic shares are lifted to the power 0.5."""
    docs = table(spark, sf_dir, "documents")
    sums = cell_sums(docs)
    out = mix(docs, own_targets(sums, 0.5), sums=sums)
    return out.select("doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.col("__probability").alias("probability"), F.col("__repeats").alias("n_repeats"))


QUERIES = {"op5_mix_sources": op5_mix_sources}
ORACLE_SQL: dict[str, str] = {}
