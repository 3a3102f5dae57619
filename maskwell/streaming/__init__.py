"""Detection and de-identification of streams: stateless, so that the expressions of a batch run on them as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from maskwell.operators.analyzer import Analyzer
from maskwell.operators.anonymizer import Anonymizer, OperatorConfig


def deidentify(stream: DataFrame, analyzer: Analyzer, operators: dict[str, OperatorConfig] | None = None, text: str = "text", count: str = "n_items", **options) -> DataFrame:
    """A stream (or table) with the column `text` de-identified and the number of items in `count` (a null text stays null, with 0).

    Other columns pass, whatever their names; one named as `count` is an error.
    """
    from pyspark.sql import functions as F

    names = {c.lower() for c in stream.columns}
    if count.lower() in names:
        raise ValueError(f"the stream has a column {count}")
    spans, done = ("".join([base, "_" * k]) for base in ("spans", "done") for k in [next(k for k in range(99) if f"{base}{'_' * k}" not in names)])
    found = analyzer.analyze(stream, text=text, output=spans, **options)
    out = Anonymizer().anonymize(found, operators or {"DEFAULT": OperatorConfig("replace")}, text=text, spans=spans, output=done)
    return out.select(*[F.col(f"{done}.text").alias(c) if c == text else F.col(f"`{c}`") for c in stream.columns], F.coalesce(F.size(f"{done}.items"), F.lit(0)).alias(count))


def write(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Parquet, each input row exactly once over restarts; with `once`, what is there now and then the end."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
