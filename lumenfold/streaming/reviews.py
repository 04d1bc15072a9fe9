"""Reviews as a stream of files: each arriving batch is merged into the aggregates and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pyspark.sql import functions as F

from ..operators.evidence import merge_reviews, review_columns

SCHEMA = "aggregate_id string, status string, confidence string, rationale string, model string, agent string, seq long"


def follow_reviews(spark: SparkSession, aggregates: DataFrame, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Starts a query over JSON lines in the folder. Each batch rewrites what it touches under out/batch=N, so a repeated batch does no harm.

    A lone aggregate takes any review; whether there is one is found once, before the stream.
    """
    alone = len(aggregates.limit(2).collect()) == 1

    def merge(batch: DataFrame, epoch: int) -> None:
        said = batch.select("aggregate_id", "seq", *[c.alias(n) for n, c in review_columns(*[F.col(x) for x in ("status", "confidence", "rationale", "model", "agent")], F.lit(folder)).items()])
        touched = aggregates if alone else aggregates.join(batch.select("aggregate_id").distinct(), "aggregate_id", "left_semi")
        merge_reviews(touched, said, alone).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return spark.readStream.schema(SCHEMA).json(folder).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
