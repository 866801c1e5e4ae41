"""Incremental ingest with Structured Streaming: each content is taken once, however often it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, source: str, schema: StructType, store: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Runs over what has arrived in a Parquet folder and appends new contents to the store; running it again continues."""

    def take(batch: DataFrame, epoch: int) -> None:
        b = batch.withColumn("sha256", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).dropDuplicates(["sha256"]).withColumn("epoch", F.lit(epoch))
        try:
            known = spark.read.parquet(store)
        except Exception as e:  # the store does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        if known is not None:
            # a batch that is run again replaces what it wrote
            b = b.join(known.where(F.col("epoch") != epoch).select("sha256"), "sha256", "left_anti")
        b.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(store)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
