"""The graph while it is being built: triples of each batch join the table, a batch that is run again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpusflow.functions import text as T


def flush(spark: SparkSession, source: str, schema: StructType, store: str, checkpoint: str) -> StreamingQuery:
    """Takes the model replies (doc_id, call, reply) that have arrived and stores their triples, a folder for each batch.

    Replies that hold no triple are stored as failed calls. The graph is
    complete when the query has ended; running it again continues.
    """

    def take(batch: DataFrame, epoch: int) -> None:
        read = batch.select("doc_id", "call", T.parse_triples("reply").alias("r"))
        rows = read.select("doc_id", "call", F.explode_outer("r.kept").alias("t"), "r.dropped", "r.failed")
        out = rows.select("doc_id", "call", F.trim("t.s").alias("s"), F.trim("t.p").alias("p"), F.trim("t.o").alias("o"), "dropped", "failed", F.lit(epoch).alias("epoch"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(store)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def graph(store: DataFrame) -> DataFrame:
    """(s, p, o, doc_id): the union of all calls so far."""
    return store.where("NOT failed").select("s", "p", "o", "doc_id").distinct()


def counters(store: DataFrame) -> DataFrame:
    """One row: calls, failed ones, triples kept and elements dropped so far."""
    calls = store.groupBy("doc_id", "call").agg(F.max("dropped").alias("dropped"), F.max("failed").alias("failed"), F.count("s").alias("kept"))
    return calls.agg(F.count("*").alias("calls"), F.count_if("failed").alias("calls_failed"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"))


def progress(query: StreamingQuery) -> dict:
    """What a poll of a running query is told."""
    last = query.lastProgress or {}
    return {"running": query.isActive, "batch": last.get("batchId"), "rows": last.get("numInputRows"), "error": str(query.exception()) if query.exception() else None}
