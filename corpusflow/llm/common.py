"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.operators.components import maybe_in  # noqa: F401

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's shared ``spark.checkpoint.dir``; where none is set, a folder of our own in local mode and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the shared folder, which outlives executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage by a Parquet table in the shared folder: smaller than a checkpoint, and read column by column."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many tables ``stored`` has made in this process."""
    return len(_made)


def release(spark: SparkSession, since: int) -> None:
    """Removes the tables made since then but the last, which is all that later steps read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _made[since:-1]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    del _made[since:-1]


def fold(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the contracts' held-out folds."""
    return F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")) % F.lit(mod)


def sampled(docs: DataFrame, ids: DataFrame, bound: int, most_bytes: int | None = None, text: str = "text") -> DataFrame:
    """The rows of at most ``bound`` distinct ids, the first by a hash: a bounded sample for fitting, the same on every run.

    Only ids are sorted; they are broadcast, as their number is bounded, and of
    rows that share an id the first by text is taken. ``most_bytes`` bounds the
    sample's whole texts together by taking fewer rows, in the same order; a
    text longer than a sixteenth of it is passed over. Texts are never cut.
    """
    some = ids.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    got = docs.join(F.broadcast(some), "doc_id")
    if most_bytes is not None:
        got = got.where(F.octet_length(text) <= most_bytes // 16)
    others = [c for c in got.columns if c != "doc_id"]
    got = got.groupBy("doc_id").agg(F.min(F.struct(text, *(c for c in others if c != text))).alias("_row")).select("doc_id", *(F.col(f"_row.{c}").alias(c) for c in others))
    if most_bytes is not None:
        # one task sees at most ``bound`` rows
        upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        got = got.withColumn("_bytes", F.sum(F.octet_length(text)).over(upto)).where(F.col("_bytes") <= most_bytes).drop("_bytes")
    return got
