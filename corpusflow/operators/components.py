"""Connected components of a link table by alternating large and small stars.

Minima are aggregated before they are joined back, so a node with many links
is combined before it is shuffled and its rows can be split over tasks. Every
round cuts its lineage in the shared checkpoint folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage by a Parquet table in the shared folder, which is read column by column."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where none is set, a folder of our own in local mode and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); the root is the component's least node."""
    e = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            break
        last, e = now, stored(_small(_large(e)))
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


#: Bits of ``maybe_in``: 524,288 words of 64, whatever the number of keys.
BITS = 1 << 25


def maybe_in(rows: DataFrame, keys: DataFrame, key: str, name: str = "maybe", column: str | None = None) -> DataFrame:
    """Rows with a flag ``name``: false only where ``column`` (that of the key, if not given) is none of ``keys``' values, which are numbers or strings.

    Each key sets one of ``BITS`` bits, whose words are broadcast: what no bit
    is set for goes into no join, so neither a wide row nor a frequent value is
    shuffled for it. A null is in nothing.
    """

    def bit(frame: DataFrame, c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c) if frame.schema[c].dataType.typeName() == "string" else F.col(c).cast("long")), F.lit(BITS))

    column = column or key
    at = keys.where(F.col(key).isNotNull()).select(bit(keys, key).alias("_bit"))
    words = at.groupBy(F.shiftright("_bit", 6).alias("_at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))")).alias("_word"))
    rows = rows.withColumn("_bit", bit(rows, column)).withColumn("_place", F.shiftright("_bit", 6)).join(F.broadcast(words), F.col("_place") == F.col("_at"), "left")
    is_set = F.expr("shiftrightunsigned(_word, cast(_bit & 63 as int)) & 1") == 1
    return rows.withColumn(name, F.coalesce(is_set, F.lit(False)) & F.col(column).isNotNull()).drop("_bit", "_place", "_at", "_word")
