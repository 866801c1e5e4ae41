"""Histograms of scanned pages: a threshold between ink and paper, and pages without ink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def histogram(pixels: DataFrame) -> DataFrame:
    """(page, value, n) of pixels (page, value 0 to 255); a page becomes at most 256 rows."""
    return pixels.groupBy("page", "value").agg(F.count("*").alias("n"))


def otsu(hist: DataFrame) -> DataFrame:
    """(page, threshold): the value up to which pixels are one class so that the two classes' means are farthest apart, weighed by their sizes; the first of equals."""
    page, upto = Window.partitionBy("page"), Window.partitionBy("page").orderBy("value")
    weight = F.col("n") * F.col("value")
    h = hist.select("page", "value", F.sum("n").over(upto).alias("w"), F.sum(weight).over(upto).alias("m"), F.sum("n").over(page).alias("all_w"), F.sum(weight).over(page).alias("all_m"))
    apart = F.pow(F.col("all_m") * F.col("w") / F.col("all_w") - F.col("m"), 2) / (F.col("w") * (F.col("all_w") - F.col("w")))
    between = F.when(F.col("w") < F.col("all_w"), apart).otherwise(F.lit(0.0))
    return h.withColumn("b", F.round(between, 9)).groupBy("page").agg(F.min_by("value", F.struct(-F.col("b"), "value")).alias("threshold"))


def blank(hist: DataFrame, light: int = 250, share: float = 0.99) -> DataFrame:
    """(page, blank): whether over that share of a page's pixels is lighter than ``light``."""
    return hist.groupBy("page").agg((F.sum(F.when(F.col("value") > light, F.col("n")).otherwise(0)) > share * F.sum("n")).alias("blank"))


def has_text(pages: DataFrame, least: float = 0.0008) -> DataFrame:
    """(page, has_text, image_only) of pages (page, chars, width, height, images): density of characters by points squared."""
    dense = F.col("chars") / (F.col("width") * F.col("height")) >= least
    return pages.select("page", dense.alias("has_text"), (~dense & (F.col("images") > 0)).alias("image_only"))
