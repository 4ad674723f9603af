"""Zones of different publishers that describe one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Metres up to which two points may be one zone, and up to which a shared source makes it sure.
REACH, SURE = 150.0, 1.0


def drop_duplicate_ids(zones: DataFrame, *within: str) -> DataFrame:
    """The first zone in feed order of each (publisher, id); zones without id all stay. within: columns in which zones of one id
    are equal, by which they may lie together already."""
    alone = F.when(F.col("feature_id").isNull(), F.col("pos"))  # a zone without id meets none
    order = Window.partitionBy(*within, "publisher_key", "feature_id", alone).orderBy("pos")
    return zones.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def corroboration(pairs: DataFrame) -> DataFrame:
    """Per tier: matched pairs, and how many agree in road, direction and dates."""
    return pairs.groupBy("tier").agg(F.count(F.lit(1)).alias("pairs"), *(F.count_if(c).alias(c) for c in ("shared_road", "same_direction", "dates_overlap")))
