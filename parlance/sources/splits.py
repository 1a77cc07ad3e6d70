"""Text files read in splits, with every line's place in its file.

A file of any size is many splits, and a split is known by where in the file it starts. Within a
split lines come in order, so a place is the file's path, the split's start and the row; line numbers follow
from the counts of the splits before. Texts are never shuffled for that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.ordering import running
from parlance.session import checkpointed

#: Splits, counted, that may be broadcast; beyond it their numbers are joined by shuffle.
BROADCAST_SPLITS = 500_000


def lines(spark: SparkSession, path: str | list[str], sep: str | None = None) -> DataFrame:
    """(file, block, row, value): row rises within the block, the split that starts there in its file."""
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")


def numbered_lines(rows: DataFrame, name: str = "line") -> DataFrame:
    """Lines with their number from 0 over all files, in order of paths and of places in them."""
    blocks = rows.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    blocks = checkpointed(running(checkpointed(blocks), ["file", "block"], F.col("n"), "before"))
    places = F.broadcast(blocks) if blocks.count() <= BROADCAST_SPLITS else blocks
    nth = F.col("row") - F.col("first")
    sure = F.when(nth.between(0, F.col("n") - 1), nth).otherwise(F.raise_error(F.lit("files changed while they were read")).cast("bigint"))
    return rows.join(places, ["file", "block"]).withColumn(name, F.col("before") + sure).drop("first", "n", "before")
