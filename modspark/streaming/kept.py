"""Tables that a stream folds batch by batch and that survive a restart (ST1 totals, ST6, S8).

Every batch writes its own folded rows to a folder named by its number, so a batch that is repeated
after a failure rewrites the same folder and counts once. Every so often a batch writes the fold of
everything up to it instead; readers start at the last of those. What is on storage is all there is:
a new session goes on where the old one stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Fold = Callable[[DataFrame], DataFrame]
#: Batches after which a batch writes everything anew.
EVERY = 32


def _rows(spark: SparkSession, folder: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The rows that together make the table, as written before batch ``before``."""
    whole = T.StructType([*schema.fields, T.StructField("__whole", T.BooleanType()), T.StructField("__batch", T.LongType())])
    try:
        rows = spark.read.schema(whole).parquet(f"{folder}/rows")
    except AnalysisException:  # nothing was written yet
        return spark.createDataFrame([], schema)
    if before is not None:
        rows = rows.where(F.col("__batch") < before)
    start = rows.where("__whole").agg(F.max("__batch")).first()[0]  # one number
    return rows.where(F.col("__batch") >= (start or 0)).select(*schema.names)


def table(spark: SparkSession, folder: str, schema: T.StructType, fold: Fold) -> DataFrame:
    """What the stream has folded so far."""
    return fold(_rows(spark, folder, schema)).select(*schema.names)


def keep(stream: DataFrame, folder: str, fold: Fold, every: int = EVERY) -> DataFrame:
    """Fold all available input of ``stream`` into the table below ``folder``; its content afterwards.

    ``fold`` makes one row per key of rows of the stream's columns, and gives the same whether rows are
    folded at once or in parts. No state is kept in memory and no row is too late.
    """
    spark, schema = stream.sparkSession, stream.schema

    def add(batch: DataFrame, number: int) -> None:
        if (whole := (number + 1) % every == 0):
            batch = batch.unionByName(_rows(spark, folder, schema, number))
        fold(batch).select(*schema.names).withColumn("__whole", F.lit(whole)).write.mode("overwrite").parquet(f"{folder}/rows/__batch={number}")

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return table(spark, folder, schema, fold)
