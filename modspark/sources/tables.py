"""Table, stream and corpus readers, append writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark import schemas
from modspark.functions import text as T


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A ledger table with its declared schema."""
    return spark.read.schema(schemas.TABLES[table]).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int, **options) -> DataFrame:
    """The same from a database, split by key range so that no task reads it whole."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower), upperBound=str(upper),
        numPartitions=str(parts), **options).load()


def read_messages(spark: SparkSession, path: str, schema: str = schemas.MESSAGES, files_per_trigger: int | None = None) -> DataFrame:
    """A growing folder of message files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    if not _is_folder(spark, path):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def read_corpus(spark: SparkSession, path: str, label: str) -> DataFrame:
    """A JSON array of labelled texts; ``label`` is the column naming the group."""
    rows = spark.read.schema(f"`{label}` string, text string, expected_allowed boolean").option("multiLine", True).json(path)
    return rows.select(F.col(label).alias("group"), "text", "expected_allowed")


def align(df: DataFrame, table: str, defaults: dict[str, object]) -> DataFrame:
    """Old layouts: missing columns take their default, all get the declared type."""
    empty = df.sparkSession.createDataFrame([], schemas.TABLES[table])
    fields = []
    for f in empty.schema.fields:
        have = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in defaults:
            have = F.coalesce(have, F.lit(defaults[f.name]))
        fields.append(have.cast(f.dataType).alias(f.name))
    return df.select(*fields)


def append(df: DataFrame, path: str) -> None:
    """S8."""
    df.write.mode("append").parquet(path)


def append_redacted(df: DataFrame, path: str, *texts: str) -> None:
    """Text columns pass the redaction before they are written."""
    append(df.withColumns({t: T.redact(F.col(t)) for t in texts}), path)


def append_published(judged: DataFrame, allowed: str, published: str, failed: str) -> None:
    """Rows that passed the gate and rows that did not."""
    append(judged.where(F.col(allowed)), published)
    append(judged.where(~F.col(allowed)), failed)
