"""The running edge aggregate as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.session import checkpoint_root, keep_until_release

KEYS = ["snapshot_id", "from_entity", "to_entity", "dep_type"]


def edge_stream(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None, files_per_trigger: int = 16) -> DataFrame:
    """Edge rows as files arrive in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder).where("trim(from_entity) != '' and trim(to_entity) != ''")


def running_edges(stream: DataFrame) -> DataFrame:
    """Sum of counts and number of additions per edge; the state is one row per distinct edge."""
    return stream.groupBy(*KEYS).agg(F.sum(F.coalesce(F.col("reference_count").cast("bigint"), F.lit(0))).alias("reference_count"), F.count(F.lit(1)).alias("times_added"))


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there now and give the resulting table.

    Each batch sums its own files, and its partial sums are appended as a table under the batch's number;
    a batch that is repeated after a failure replaces its own table, so nothing counts twice.
    """
    spark = stream.sparkSession
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        running_edges(batch).write.mode("overwrite").parquet(f"{root}/sums/batch={number}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    keep_until_release(spark, root)
    parts = spark.read.parquet(f"{root}/sums")
    return parts.groupBy(*KEYS).agg(F.sum("reference_count").alias("reference_count"), F.sum("times_added").alias("times_added"))
