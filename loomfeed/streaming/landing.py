"""STR1: a landing folder of review files as a stream; each micro-batch goes through the same import as a batch does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REVIEW_SCHEMA = "platform string, product_id string, product_url string, product_title string, user_name_masked string, rating string, review_time string, sku string, review_text_raw string"


def watch(spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame, int], None], schema: str = REVIEW_SCHEMA, once: bool = True) -> StreamingQuery:
    """Hand every new file's rows to handle(rows, batch number).  With once, what is there now is read and the query ends.

    A micro-batch may be handed over again after a failure: handle must leave what it has done already alone, as an import
    does whose files are known by hash (SNP1).
    """
    rows = spark.readStream.schema(schema).option("header", True).csv(path).withColumn("source_file", F.input_file_name())
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer).start()


def first_sights(rows: DataFrame, *key: str, time: str | None = None, within: str | None = None) -> DataFrame:
    """STR1, SNP1: rows of a stream whose key (an item and the hash of its file, say) no micro-batch has had before.  The keys
    are state of the query: they survive a restart.  With time and within (as "30 days") a key is forgotten so long after it was
    first seen, so that the state stays bounded."""
    if time is None or within is None:
        return rows.dropDuplicates(list(key))
    return rows.withWatermark(time, within).dropDuplicatesWithinWatermark(list(key))


def land(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now to the table at path, each micro-batch once, whatever is retried."""
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").format("parquet").start(path)
