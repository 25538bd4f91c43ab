"""Incremental ingestion of pages from a landing folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom import schemas
from paperloom.operators.crawl import Scope, parse_pages


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New JSON files of pages in ``folder``."""
    return spark.readStream.schema(schemas.PAGES).option("maxFilesPerTrigger", files_per_batch).json(folder)


def ingest_pages(stream: DataFrame, target: str, checkpoint: str, scope: Scope, once: bool = True, buckets: int = 64, prepare: Callable[[Column], Column] | None = None) -> StreamingQuery:
    """Parse each batch and append pages whose address the table hasn't got; of one address in a batch the least html counts.

    The table is partitioned by bucket of the address, then by batch. A batch
    looks only into the buckets that it has addresses of, and there reads
    addresses only; ``prepare`` changes the html that is parsed. A batch that is run again overwrites its own part, so a
    restart adds nothing twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        once = batch.groupBy("url").agg(F.min("html").alias("html"))
        dealt = once.withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int"))
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            own = [r["bucket"] for r in dealt.select("bucket").distinct().collect()]  # at most ``buckets``
            old = spark.read.schema("url STRING, bucket INT, batch INT").parquet(target).filter(F.col("bucket").isin(own) & (F.col("batch") < number)).select("bucket", "url")
            dealt = dealt.join(old, ["bucket", "url"], "left_anti")
        ready = dealt if prepare is None else dealt.withColumn("html", prepare(F.col("html")))
        parsed = parse_pages(ready, scope).withColumns({"bucket": F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int"), "batch": F.lit(number)})
        parsed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(target)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
