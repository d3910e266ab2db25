"""Streams of queries and labels: windowed counts with a bound on lateness, and idempotent upserts by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhspark.session import cut_lineage
from lekhspark.sources.upsert import latest


def query_counts(stream: DataFrame, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Queries by window and mode; rows later than ``late`` are not counted in a stream (a batch has no lateness)."""
    counted = stream.withWatermark("created_at", late).groupBy(F.window("created_at", window).alias("w"), "query_mode").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "query_mode", "n")


def without_retries(stream: DataFrame, within: str = "1 hour") -> DataFrame:
    """Each id once, however often it is delivered within the watermark."""
    return stream.withWatermark("created_at", within).dropDuplicatesWithinWatermark(["id"])


BUCKETS = 64


def upsert_sink(path: str, keys: list[str], order: str, buckets: int = BUCKETS):
    """A foreachBatch function that keeps the latest row of each key in the table at ``path``.

    Rows lie in buckets by the hash of their key; a batch reads and writes only the buckets its keys fall in, beside the older ones and
    named by its number, so a batch that runs twice gives the same table. Only batches that were written to their end (``_SUCCESS``) count;
    what two later batches have replaced is deleted. A row without an order is older than any with one.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, keys, [F.col(order)]).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        new = cut_lineage(new)
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        before = _versions(spark, path, number)
        old = [before[b][0][1] for b in touched if b in before]
        out = new
        if old:
            both = spark.read.option("basePath", path).parquet(*old).drop("batch").withColumn("_b", F.lit(0)).unionByName(new.withColumn("_b", F.lit(1)), allowMissingColumns=True)
            out = latest(both, keys, [F.col(order), F.col("_b")]).drop("_b")
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")
        fs, hadoop = _file_system(spark, path)
        for b in touched:
            for _, folder in before.get(b, [])[1:]:  # the newest stays for a reader that has begun
                fs.delete(hadoop.Path(folder), True)

    return write


def _file_system(spark, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _versions(spark, path: str, below: int | None = None) -> dict[int, list[tuple[int, str]]]:
    """Of each bucket the finished batches that hold it with their folders, newest first."""
    fs, hadoop = _file_system(spark, path)
    out: dict[int, list[tuple[int, str]]] = {}
    for b in fs.globStatus(hadoop.Path(f"{path}/batch=*")) or []:
        number = int(b.getPath().getName().split("=")[1])
        if below is not None and number >= below or not fs.exists(hadoop.Path(b.getPath(), "_SUCCESS")):
            continue
        for f in fs.listStatus(b.getPath()):
            if f.getPath().getName().startswith("bucket="):
                out.setdefault(int(f.getPath().getName().split("=")[1]), []).append((number, f.getPath().toString()))
    return {k: sorted(v, reverse=True) for k, v in out.items()}


def current(spark, path: str) -> DataFrame:
    """The table as the finished batches left it."""
    folders = [v[0][1] for v in _versions(spark, path).values()]
    if not folders:
        raise FileNotFoundError(f"no finished batch at {path}")
    return spark.read.option("basePath", path).parquet(*folders).drop("batch", "bucket")
