"""Keyed upserts and append-only logs over parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The tables of the log.
QUERY_LOG = "id bigint, created_at timestamp, query_raw string, query_mode string, query_used string, query_semantic string, filters string, ranker_version string, retrieval_version string, meta string"
CANDIDATE_LOG = (
    "id bigint, query_id bigint, rank int, article_id string, url string, title string, published_date string, summary string, primary_category string, "
    "categories array<string>, tags array<string>, location array<string>, partner_label string, contributors array<string>, score double, features string, explanation string"
)
RELEVANCE_LABELS = "id bigint, created_at timestamp, query_id bigint, article_id string, label int, note string"


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the row that comes last in ``order``; rows with a null key are one key."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of the same key; repeats inside ``new`` must be settled before (``latest``). Idempotent."""
    both = existing.withColumn("_b", F.lit(0)).unionByName(new.withColumn("_b", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.col("_b")]).drop("_b")


def create_log(spark, path: str, schema: str) -> None:
    """An empty log table, if there is none yet."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def next_ids(df: DataFrame, id_col: str, after: int, order: list[Column]) -> DataFrame:
    """``id_col`` from ``after + 1`` on, dense, in ``order``: counts per range partition, then places within it, so no task sees all rows."""

    ranged = df.withColumn("_o", F.struct(*order)).repartitionByRange("_o").sortWithinPartitions("_o").withColumn("_p", F.spark_partition_id())
    counts = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    starts, total = [], after
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    offsets = df.sparkSession.createDataFrame(starts, "_p int, _s bigint")
    w = Window.partitionBy("_p").orderBy("_o")
    return ranged.join(F.broadcast(offsets), "_p").withColumn(id_col, F.col("_s") + F.row_number().over(w)).drop("_p", "_s", "_o")


def replace_table(df: DataFrame, path: str) -> None:
    """Writes a table in place of the one it may be made from: first beside it, then by renaming, so that a failed write leaves the old one."""
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    beside, gone = f"{path.rstrip('/')}.{uuid.uuid4().hex}", f"{path.rstrip('/')}.{uuid.uuid4().hex}.old"
    df.write.parquet(beside)
    here = jvm.Path(path)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(here):
        fs.rename(here, jvm.Path(gone))
    fs.rename(jvm.Path(beside), here)
    fs.delete(jvm.Path(gone), True)
    spark.catalog.refreshByPath(path)


def append_log(path: str, rows: DataFrame, order: list[Column] | None = None) -> int:
    """Appends rows to a log table with ids that follow its largest one, in ``order`` (by all columns where none is given); gives the first of them.

    Columns are those of the table; missing ones become null. One writer at a time.
    """
    spark = rows.sparkSession
    table = spark.read.parquet(path)
    last = table.agg(F.max("id")).first()[0] or 0
    cols = [c for c in rows.columns if c != "id"]
    numbered = next_ids(rows.select(*cols), "id", last, order or [F.col(c) for c in cols])
    have = set(numbered.columns)
    numbered.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields]).write.mode("append").parquet(path)
    return last + 1
