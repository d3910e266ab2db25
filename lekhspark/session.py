"""Session factory and the settings the plans rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings every session gets. Partition counts are left to AQE and to the caller.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # a checkpoint goes when nothing refers to it any more
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", app: str = "lekhspark", **conf: str) -> SparkSession:
    """A session with BASE_CONF; ``conf`` keys use ``__`` for dots and win over the base."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**BASE_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset and all runs in this process (local tests) a folder of this machine is used, and removed at the end; elsewhere an unset folder is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lekhspark-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(Path(folder).as_uri())
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor costs no recomputation upstream."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def smaller_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that are planned and run inside (``cut_lineage``) send Python at most ``rows`` rows at once: of long texts the usual number takes much memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settle_names(df: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """``df`` with extra columns renamed (``name_extra0``) whose names repeat another or a needed one but for case; Spark can't tell those apart."""
    seen: set[str] = set()
    lower = {n.lower() for n in needed}
    names = []
    for i, c in enumerate(df.columns):
        if c in needed and c.lower() not in seen or c.lower() not in lower and c.lower() not in seen:
            seen.add(c.lower())
            names.append(c)
        else:
            names.append(f"{c}_extra{i}")
    return df.toDF(*names) if names != df.columns else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows (they are counted, never further), else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def one_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """Of each key the row that is smallest by its other columns in their order (nulls first), so the choice doesn't depend on partitions."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def one_per_key_in_place(df: DataFrame, key: str) -> DataFrame:
    """``one_per_key`` for a table that is cheap to read twice and whose keys seldom repeat: only keys are shuffled, and the rows of repeated ones."""
    twice = cut_lineage(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(F.col(key).alias("_key")))
    few = broadcast_if_small(twice)
    same = df[key].eqNullSafe(few["_key"])
    return df.join(few, same, "left_anti").unionByName(one_per_key(df.join(few, same, "left_semi"), key))
