"""Readers and writers: CSV without type guesses, parquet, JSON reports, side tables. Missing files raise Spark's error."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekhspark.functions import text

# Headers under which an export may hold the featured image.
IMAGE_ALIASES = ("image_featured", "featured_image", "image_url")


def read_csv(spark: SparkSession, path: str | Sequence[str], records_span_lines: bool = True, **options) -> DataFrame:
    """Every column as text; quoted fields may hold line ends, doubled quotes stand for one.

    ``records_span_lines=False``, for exports that keep each record on one line, lets Spark split large files among tasks; otherwise each file is one task.
    """
    defaults = {"header": True, "inferSchema": False, "multiLine": records_span_lines, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "encoding": "UTF-8"}
    return spark.read.options(**{**defaults, **options}).csv(list(path) if not isinstance(path, str) else path)


def read_checked(spark: SparkSession, path: str | Sequence[str], **options) -> tuple[DataFrame, DataFrame]:
    """The sound rows of exports in the known columns, and the damaged ones with ``errors`` and ``reason``; rows are numbered in ``src_row``, in the order of a file.

    Records of other length than the header keep their text in ``_corrupt_record``.
    """
    from lekhspark.operators import rejects

    header = read_csv(spark, path, **options).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, "_corrupt_record"]])
    rows = spark.read.schema(schema).options(header=True, multiLine=options.get("records_span_lines", True), quote='"', escape='"', mode="PERMISSIVE", encoding="UTF-8", columnNameOfCorruptRecord="_corrupt_record").csv(list(path) if not isinstance(path, str) else path)
    rows = rows.toDF(*[c.strip() for c in rows.columns])
    for c in rejects.EXPORT_COLUMNS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    checked = rejects.check_rows(rows.withColumn("src_row", F.monotonically_increasing_id()))
    broken = F.when(F.col("_corrupt_record").isNotNull() & (F.size("errors") == 0), F.array(F.lit("columns: another number of fields than the header"))).otherwise(F.col("errors"))
    checked = checked.withColumn("errors", broken)
    return rejects.valid(checked).drop("_corrupt_record"), rejects.rejected(checked)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    (df.coalesce(1) if single_file else df).write.mode("overwrite").options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_report(report: DataFrame, path: str, limit: int = 10_000) -> dict:
    """A report's rows as an indented JSON file; refuses frames that are no report."""
    rows = [json.loads(r) for r in report.toJSON().take(limit + 1)]
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are no report")
    body = rows[0] if len(rows) == 1 else {"rows": rows}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(body, ensure_ascii=False, indent=2), encoding="utf-8")
    return body


def read_gazetteer_json(spark: SparkSession, path: str) -> DataFrame:
    """``field, ord, value, value_roman`` from ``{field: {values, values_roman_norm}}``."""
    body = T.StructType([T.StructField("values", T.ArrayType(T.StringType())), T.StructField("values_roman_norm", T.ArrayType(T.StringType()))])
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", T.MapType(T.StringType(), body)).alias("m"))
    one = raw.select(F.explode("m").alias("field", "g"))
    pairs = one.select(F.regexp_replace("field", "_norm$", "").alias("field"), F.posexplode(F.arrays_zip("g.values", "g.values_roman_norm")).alias("ord", "z"))
    return pairs.select("field", "ord", F.col("z.values").alias("value"), F.coalesce("z.values_roman_norm", text.roman_loose(F.col("z.values"))).alias("value_roman"))


def gazetteer_map(gazetteer: DataFrame) -> DataFrame:
    """The export form: one row with a map of parallel arrays (bounded by the gazetteer)."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "value", "value_roman")))
    per_field = gazetteer.groupBy("field").agg(ordered.alias("o"))
    entry = F.struct("field", F.struct(F.transform("o", lambda x: x["value"]).alias("values"), F.transform("o", lambda x: x["value_roman"]).alias("values_roman_norm")).alias("g"))
    return per_field.agg(F.map_from_entries(F.collect_list(entry)).alias("gazetteer"))


def featured_images(export: DataFrame, order_col: str | None = None) -> DataFrame:
    """``id, image_url`` of an export that has an image column under any alias; the last row of an ID wins."""
    target = next((c for c in export.columns if text.column_alias(c) in IMAGE_ALIASES), None)
    ident = next((c for c in export.columns if c in ("ID", "id")), None)
    if target is None or ident is None:
        return export.sparkSession.createDataFrame([], "id string, image_url string")
    order = F.col(order_col) if order_col else F.monotonically_increasing_id()  # rows of a file keep their order within one read
    rows = export.select(text.trim_all(F.col(f"`{ident}`")).alias("id"), text.trim_all(F.col(f"`{target}`")).alias("image_url"), order.alias("_o"))
    good = rows.where((F.col("id") != "") & (F.col("image_url") != ""))
    return good.groupBy("id").agg(F.max_by("image_url", "_o").alias("image_url"))


def schema_json(df: DataFrame) -> dict:
    """The live schema of a table, for export."""
    return df.schema.jsonValue()


# The core query set, version 1.
CORE_QUERIES = (
    "महिला सशक्तिकरण", "बिहार स्वास्थ्य", "आशा कार्यकर्ताओं का प्रशिक्षण बिहार", "शिक्षा कार्यक्रम", "किशोरियों के लिए योजना", "rural health workers training",
    "csr education impact", "mahila yojana bihar", "जलवायु परिवर्तन कृषि", "स्थानीय शासन पंचायत", "आदिवासी समुदाय अधिकार",
)


def core_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CORE_QUERIES, 1)), "query_id bigint, query string")
