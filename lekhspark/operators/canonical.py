"""From a raw export to canonical articles: one lazy plan of projections, no shuffle.

Defined cases: missing export columns are added as nulls; blank strings become null but are not trimmed; rows without
an ID are dropped (``load_report`` counts them); every other row is kept, repeats included; extra columns stay until
``canonical`` projects them away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekhspark.functions import dates, text, unicode
from lekhspark.operators.rejects import EXPORT_COLUMNS
from lekhspark.operators.vectors import ingest_report
from lekhspark.session import cut_lineage, one_per_key, settle_names
from lekhspark.sources.upsert import replace_table, upsert

MULTI_FIELDS = ("Categories", "Locations", "Tags", "Contributors")

# The columns of the canonical table, in order; those that exist are kept.
CANONICAL_COLUMNS = (
    "id", "published_date", "published_ts", "url", "title_hi", "summary_hi", "content_hi",
    *[f"{f.lower()}_{kind}" for kind in ("raw", "norm") for f in MULTI_FIELDS],
    "article_type", "multimedia_type", "partner_label", "content_hi_len", *EXPORT_COLUMNS,
)


def load_raw(df: DataFrame) -> DataFrame:
    """Header names trimmed, missing columns added, blanks null, ID trimmed; rows without ID included."""
    df = settle_names(df.toDF(*[c.strip() for c in df.columns]), EXPORT_COLUMNS)
    missing = [c for c in EXPORT_COLUMNS if c not in df.columns]
    strings = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    cols = [(text.non_blank(F.col(f"`{c}`")) if c in strings else F.col(f"`{c}`")).alias(c) for c in df.columns]
    out = df.select(*cols, *[F.lit(None).cast("string").alias(c) for c in missing])
    return out.withColumn("ID", text.trim_all(F.col("ID")))


def with_id(loaded: DataFrame) -> DataFrame:
    return loaded.where(F.col("ID").isNotNull())


def load_report(loaded: DataFrame) -> DataFrame:
    """One row: rows, rows without ID, kept rows without address, distinct IDs."""
    no_id = F.col("ID").isNull()
    return loaded.agg(
        F.count("*").alias("n_rows"), F.count_if(no_id).alias("n_null_id"),
        F.count_if(~no_id & F.col("Permalink").isNull()).alias("n_null_url"), F.countDistinct("ID").alias("n_distinct_id"),
    )


def title(row: str = "_yoast_wpseo_title", other: str = "Title") -> Column:
    return text.first_non_blank(F.col(row), F.col(other))


def summary(clean: Column, chars: int = 400) -> Column:
    """The summary, else the description, else the beginning of the cleaned content, cut before normalization."""
    return F.coalesce(text.non_blank(F.col("wph_summary")), text.non_blank(F.col("_yoast_wpseo_metadesc")), F.substring(clean, 1, chars))


def clean_text(loaded: DataFrame, compose: bool = True) -> DataFrame:
    """Adds ``title_hi, summary_hi, content_hi, content_hi_len``. ``compose=False`` leaves Unicode forms as they are (all in the JVM)."""
    norm = lambda c: F.coalesce(text.normal_text(unicode.repaired_nfkc(c) if compose else c), F.lit(""))
    out = loaded.withColumn("_clean", text.html_to_text(F.col("Content")))
    out = out.withColumns({"title_hi": norm(title()), "summary_hi": norm(summary(F.col("_clean"))), "content_hi": norm(F.col("_clean"))})
    return out.drop("_clean").withColumn("content_hi_len", F.length("content_hi"))


def normalize_metadata(cleaned: DataFrame) -> DataFrame:
    """Adds the list fields in both forms, dates, id, address and the renamed columns."""
    out = cleaned
    for f in MULTI_FIELDS:
        out = out.withColumn(f"{f.lower()}_raw", unicode.clean_tokens(text.split_pipe(F.col(f))))
        out = out.withColumn(f"{f.lower()}_norm", unicode.normal_tokens(F.col(f"{f.lower()}_raw")))
    out = out.withColumn("published_date", dates.to_iso(F.col("Date")))
    return out.withColumns({
        "published_ts": dates.to_epoch(F.col("published_date")), "url": text.non_blank(text.trim_all(F.col("Permalink"))),
        "article_type": F.col("wph_article_type"), "multimedia_type": F.col("wph_multimedia_type"), "partner_label": F.col("wph_partner_label"),
    })


def canonical(raw: DataFrame) -> DataFrame:
    """The whole first phase in one plan."""
    meta = normalize_metadata(clean_text(with_id(load_raw(raw))))
    have = set(meta.columns) | {"id"}
    # ``id`` and ``ID`` are one name to Spark, so the trimmed one stands for both.
    keep = [c for c in CANONICAL_COLUMNS if c in have and c != "ID"]
    return meta.select(*[F.col("ID").alias("id") if c == "id" else F.col(f"`{c}`") for c in keep])


def concat_exports(*exports: DataFrame, key: str = "ID", order: tuple[str, ...] = ()) -> DataFrame:
    """Union of exports by column name; of each key the row of the first export, then by ``order``."""
    parts = [e.withColumn("_file", F.lit(i)) for i, e in enumerate(exports)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_file", *order)
    return both.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n", "_file")


# The fields of the search index; those that are NOT NULL are required.
INDEX_SCHEMA = (
    "id string NOT NULL, url string NOT NULL, published_date string, published_ts bigint NOT NULL, title_hi string NOT NULL, summary_hi string, content_hi string, "
    "title_roman_norm string, summary_roman_norm string, content_roman_norm string, categories_norm array<string>, locations_norm array<string>, tags_norm array<string>, contributors_norm array<string>, "
    "article_type string, multimedia_type string, partner_label string, content_mixed_norm string"
)


def create_index(spark, path: str) -> dict:
    """An empty index table in place of any there is; gives its declared schema for export."""
    schema = T.StructType.fromDDL(INDEX_SCHEMA)
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return schema.jsonValue()


def upsert_index(spark, path: str, docs: DataFrame) -> DataFrame:
    """Documents replace those of the same id; one row with how many were written and refused (a required field is null), and a few refused ids."""
    schema = T.StructType.fromDDL(INDEX_SCHEMA)
    fits = F.lit(True)
    for f in schema.fields:
        if not f.nullable:
            fits = fits & F.col(f.name).isNotNull()
    report = cut_lineage(ingest_report(docs.select(F.col("id").alias("key"), fits.alias("ok"))))
    new = one_per_key(docs.where(fits).select(*schema.names), "id")
    replace_table(upsert(spark.read.parquet(path), new, ["id"]), path)
    return report


def index_documents(canon: DataFrame) -> DataFrame:
    """The search index's rows: required fields never null, romanized and mixed fields, lists without nulls."""
    blank = lambda c: F.when(~text.is_nullish(F.col(c)), F.col(c)).otherwise("")
    optional = lambda c: text.non_blank(F.col(c)).alias(c)
    roman = lambda c: text.roman_index(unicode.to_roman(blank(c)))
    return canon.select(
        F.col("id").cast("string").alias("id"), blank("url").alias("url"), optional("published_date"),
        dates.to_epoch(F.col("published_date")).alias("published_ts"),
        *[blank(c).alias(c) for c in ("title_hi", "summary_hi", "content_hi")],
        *[roman(f"{c}_hi").alias(f"{c}_roman_norm") for c in ("title", "summary", "content")],
        *[text.clean_list(F.col(f"{f.lower()}_norm")).alias(f"{f.lower()}_norm") for f in MULTI_FIELDS],
        *[optional(c) for c in ("article_type", "multimedia_type", "partner_label")],
    ).withColumn("content_mixed_norm", text.trim_all(F.concat_ws("\n\n", "content_hi", "content_roman_norm")))
