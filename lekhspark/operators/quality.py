"""Reports on canonical articles, each one pass. Empty tables give zeros or nulls, never an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhspark.functions import text

REPORTED = ("id", "url", "title_hi", "summary_hi", "content_hi", "published_date")


def quality_report(canon: DataFrame, columns: tuple[str, ...] = REPORTED, length_col: str = "content_hi_len") -> DataFrame:
    """One row: rows, nulls of each column (null for absent columns), least, quartiles and largest of the length, cut to whole numbers."""
    nulls = [(F.count_if(F.col(c).isNull()) if c in canon.columns else F.lit(None).cast("long")).alias(f"null_{c}") for c in columns]
    q = F.percentile(F.col(length_col), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    row = canon.agg(F.count("*").alias("n_rows"), *nulls, F.min(length_col).alias("len_min"), q.alias("q"), F.max(length_col).alias("len_max"))
    return row.select("n_rows", *[f"null_{c}" for c in columns], "len_min", *[F.get("q", F.lit(i)).cast("int").alias(f"len_p{p}") for i, p in enumerate((25, 50, 75))], "len_max")


def short_articles(canon: DataFrame, least: int = 200) -> DataFrame:
    """``id, url, clean_len`` of articles whose content is shorter than ``least``."""
    n = F.coalesce(F.length("content_hi"), F.lit(0))
    return canon.select("id", "url", n.alias("clean_len")).where(F.col("clean_len") < least)


def contaminated(canon: DataFrame, above: float = 0.10) -> DataFrame:
    """Articles of which more than ``above`` of the characters are Latin, with shares and a beginning of 200 characters."""
    s = text.script_stats(F.col("content_hi"))
    out = canon.select("id", F.round(s["latin_pct"], 6).alias("latin_pct"), F.round(s["dev_pct"], 6).alias("dev_pct"), F.substring("content_hi", 1, 200).alias("snippet"), s["latin_pct"].alias("_p"))
    return out.where(F.col("_p") > above).drop("_p")


def contaminated_sample(canon: DataFrame, order_col: str = "id", n: int = 25, above: float = 0.10) -> DataFrame:
    """The report's sample: the first ``n`` such articles in ``order_col``."""
    return contaminated(canon, above).orderBy(order_col, "snippet").limit(n)


def chunk_samples(chunks: DataFrame, n: int = 10) -> DataFrame:
    """The report's sample: the first ``n`` chunks by article and index."""
    return chunks.select("article_id", "chunk_index", "chunk_id", "chunk_tokens", "chunk_text").distinct().orderBy("article_id", "chunk_index", "chunk_id").limit(n)


def parse_report(articles: DataFrame, text_col: str = "Content") -> DataFrame:
    """One row: texts, those whose markup could not be read as such, and those that are null."""
    s = text.html_stats(F.col(text_col))
    return articles.select(s.alias("s")).agg(F.count("*").alias("n_rows"), F.count_if(~F.col("s.ok")).alias("n_failed"), F.count_if(F.col("s.reason") == "null").alias("n_null"))


def script_samples(canon: DataFrame, n: int = 50, chars: int = 160) -> DataFrame:
    """The report's sample: the first ``n`` articles by id with their script shares."""
    s = text.script_stats(F.col("content_hi"))
    return canon.select("id", s["dev_pct"].alias("dev_pct"), s["latin_pct"].alias("latin_pct"), F.coalesce(F.substring("content_hi", 1, chars), F.lit("")).alias("snippet")).orderBy("id").limit(n)


def empty_lists(canon: DataFrame, fields: tuple[str, ...] = ("categories_raw", "locations_raw", "tags_raw", "contributors_raw")) -> DataFrame:
    """One row: articles whose list is empty or null, for each field."""
    return canon.agg(*[F.count_if(F.coalesce(F.size(F.col(f)), F.lit(0)) <= 0).alias(f"empty_{f}") for f in fields])


def facet_counts(docs: DataFrame, *fields: str) -> DataFrame:
    """``field, value, n``: documents by each value of list or plain fields. Pre-aggregated before the shuffle."""
    parts = []
    for f in fields:
        values = F.col(f) if docs.schema[f].dataType.typeName() == "array" else F.array(F.col(f))
        parts.append(docs.select(F.explode(F.array_distinct(values)).alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n")).select(F.lit(f).alias("field"), "value", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
