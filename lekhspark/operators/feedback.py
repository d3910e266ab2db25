"""The logs of queries, candidates and labels, with their constraints.

Rows that break a constraint are set apart, never dropped in silence. Empty inputs give empty results; repeated labels are repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhspark.operators.ranking import LOG_TOP, RANKER, RETRIEVAL
from lekhspark.session import cut_lineage
from lekhspark.sources.upsert import append_log, next_ids


def label_errors(query_level: bool = False) -> Column:
    """What is wrong with a label row: labels are 0 or 1; those of a whole query are 0 and name no article."""
    label = F.col("label")
    if query_level:
        return F.array_compact(F.array(F.when(~F.coalesce(label == 0, F.lit(False)), F.lit("only 0 labels a query")), F.when(F.col("article_id").isNotNull(), F.lit("a query label names no article"))))
    return F.array_compact(F.array(F.when(~F.coalesce(label.isin(0, 1), F.lit(False)), F.lit("label must be 0 or 1"))))


def check_labels(labels: DataFrame, query_log: DataFrame) -> DataFrame:
    """``labels`` with ``errors``; a label whose query isn't logged is an error too."""
    known = query_log.select(F.col("id").alias("_q")).distinct()
    joined = labels.join(known, labels["query_id"] == F.col("_q"), "left")
    wrong = F.when(F.col("article_id").isNull(), label_errors(True)).otherwise(label_errors())
    return joined.withColumn("errors", F.concat(wrong, F.when(F.col("_q").isNull(), F.array(F.lit("no such query"))).otherwise(F.array().cast("array<string>")))).drop("_q")


def referencing(child: DataFrame, parent: DataFrame, fk: str = "query_id", pk: str = "id") -> DataFrame:
    """Rows whose key the parent has."""
    return child.join(parent.select(F.col(pk).alias(fk)), fk, "left_semi")


def cascade_delete(child: DataFrame, deleted: DataFrame, fk: str = "query_id", pk: str = "id") -> DataFrame:
    """What stays of ``child`` when the parents in ``deleted`` go."""
    return child.join(deleted.select(F.col(pk).alias(fk)), fk, "left_anti")


def query_rows(queries: DataFrame, counts: DataFrame, created_at: Column) -> DataFrame:
    """Rows of the query log (``id`` is the query_id)."""
    q = queries.join(counts, "query_id", "left")
    filters = F.when(F.col("filter_by").isNotNull(), F.to_json(F.struct("filter_by")))
    meta = F.to_json(F.struct("lex_n", "sem_article_n", "sem_chunk_n", "cand_n", "filter_by_auto", "filter_by_final"))
    return q.select(
        F.col("query_id").alias("id"), created_at.alias("created_at"), F.col("query").alias("query_raw"), F.col("mode").alias("query_mode"), "query_used", "query_semantic",
        filters.alias("filters"), F.lit(RANKER).alias("ranker_version"), F.lit(RETRIEVAL).alias("retrieval_version"), meta.alias("meta"),
    )


def candidate_rows(ranked: DataFrame, top: int = LOG_TOP) -> DataFrame:
    """Rows of the candidate log: the first ``top`` of each query."""
    return ranked.where(F.col("rank") <= top).select(
        "query_id", "rank", "article_id", "url", "title", "published_date", "summary", "primary_category", "categories", "tags", F.col("locations").alias("location"),
        "partner_label", "contributors", "score", F.to_json("features").alias("features"), F.to_json("explanation").alias("explanation"),
    )


def label_summary(labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """``query_id, n_labels, n_relevant, precision_at_10``: labels read back against the logged ranks."""
    last = labels.where(F.col("article_id").isNotNull()).groupBy("query_id", "article_id").agg(F.max_by("label", "id").alias("label"))
    j = last.join(candidates.select("query_id", "article_id", "rank"), ["query_id", "article_id"], "left")
    top = F.when(F.col("rank") <= 10, F.col("label"))
    return j.groupBy("query_id").agg(F.count("*").alias("n_labels"), F.sum("label").alias("n_relevant"), F.round(F.avg(top), 6).alias("precision_at_10"))


def append_labels(path: str, labels: DataFrame, query_log: DataFrame) -> DataFrame:
    """Appends the labels without errors to the label table and gives back the others, with ``errors``. Rows: created_at, query_id, article_id (null for a label of the whole query), label, note."""
    checked = cut_lineage(check_labels(labels, query_log))
    good = checked.where(F.size("errors") == 0).drop("errors")
    append_log(path, good, [F.col("created_at"), F.col("query_id"), F.col("article_id"), F.col("label"), F.col("note")])
    return checked.where(F.size("errors") > 0)


def append_search(query_path: str, candidate_path: str, result: dict[str, DataFrame], created_at: Column, top: int = LOG_TOP) -> DataFrame:
    """Appends a search (``hybrid.search``) to the query and candidate logs; gives ``query_id, logged_id``.

    Queries get new ids; their candidates refer to these, so no candidate is without its query.
    """
    q = cut_lineage(query_rows(result["queries"], result["counts"], created_at).withColumnRenamed("id", "query_id"))
    spark = q.sparkSession
    last = spark.read.parquet(query_path).agg(F.max("id")).first()[0] or 0
    named = cut_lineage(next_ids(q, "id", last, [F.col("query_id")]))
    schema = spark.read.parquet(query_path).schema
    named.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("append").parquet(query_path)
    ids = named.select("query_id", F.col("id").alias("logged_id"))
    rows = candidate_rows(result["ranked"], top).join(F.broadcast(ids), "query_id").drop("query_id").withColumnRenamed("logged_id", "query_id")
    append_log(candidate_path, rows, [F.col("query_id"), F.col("rank")])
    return ids
