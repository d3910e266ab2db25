"""Fusion of the retrieval legs, the feature ranker, and pages of its result, for a table of queries at once.

Candidates of a query are capped before they are ranked, so the windows here never hold more than the cap for one query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhspark.functions import dates, text
from lekhspark.session import broadcast_if_small, cut_lineage, one_per_key, one_per_key_in_place

CANDIDATE_CAP, LOG_TOP, RANKER, RETRIEVAL = 200, 200, "v1", "hybrid-1"

# Parts of the score in their order, with their weights.
WEIGHTS = (("lex", 1.0), ("sem_chunk", 0.40), ("sem_article", 0.18), ("tag_overlap", 0.12), ("cat_overlap", 0.10), ("loc_overlap", 0.15), ("contrib_overlap", 0.06), ("recency", 0.08), ("entity_conf", 0.10))
# Overlaps by list, and the count from which each is full.
OVERLAPS = (("tag_overlap", "tags_norm", 2.0), ("cat_overlap", "categories_norm", 2.0), ("loc_overlap", "locations_norm", 1.0), ("contrib_overlap", "contributors_norm", 1.0))
LISTS = ("categories", "tags", "locations", "contributors")


def fuse(lexical: DataFrame, articles: DataFrame, chunks: DataFrame, cap: int = CANDIDATE_CAP) -> DataFrame:
    """One row per query and article that any leg found.

    ``lexical``: query_id, id, lexical_score; ``articles``: query_id, id, score; ``chunks``: query_id, chunk_id, article_id, score.
    Scores are never below 0; a best chunk needs a positive score, the first best wins. The ``cap`` candidates with the largest
    sum of raw scores stay, ties by id; ``pre_rank`` is that order.
    """
    none = lambda t: F.lit(None).cast(t)
    legs = (
        lexical.select("query_id", F.col("id").cast("string").alias("article_id"), F.lit("l").alias("leg"), F.col("lexical_score").alias("s"), none("string").alias("chunk_id"))
        .unionByName(articles.select("query_id", F.col("id").cast("string").alias("article_id"), F.lit("a").alias("leg"), F.col("score").alias("s"), none("string").alias("chunk_id")))
        .unionByName(chunks.where(F.col("chunk_id").isNotNull() & F.col("article_id").isNotNull()).select("query_id", F.col("article_id").cast("string").alias("article_id"), F.lit("c").alias("leg"), F.col("score").alias("s"), "chunk_id"))
    )
    of = lambda leg: F.greatest(F.coalesce(F.max(F.when(F.col("leg") == leg, F.col("s"))), F.lit(0.0)), F.lit(0.0))
    best = F.min(F.when((F.col("leg") == "c") & (F.col("s") > 0), F.struct((-F.col("s")).alias("s"), "chunk_id")))
    one = legs.groupBy("query_id", "article_id").agg(
        of("l").alias("lexical_score"), of("a").alias("sem_article"), of("c").alias("sem_chunk"), best.alias("_b"),
        F.bool_or(F.col("leg") == "l").alias("src_lexical"), F.bool_or(F.col("leg") == "a").alias("src_sem_article"), F.bool_or(F.col("leg") == "c").alias("src_sem_chunk"),
    )
    total = F.round(F.col("lexical_score") + F.col("sem_chunk") + F.col("sem_article"), 9)
    w = Window.partitionBy("query_id").orderBy(total.desc(), "article_id")
    return one.withColumn("best_chunk_id", F.col("_b.chunk_id")).drop("_b").withColumn("pre_rank", F.row_number().over(w)).where(F.col("pre_rank") <= cap)


def leg_counts(lexical: DataFrame, articles: DataFrame, chunks: DataFrame, candidates: DataFrame) -> DataFrame:
    """``query_id, lex_n, sem_article_n, sem_chunk_n, cand_n``."""
    parts = [d.select("query_id", F.lit(i).alias("leg")) for i, d in enumerate((lexical, articles, chunks, candidates))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return both.groupBy("query_id").agg(*[F.count_if(F.col("leg") == i).alias(n) for i, n in enumerate(("lex_n", "sem_article_n", "sem_chunk_n", "cand_n"))])


def article_metadata(canon: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """What hits show of an article and the ranker compares; lists are never null. Repeated articles stay repeated: ``with_metadata`` settles those it needs."""
    as_list = lambda c: text.as_list(F.col(c), canon.schema[c].dataType.typeName() == "array")
    lists = [as_list(f"{f}_{kind}").alias(f"{f}{suffix}") for f in LISTS for kind, suffix in (("raw", ""), ("norm", "_norm"))]
    out = canon.select(F.col("id").cast("string").alias("article_id"), *[text.non_blank(F.col(c)).alias(n) for c, n in (("url", "url"), ("title_hi", "title"), ("summary_hi", "summary"), ("published_date", "published_date"), ("partner_label", "partner_label"))], F.coalesce("published_ts", F.lit(0)).alias("published_ts"), *lists)
    out = out.withColumn("primary_category", F.get("categories", F.lit(0)))
    if images is None:
        return out.withColumn("image_url", F.lit(None).cast("string"))
    return out.join(images.select(F.col("id").alias("article_id"), "image_url"), "article_id", "left")


#: What of an article's metadata the ranker reads.
RANKED_BY = ("published_ts", *[field for _, field, _ in OVERLAPS])


def settled_metadata(candidates: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row for each article that ``candidates`` name; of a repeated one the smallest counts. Only the rows of repeated articles are shuffled."""
    wanted = broadcast_if_small(candidates.select("article_id").distinct())
    return one_per_key_in_place(metadata.join(wanted, "article_id", "left_semi"), "article_id")


def joined_metadata(rows: DataFrame, settled: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``settled``; a missing article gives nulls, empty lists and time 0."""
    out = rows.join(settled, "article_id", "left")
    empty = F.array().cast("array<string>")
    given = {c: F.coalesce(c, empty) for f in LISTS for c in (f, f"{f}_norm")} | {"published_ts": F.coalesce("published_ts", F.lit(0))}
    return out.withColumns({c: x for c, x in given.items() if c in settled.columns})


def with_metadata(candidates: DataFrame, metadata: DataFrame) -> DataFrame:
    """Candidates with their article's columns; a missing article gives nulls, empty lists and time 0."""
    candidates = cut_lineage(candidates)
    return joined_metadata(candidates, settled_metadata(candidates, metadata))


def _minmax(c: str) -> Column:
    w = Window.partitionBy("query_id")
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high - low < 1e-9, F.lit(0.0)).otherwise((F.col(c) - low) / (high - low))


def rank(candidates: DataFrame, queries: DataFrame, now_ts: int, confidence: DataFrame | None = None) -> DataFrame:
    """Candidates with ``score, rank, features, explanation``.

    ``queries``: query_id, query (its tokens are compared to whole list values); ``confidence``: query_id, entity_conf
    (a map of points by field). Equal scores keep ``pre_rank`` order.
    """
    # Requests are few: lists are compared where the candidates lie, and needn't be shuffled by query.
    c = candidates.join(broadcast_if_small(queries.select("query_id", F.array_distinct(text.tokens(F.col("query"))).alias("_q"))), "query_id")
    if confidence is not None:
        c = c.join(broadcast_if_small(confidence.select("query_id", "entity_conf")), "query_id", "left")
    else:
        c = c.withColumn("entity_conf", F.lit(None).cast("map<string,int>"))
    c = c.withColumn("entity_conf", F.coalesce("entity_conf", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))))
    for name, field, full in OVERLAPS:
        c = c.withColumn(f"_{name}_n", F.size(F.array_intersect("_q", field)))
        c = c.withColumn(name, F.least(F.lit(1.0), F.col(f"_{name}_n") / F.lit(full)))
    points = F.aggregate(F.map_values("entity_conf"), F.lit(0), lambda a, x: a + x)
    c = c.withColumns({"recency": dates.recency(F.col("published_ts"), F.lit(now_ts)), "entity_conf_score": F.least(F.lit(1.0), F.greatest(F.lit(0.0), points / F.lit(6.0)))})
    c = c.withColumns({"lex": _minmax("lexical_score"), "_sc": _minmax("sem_chunk"), "_sa": _minmax("sem_article")})
    value = {n: F.col({"sem_chunk": "_sc", "sem_article": "_sa", "entity_conf": "entity_conf_score"}.get(n, n)) * F.lit(w) for n, w in WEIGHTS}
    parts = F.array(*[F.struct(F.lit(n).alias("name"), value[n].alias("score"), F.lit(i).alias("_o")) for i, (n, _) in enumerate(WEIGHTS)])
    order = F.array_sort(parts, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["_o"] - b["_o"]))
    # The names of the 17 features in their order.
    features = F.struct(
        F.col("lexical_score").alias("lexical_score_raw"), F.col("sem_article").alias("sem_article_raw"), F.col("sem_chunk").alias("sem_chunk_raw"),
        F.col("lex").alias("lex_norm"), F.col("_sa").alias("sem_article_norm"), F.col("_sc").alias("sem_chunk_norm"),
        *[F.col(f"_{n}_n").alias(f"{n}_count") for n, _, _ in OVERLAPS],
        "recency", "entity_conf_score", F.col("entity_conf").alias("entity_conf_raw"), "best_chunk_id", "src_lexical", "src_sem_article", "src_sem_chunk",
    )
    total = value[WEIGHTS[0][0]]
    for n, _ in WEIGHTS[1:]:
        total = total + value[n]
    c = c.withColumns({"score": F.round(total, 9), "features": features, "explanation": F.transform(F.slice(order, 1, 4), lambda x: F.struct(x["name"].alias("name"), x["score"].alias("score")))})
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "pre_rank")
    hidden = ["_q", "_sc", "_sa", "lex", "recency", "entity_conf_score", "entity_conf", *[x for n, _, _ in OVERLAPS for x in (n, f"_{n}_n")]]
    return c.withColumn("rank", F.row_number().over(w)).drop(*hidden)


def page(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows of each query's page with ``total_results, total_pages, page, per_page``.

    ``queries``: query_id, page, per_page; sizes below 1 count as 1, pages beyond the end as the last one.
    """
    w = Window.partitionBy("query_id")
    size = F.greatest(F.lit(1), F.col("per_page"))
    r = ranked.join(queries.select("query_id", size.alias("per_page"), F.greatest(F.lit(1), F.col("page")).alias("page")), "query_id")
    r = r.withColumn("total_results", F.count("*").over(w)).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total_results") / F.col("per_page"))).cast("int"))
    r = r.withColumn("page", F.least("page", "total_pages"))
    start = (F.col("page") - 1) * F.col("per_page")
    return r.where((F.col("rank") > start) & (F.col("rank") <= start + F.col("per_page")))


def with_snippets(hits: DataFrame, chunks: DataFrame, chars: int = 420) -> DataFrame:
    """Hits with the beginning of their best chunk. Hits are few, so their chunk ids are broadcast and only the beginnings of the texts they name are shuffled."""
    hits = cut_lineage(hits)
    wanted = broadcast_if_small(hits.select(F.col("best_chunk_id").alias("chunk_id")).distinct())
    texts = one_per_key_in_place(chunks.select("chunk_id", "chunk_text").join(wanted, "chunk_id", "left_semi"), "chunk_id")
    text_of = texts.select("chunk_id", text.snippet(F.col("chunk_text"), chars).alias("snippet"))
    return hits.join(text_of, hits["best_chunk_id"] == text_of["chunk_id"], "left").drop("chunk_id")


def resort(hits: DataFrame, mode: str = "relevance") -> DataFrame:
    """``place`` of each hit by relevance, newest or oldest first; unreadable dates come last."""
    if mode not in ("relevance", "newest", "oldest"):
        raise ValueError(f"unknown order {mode!r}")
    ts = dates.parse_timestamp(F.col("published_date"))
    first = [] if mode == "relevance" else [ts.desc_nulls_last() if mode == "newest" else ts.asc_nulls_last()]
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*first, "rank")))


def reveal(placed: DataFrame, shown: int = 10) -> DataFrame:
    """What a client shows: the first places, dates as day-month-year, at most three locations and tags, text made safe."""
    date = F.coalesce(F.date_format(dates.parse_timestamp(F.col("published_date")), "dd-MM-yyyy"), F.col("published_date"), F.lit(""))
    return placed.where(F.col("place") <= shown).withColumns({"shown_date": date, "shown_locations": F.slice("locations", 1, 3), "shown_tags": F.slice("tags", 1, 3), "shown_title": text.escape_html(F.coalesce("title", F.lit("")))})
