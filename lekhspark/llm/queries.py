"""The subpackage's registered queries (spark, sf_dir) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhspark.llm import abuse, bpe, knn, langid, leakage, pieces, plainform, truncation
from lekhspark.plans import sql
from lekhspark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# 1: oversized items


@query
def p1_found(spark, d):
    return pieces.found(table(spark, d, "chunks"), table(spark, d, "articles_canonical"))


@query
def p1_pieces(spark, d):
    """Every piece of every item, both tables; a repeated row of one key counts once."""
    chunks = pieces.split_items(table(spark, d, "chunks").select("chunk_id", "chunk_text").distinct(), "chunk_id", "chunk_text")
    articles = pieces.split_items(table(spark, d, "articles_canonical").select("id", "content_hi").distinct(), "id", "content_hi")
    return chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("item_id"), *PIECES).unionByName(
        articles.select(F.lit("article").alias("kind"), F.col("id").alias("item_id"), *PIECES)
    )


PIECES = [c.split()[0] for c in pieces.PIECE_SCHEMA.split(", ")]

_TOKENS = r"len(regexp_extract_all({0}, '[^\t-\r \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'))"
ORACLE_SQL["p1_found"] = f"""
SELECT DISTINCT 'chunk' AS kind, chunk_id AS item_id FROM chunks WHERE length(chunk_text) > 3000 OR {_TOKENS.format("chunk_text")} > 384
UNION ALL
SELECT DISTINCT 'article' AS kind, id AS item_id FROM articles_canonical WHERE length(content_hi) > 3000 OR {_TOKENS.format("content_hi")} > 384
"""


# 2: languages


@query
def p2_found(spark, d):
    return langid.found(table(spark, d, "articles_canonical"), langid.fit(table(spark, d, "documents")))


@query
def p2_segments(spark, d):
    """Every stretch of every article with its language and confidence."""
    articles = table(spark, d, "articles_canonical").select("id", "content_hi").distinct()
    return langid.segment(articles, langid.fit(table(spark, d, "documents")))


@query
def p2_articles(spark, d):
    return langid.label_articles(table(spark, d, "articles_canonical"), table(spark, d, "quality_report"), langid.fit(table(spark, d, "documents")))


# 4: cut texts


@query
def p4_found(spark, d):
    return truncation.found(table(spark, d, "articles_canonical"))


@query
def p4_rates(spark, d):
    return truncation.rates(table(spark, d, "articles_canonical"))


# 5: one plain form


@query
def p5_found(spark, d):
    return plainform.found(table(spark, d, "articles_canonical"), table(spark, d, "query_log"))


@query
def p5_plain_titles(spark, d):
    """The plain form of every title and query, with the rows that share it."""
    titles = plainform.plain_columns(table(spark, d, "articles_canonical"), "id", "title_hi")
    asked = plainform.plain_columns(table(spark, d, "query_log"), "id", "query_raw")
    return titles.unionByName(asked).groupBy("field", "plain").agg(F.count("*").alias("n_rows"), F.countDistinct("text").alias("n_spellings"))


# 7: nearest vectors


@query
def p7_found(spark, d):
    return knn.found(table(spark, d, "article_vectors"), table(spark, d, "chunk_vectors"))


def _mutual(kind: str, *_: str) -> str:
    return f"""SELECT '{kind}' AS kind, t.a AS id_a, t.b AS id_b FROM {kind}_top t JOIN {kind}_top u ON t.a = u.b AND t.b = u.a WHERE t.a < t.b"""


def _top(kind: str, name: str, key: str) -> str:
    return f"""{kind}_v AS {sql.unit_vectors(name, key)}, {kind}_top AS (SELECT a, b FROM (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS n FROM
      (SELECT x.key AS a, y.key AS b, round(list_cosine_similarity(x.v::DOUBLE[], y.v::DOUBLE[]), 9) AS c FROM {kind}_v x, {kind}_v y WHERE x.key <> y.key)) WHERE n <= 5 AND c >= 0.9)"""


_VECTOR_TABLES = (("article", "article_vectors", "id"), ("chunk", "chunk_vectors", "chunk_id"))
#: Brute force over all pairs, for the small tables the statements run on.
ORACLE_SQL["p7_found"] = "WITH " + ", ".join(_top(*t) for t in _VECTOR_TABLES) + " " + " UNION ALL ".join(_mutual(*t) for t in _VECTOR_TABLES)


@query
def p7_neighbours(spark, d):
    """Five nearest keys of every key, both tables."""
    parts = []
    for kind, name, key in _VECTOR_TABLES:
        v = table(spark, d, name)
        parts.append(knn.members(knn.neighbours(v, key)).unionByName(knn.further_members(v, key)).select(F.lit(kind).alias("kind"), "a", "rank", "b", "cos"))
    return parts[0].unionByName(parts[1])


# 8: tokenizer


@query
def p8_ids(spark, d):
    return bpe.encode_corpus(table(spark, d, "documents"))


# 9: leaked evaluation items


@query
def p9_found(spark, d):
    return leakage.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p9_items(spark, d):
    """Per item: documents that hold it and the longest stretch among them; items that never leaked show 0."""
    items = table(spark, d, "eval_items").select("item_id", "lang", "task").distinct()
    hits = leakage.detect(table(spark, d, "documents"), table(spark, d, "eval_items"))
    per_item = hits.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"))
    return items.join(per_item, "item_id", "left").na.fill(0, ["n_docs", "longest"])


@query
def p9_spans(spark, d):
    """Where each leaked stretch stands and how much of its passage it covers."""
    return leakage.spans(table(spark, d, "documents"), table(spark, d, "eval_items")).withColumn("coverage", F.round("coverage", 6))


@query
def p9_cleaned(spark, d):
    """The whole corpus without leaked stretches."""
    return leakage.remove(table(spark, d, "documents"), table(spark, d, "eval_items"))


# 10: abusive content


@query
def p10_found(spark, d):
    return abuse.found(table(spark, d, "documents"), table(spark, d, "abuse_labels"))


@query
def p10_scores(spark, d):
    """Every document's score."""
    documents = table(spark, d, "documents")
    return abuse.score(documents, abuse.fit(documents, table(spark, d, "abuse_labels")))


@query
def p10_rates(spark, d):
    return abuse.rates(table(spark, d, "documents"), table(spark, d, "abuse_labels"))
