"""Command lines over the tables of a pipeline: hybrid, lexical and semantic search, and the canonical form of one query. Each prints JSON.

The tables' folder is given by ``--root`` or the environment variable LEKHSPARK_ROOT.
"""

from __future__ import annotations

import argparse
import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lekhspark.operators import lexical, vectors
from lekhspark.plans import hybrid


def _hybrid(spark: SparkSession, a: argparse.Namespace, corpus: hybrid.Corpus, embed) -> dict:
    return hybrid.search_one(spark, a.query, corpus, hybrid.Settings(now_ts=a.now or int(time.time())), embed, a.filter_by, a.page, a.per_page, a.explain)


def _one(spark: SparkSession, query: str):
    if not query.strip():
        raise ValueError("Empty query")
    return hybrid.canonical_queries(spark.createDataFrame([(1, query)], "query_id bigint, query string"))


def _lexical(spark: SparkSession, a: argparse.Namespace, corpus: hybrid.Corpus, embed) -> dict:
    """All matches counted, one page of them with their titles."""
    q = _one(spark, a.query).select("query_id", F.col("query_used").alias("query"), "mode").withColumn("filter_by", F.lit(a.filter_by).cast("string"))
    rows = lexical.search_page(q, corpus.docs, a.per_page, a.page, a.sort_by, posts=corpus.postings, vocabulary=corpus.vocabulary)
    hits = rows.join(corpus.docs.select("id", "title_hi", "url").distinct(), "id", "left").orderBy("place").collect()  # one page
    return {"mode": q.first()["mode"], "found": hits[0]["found"] if hits else 0, "page": a.page, "hits": [{k: r[k] for k in ("id", "title_hi", "url", "lexical_score", "place")} for r in hits]}


def _semantic(spark: SparkSession, a: argparse.Namespace, corpus: hybrid.Corpus, embed) -> dict:
    q = spark.createDataFrame([(1, a.query)], "query_id bigint, query string")
    hits = hybrid.semantic_chunks(q, corpus.chunk_vectors, corpus.chunks, embed, a.per_page).orderBy("rank").collect()
    return {"hits": [{k: r[k] for k in ("rank", "chunk_id", "article_id", "score", "snippet")} for r in hits]}


def _canonical(spark: SparkSession, a: argparse.Namespace, corpus: None, embed) -> dict:
    return _one(spark, a.query).select(F.col("query").alias("raw"), "mode", F.col("query_used").alias("q"), "query_semantic").first().asDict()


COMMANDS = {"search": _hybrid, "lexical": _lexical, "semantic": _semantic, "canonical": _canonical}


def main(argv: list[str] | None = None, spark: SparkSession | None = None, embed=None) -> dict:
    p = argparse.ArgumentParser(prog="lekhspark", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--query", required=True)
    p.add_argument("--root", default=os.environ.get("LEKHSPARK_ROOT", "."))
    p.add_argument("--filter-by")
    p.add_argument("--sort-by", help="field:asc or field:desc, for lexical")
    p.add_argument("--page", type=int, default=1)
    p.add_argument("--per-page", type=int, default=10)
    p.add_argument("--explain", action="store_true")
    p.add_argument("--now", type=int, help="the moment ages are measured from, in seconds")
    p.add_argument("--report", help="a file the answer is written to as well")
    a = p.parse_args(argv)
    if spark is None:
        from lekhspark.session import build_session

        spark = build_session()
    corpus = None if a.command == "canonical" else hybrid.open_corpus(spark, hybrid.Layout(a.root))
    body = COMMANDS[a.command](spark, a, corpus, embed or vectors.hashing_embedding())
    shown = json.dumps(body, ensure_ascii=False, indent=2, default=lambda x: x.asDict(recursive=True) if hasattr(x, "asDict") else str(x))
    if a.report:
        Path(a.report).parent.mkdir(parents=True, exist_ok=True)
        Path(a.report).write_text(shown, encoding="utf-8")
    print(shown)
    return body


if __name__ == "__main__":
    main()
