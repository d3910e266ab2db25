"""Hybrid search of a table of requests in one plan, and the batch pipeline from raw export to searchable tables.

``requests``: query_id, query, and optionally filter_by, page, per_page, explain. Blank queries are left out (``search_one`` refuses them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhspark.functions import text, unicode
from lekhspark.operators import canonical, chunking, gazetteer, lexical, ranking, vectors
from lekhspark.session import broadcast_if_small, cut_lineage, one_per_key


@dataclass(frozen=True)
class Corpus:
    """The tables a search needs; ``postings`` are those of the index rows in ``docs``, ``vocabulary`` their tokens with counts. Without them the texts of ``docs`` are read."""

    docs: DataFrame
    postings: DataFrame | None
    vocabulary: DataFrame | None
    metadata: DataFrame
    article_vectors: DataFrame
    chunk_vectors: DataFrame
    chunks: DataFrame
    gazetteer: DataFrame
    article_index: vectors.VectorIndex | None = None
    chunk_index: vectors.VectorIndex | None = None
    #: Whether ``docs`` are as ``canonical.index_documents`` made them (see ``lexical.search``).
    joined: bool = False


@dataclass(frozen=True)
class Settings:
    """Sizes of the legs; ``now_ts`` is a parameter so that results repeat."""

    now_ts: int
    lexical_k: int = lexical.TOP_K
    article_k: int = 40
    chunk_k: int = 80
    cap: int = ranking.CANDIDATE_CAP
    filter_semantic: bool = False
    ascii_typos: bool = False
    #: Cells of the vector indexes that each query visits; 0 compares all vectors.
    probes: int = 0


def canonical_queries(requests: DataFrame, compose: bool = True) -> DataFrame:
    """Adds ``mode, query_used, query_semantic``; request columns that are missing get their defaults."""
    for name, kind, default in (("filter_by", "string", None), ("page", "int", 1), ("per_page", "int", 10), ("explain", "boolean", False)):
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(default).cast(kind))
    raw = F.col("query")
    dev = F.coalesce(text.normal_text(unicode.repaired_nfkc(raw) if compose else raw), raw)
    used = F.when(F.col("mode") == "roman", text.roman_index(raw)).otherwise(dev)
    out = requests.where(~text.is_nullish(raw)).withColumn("mode", text.query_mode(raw))
    return out.withColumn("query_used", used).withColumn("query_semantic", text.trim_all(raw))


def with_filters(queries: DataFrame, gaz: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries with ``filter_by_auto, filter_by_final`` and ``entity_conf``, and the matches they come from."""
    matches = gazetteer.detect(queries, gaz, "query_used", "mode")
    conf = gazetteer.confidence(matches)
    auto = gazetteer.auto_filter(conf).withColumnRenamed("filter_by", "filter_by_auto")
    maps = conf.groupBy("query", "mode").agg(F.map_from_entries(F.collect_list(F.struct("field", "confidence"))).alias("entity_conf"))
    keys = lambda d: d.withColumnsRenamed({"query": "query_used"})
    q = queries.join(keys(auto), ["query_used", "mode"], "left").join(keys(maps), ["query_used", "mode"], "left")
    final = F.when(F.col("filter_by").isNotNull() & F.col("filter_by_auto").isNotNull(), F.concat(F.lit("("), "filter_by", F.lit(") && ("), "filter_by_auto", F.lit(")")))
    return q.withColumn("filter_by_final", F.coalesce(final, "filter_by", "filter_by_auto")), matches


def search(requests: DataFrame, corpus: Corpus, settings: Settings, query_vectors: DataFrame | None = None, embed=None) -> dict[str, DataFrame]:
    """``queries, ranked, page, counts``. Vectors of the queries come from ``query_vectors`` (query_id, vector) or from ``embed`` of the raw query."""
    # Equal requests are worked on once, by the smallest id among them, unless each brings its own vector.
    alike = F.col("query_id").cast("string") if query_vectors is not None else F.md5(F.to_json(F.struct("query", "filter_by", "page", "per_page", "explain")))
    every = canonical_queries(requests).withColumn("_alike", alike)
    every = cut_lineage(every.join(every.groupBy("_alike").agg(F.min("query_id").alias("_lead")), "_alike").drop("_alike"))
    q, _ = with_filters(every.where(F.col("query_id") == F.col("_lead")), corpus.gazetteer)
    q = cut_lineage(q.drop("_lead"))  # requests are few; every leg starts from them
    same = broadcast_if_small(every.select("query_id", "_lead"))
    expanded = lambda d: d.withColumnRenamed("query_id", "_lead").join(same, "_lead").select(*d.columns)
    asked = q.select("query_id", F.col("query_used").alias("query"), "mode")
    flagged = q.select("query_id", F.col("query_used").alias("query"), "mode", F.col("filter_by_final").alias("filter_by"))
    lex = cut_lineage(lexical.search(flagged, corpus.docs, settings.lexical_k, ascii_only=settings.ascii_typos, posts=corpus.postings, vocabulary=corpus.vocabulary, joined=corpus.joined))
    if query_vectors is None:
        query_vectors = q.select("query_id", embed(text.prefixed(F.col("query_semantic"), "query")).alias("vector"))
    by_article, by_chunk = corpus.article_vectors, corpus.chunk_vectors.where(F.col("article_id").isNotNull())
    if settings.probes:
        if corpus.article_index is None or corpus.chunk_index is None:
            raise ValueError("the corpus has no vector indexes")
        by_article, by_chunk = corpus.article_index, vectors.VectorIndex(corpus.chunk_index.rows.where(F.col("article_id").isNotNull()), corpus.chunk_index.marks)
    art = vectors.top_k(query_vectors, by_article, settings.article_k, "id", probes=settings.probes or 1)
    chk = vectors.top_k(query_vectors, by_chunk, settings.chunk_k, "chunk_id", payload=("article_id",), probes=settings.probes or 1)
    if settings.filter_semantic:
        filters = q.select("query_id", F.col("filter_by_final").alias("filter_by"))
        art = lexical.passing(filters, art, corpus.docs)
        chk = lexical.passing(filters, chk.withColumnRenamed("article_id", "id"), corpus.docs).withColumnRenamed("id", "article_id")
    candidates = cut_lineage(ranking.fuse(lex, art, chk, settings.cap))
    # What the ranker doesn't read is joined to what is shown only.
    settled = ranking.settled_metadata(candidates, corpus.metadata)
    ranked = ranking.rank(ranking.joined_metadata(candidates, settled.select("article_id", *ranking.RANKED_BY)), asked, settings.now_ts, q.select("query_id", "entity_conf")).drop(*ranking.RANKED_BY)
    described = lambda d: ranking.joined_metadata(expanded(d), settled).select(*candidates.columns, *[c for c in settled.columns if c != "article_id"], *[c for c in d.columns if c not in candidates.columns])
    shown = ranking.with_snippets(ranking.page(ranked, q.select("query_id", "page", "per_page")), corpus.chunks)
    explain = q.select("query_id", "explain")
    shown = shown.join(explain, "query_id").withColumns({c: F.when(F.col("explain"), F.col(c)) for c in ("features", "explanation")}).drop("explain")
    found = q.select(F.col("query_id").alias("_lead"), "filter_by_auto", "entity_conf", "filter_by_final")
    queries = every.join(found, "_lead").select(*q.columns)
    return {"queries": queries, "ranked": described(ranked), "page": described(shown), "counts": expanded(ranking.leg_counts(lex, art, chk, candidates))}


def semantic_chunks(requests: DataFrame, chunk_vectors: DataFrame | vectors.VectorIndex, chunks: DataFrame, embed, k: int = 10, chars: int = 350) -> DataFrame:
    """``query_id, chunk_id, article_id, score, rank, snippet``: the chunks nearest to each canonical query, with the beginning of their text as it is (blank where the text is missing)."""
    q = canonical_queries(requests)
    asked = q.select("query_id", embed(text.prefixed(F.col("query_used"), "query")).alias("vector"))
    if isinstance(chunk_vectors, DataFrame):
        chunk_vectors = chunk_vectors.where(F.col("article_id").isNotNull())
    hits = cut_lineage(vectors.top_k(asked, chunk_vectors, k, "chunk_id", payload=("article_id",)))
    wanted = broadcast_if_small(hits.select("chunk_id").distinct())
    texts = one_per_key(chunks.select("chunk_id", "chunk_text").join(wanted, "chunk_id", "left_semi"), "chunk_id")
    return hits.join(texts, "chunk_id", "left").withColumn("snippet", F.coalesce(F.substring("chunk_text", 1, chars), F.lit(""))).drop("chunk_text")


def search_one(spark: SparkSession, query: str, corpus: Corpus, settings: Settings, embed, filter_by: str | None = None, page: int = 1, per_page: int = 10, explain: bool = False) -> dict:
    """One request as a dict with its hits; a blank query is refused."""
    if not query or not query.strip():
        raise ValueError("Empty query")
    request = spark.createDataFrame([(1, query, filter_by, page, per_page, explain)], "query_id bigint, query string, filter_by string, page int, per_page int, explain boolean")
    out = search(request, corpus, settings, embed=embed)
    q = out["queries"].select("mode", "query_used", "query_semantic").first()
    hits = [r.asDict(recursive=True) for r in out["page"].orderBy("rank").collect()]  # one page
    head = hits[0] if hits else {"total_results": 0, "total_pages": 1, "page": 1}
    return {"query_id": 1, **q.asDict(), "total_results": head["total_results"], "total_pages": head["total_pages"], "page": head["page"], "per_page": max(1, per_page), "results": hits}


def health() -> dict:
    return {"ok": True, "ranker_version": ranking.RANKER, "retrieval_version": ranking.RETRIEVAL}


@dataclass(frozen=True)
class Layout:
    """Where the pipeline keeps its tables."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}.parquet"


#: Stages in order with what each needs.
STAGES = ("canonical", "gazetteer", "index_documents", "postings", "vocabulary", "chunks", "article_vectors", "chunk_vectors", "article_index", "chunk_index")


def open_corpus(spark: SparkSession, layout: Layout) -> Corpus:
    """The tables a pipeline has written; a missing one is Spark's error."""
    read = lambda name: spark.read.parquet(layout.path(name))
    return Corpus(read("index_documents"), read("postings"), read("vocabulary"), ranking.article_metadata(read("canonical")), read("article_vectors"), read("chunk_vectors"), read("chunks"), read("gazetteer"))


def run_pipeline(spark: SparkSession, raw: DataFrame, layout: Layout, embed=None, rebuild: bool = False, index: bool = False) -> Corpus:
    """Raw export to searchable tables, with vector indexes if ``index``; a stage whose table exists is skipped unless ``rebuild``."""
    embed = embed or vectors.hashing_embedding()

    def exists(path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def stage(name: str, build) -> DataFrame:
        path = layout.path(name)
        if rebuild or not exists(path):
            build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    # Every stage reads what the stages before it have stored.
    canon = stage("canonical", lambda: canonical.canonical(raw))
    gaz = stage("gazetteer", lambda: gazetteer.build(canon))
    docs = stage("index_documents", lambda: canonical.index_documents(canon))
    posts = stage("postings", lambda: lexical.postings(docs, lexical.ALL_FIELDS))
    words = stage("vocabulary", lambda: lexical.token_statistics(posts))
    chunks = stage("chunks", lambda: chunking.chunk_articles(canon))
    art = stage("article_vectors", lambda: vectors.embed_articles(canon, embed))
    chk = stage("chunk_vectors", lambda: vectors.embed_chunks(chunks, embed))
    indexes = []
    for name, table, key in (("article_index", art, "id"), ("chunk_index", chk, "chunk_id")) if index else ():
        if rebuild or not exists(f"{layout.path(name)}/marks"):
            vectors.build_index(table, key).write(layout.path(name), key)
        indexes.append(vectors.read_index(spark, layout.path(name)))
    return Corpus(docs, posts, words, ranking.article_metadata(canon), art, chk, chunks, gaz, *indexes)
