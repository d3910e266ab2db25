"""Articles into chunks of bounded size, as expressions of the JVM.

Paragraphs are packed greedily up to ``max_tokens``; a larger paragraph is split at sentence separators, and a part still
too large is cut into windows of ``hard_max`` tokens that overlap. A context chunk (title, summary, first two
paragraphs; first window only) comes first. No chunk exceeds ``hard_max``.

Defined cases: blank articles give no chunk; a null title or summary is left out; repeated articles give repeated chunks;
an overlap that isn't smaller than ``hard_max`` is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhspark.functions import text

MAX_TOKENS, OVERLAP, HARD_MAX, MODEL_LIMIT = 200, 40, 384, 512


def check_sizes(max_tokens: int, overlap: int, hard_max: int) -> None:
    if hard_max > MODEL_LIMIT:
        raise ValueError(f"hard_max must not exceed {MODEL_LIMIT}")
    if max_tokens > hard_max:
        raise ValueError("max_tokens must not exceed hard_max")
    if max(1, overlap) >= hard_max:
        raise ValueError("the overlap must be smaller than hard_max")


def windows(c: Column, hard_max: int = HARD_MAX, overlap: int = OVERLAP, tokenizer: text.Tokenizer = text.WORDS) -> Column:
    """The text itself if it fits (blank: nothing), else windows of ``hard_max`` tokens, each starting ``hard_max - max(1, overlap)`` after the last."""
    step = hard_max - max(1, overlap)
    w = tokenizer.tokens(c)
    n = F.size(w)
    t = text.trim_all(F.coalesce(c, F.lit("")))
    cut = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda i: tokenizer.join(F.slice(w, i + 1, F.lit(hard_max))))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= hard_max, F.array(t)).otherwise(cut)


def window_bounds(n: Column, hard_max: int = HARD_MAX, overlap: int = OVERLAP) -> Column:
    """Start and end of every window over ``n`` tokens; tails inside the window before are kept."""
    step = hard_max - max(1, overlap)
    one = F.array(F.struct(F.lit(0).alias("start"), n.cast("int").alias("end")))
    many = F.transform(F.sequence(F.lit(0), n.cast("int") - 1, F.lit(step)), lambda i: F.struct(i.alias("start"), F.least(i + hard_max, n.cast("int")).alias("end")))
    return F.when(n <= 0, F.array().cast("array<struct<start:int,end:int>>")).when(n <= hard_max, one).otherwise(many)


def pack(paras: Column, max_tokens: int = MAX_TOKENS, hard_max: int = HARD_MAX, overlap: int = OVERLAP, tokenizer: text.Tokenizer = text.WORDS) -> Column:
    """Chunks from an array of paragraphs: one fold over it, carrying the closed chunks and the open group."""
    strings = "array<string>"
    sized = F.transform(paras, lambda p: F.struct(p.alias("p"), tokenizer.count(p).alias("n")))
    parted = F.transform(
        sized,
        lambda x: F.struct(
            x["p"].alias("p"), x["n"].alias("n"),
            F.when(x["n"] > max_tokens, F.flatten(F.transform(text.sentence_parts(x["p"]), lambda s: F.when(tokenizer.count(s) <= max_tokens, F.array(s)).otherwise(windows(s, hard_max, overlap, tokenizer))))).alias("parts"),
        ),
    )
    start = F.struct(F.array().cast(strings).alias("done"), F.array().cast(strings).alias("open"), F.lit(0).alias("n"))
    closed = lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["open"], "\n\n")))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        own = F.struct(F.concat(closed(acc), F.coalesce(x["parts"], F.array().cast(strings))).alias("done"), F.array().cast(strings).alias("open"), F.lit(0).alias("n"))
        joined = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(x["p"])).alias("open"), (acc["n"] + x["n"]).alias("n"))
        fresh = F.struct(closed(acc).alias("done"), F.array(x["p"]).alias("open"), x["n"].alias("n"))
        return F.when(x["n"] > max_tokens, own).when(acc["n"] + x["n"] <= max_tokens, joined).otherwise(fresh)

    packed = F.aggregate(parted, start, step, closed)
    return F.filter(F.flatten(F.transform(packed, lambda c: windows(c, hard_max, overlap, tokenizer))), lambda c: c != "")


def context_text(title: Column, summary: Column, content: Column) -> Column:
    """Title, summary and the first two paragraphs."""
    lead = F.array_join(F.slice(text.paragraphs(content), 1, 2), "\n\n")
    return text.join_non_blank(title, summary, lead)


def chunk_articles(articles: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, hard_max: int = HARD_MAX, tokenizer: text.Tokenizer = text.WORDS) -> DataFrame:
    """The chunk table: ``chunk_id, article_id, chunk_index, chunk_text, chunk_tokens`` and the article's payload.

    A chunk of more than ``hard_max`` tokens, which only a tokenizer that doesn't count its own pieces alike could give, fails the job.
    """
    check_sizes(max_tokens, overlap, hard_max)
    paras = text.paragraphs(text.join_non_blank(F.col("title_hi"), F.col("summary_hi"), F.col("content_hi")))
    context = windows(context_text(F.col("title_hi"), F.col("summary_hi"), F.col("content_hi")), hard_max, overlap, tokenizer)
    chunks = F.concat(F.slice(context, 1, 1), pack(paras, max_tokens, hard_max, overlap, tokenizer))
    rows = articles.select("id", "url", "published_date", "published_ts", "title_hi", chunks.alias("_chunks")).select(
        F.col("id").cast("string").alias("article_id"), "url", "published_date", F.coalesce("published_ts", F.lit(0)).alias("published_ts"),
        F.coalesce("title_hi", F.lit("")).alias("title_hi"), F.posexplode("_chunks").alias("chunk_index", "chunk_text"),
    )
    return rows.select(
        text.chunk_id(F.col("article_id"), F.col("chunk_index")).alias("chunk_id"), "article_id", "chunk_index", "chunk_text",
        capped(tokenizer.count(F.col("chunk_text")), hard_max).alias("chunk_tokens"), "url", "published_date", "published_ts", "title_hi",
    )


def capped(n: Column, hard_max: int = HARD_MAX) -> Column:
    """The number of tokens, which fails above ``hard_max``."""
    return F.when(n <= hard_max, n).otherwise(F.raise_error(F.concat(F.lit(f"a chunk of more than {hard_max} tokens: "), n.cast("string"))).cast("int"))


def chunk_report(articles: DataFrame, chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row: articles, empty ones, chunks, chunks over the soft limit, the largest."""
    a = articles.agg(F.count("*").alias("n_articles"), F.count_if(text.is_nullish(F.col("content_hi"))).alias("n_empty_content"))
    c = chunks.agg(F.count("*").alias("n_chunks"), F.count_if(F.col("chunk_tokens") > max_tokens).alias("n_over_soft_max"), F.max("chunk_tokens").alias("max_tokens_seen"))
    return a.join(c, F.lit(True))
