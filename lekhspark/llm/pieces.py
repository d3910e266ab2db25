"""Cutting oversized items into pieces at natural boundaries.

Sizes count tokens (runs of non-white-space) and code points. Sentences are the atomic
segments; one that cannot fit alone is cut between words, and a single word longer than a
piece between grapheme-like clusters. Adjacent segments sit in a heap ordered by the
strength of the boundary between them (inside a word < between words < sentence < line <
paragraph), then by combined size, then by position; the weakest boundary is merged first
as long as the combined segment and the overlap before it fit. So the boundaries that stay
are the strongest ones the limits allow.

A piece is the ``overlap`` tokens before its segment plus the segment, taken as one
stretch of the original text: joining ``piece_text`` from ``new_from`` on gives the text
back, but for white space around it. The first segment is grown to at least ``overlap``
tokens, so later pieces share exactly that many. Only where the overlap would take more
than half of ``max_chars`` it is shortened.

Defined cases: null and blank texts give one piece, unchanged, with 0 tokens; texts within
the limits give one piece; a text that is over a limit only by the white space around it gives one
piece without that, and is marked ``oversized`` like every other text over a limit; ids may be null or repeat
(rows are handled one by one); other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhspark.llm.arrow import JAVA_WS, WS_CLASS
from lekhspark.session import settle_names

MAX_TOKENS, MAX_CHARS, OVERLAP = 384, 3000, 40
_TOKEN = re.compile(f"[^{WS_CLASS}]+")
_SENTENCE_END = re.compile(r"[।॥.!?۔؟…]+[\"'”’»)\]]*$")
INSIDE_WORD, WORD, SENTENCE, LINE, PARAGRAPH = range(5)

PIECE_SCHEMA = "piece_index int, n_pieces int, piece_text string, piece_tokens int, from_char int, new_from int, to_char int, oversized boolean"


class Piece(NamedTuple):
    start: int
    new_from: int
    end: int
    tokens: int


def _cluster_cut(text: str, at: int, low: int) -> int:
    """The last place not after ``at`` where no combining mark or joiner would be parted."""
    for i in range(at, low, -1):
        if unicodedata.category(text[i])[0] != "M" and text[i] not in "‌‍" and text[i - 1] not in "‍्্":
            return i
    return at


def split_text(text: str, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[Piece]:
    if not 0 <= overlap < max_tokens or max_chars < 4:
        raise ValueError("the overlap must be smaller than the limit")
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if len(spans) <= max_tokens and len(text) <= max_chars:
        return [Piece(0, 0, len(text), len(spans))]
    if not spans:  # white space only, longer than the limit
        return [Piece(i, i, min(i + max_chars, len(text)), 0) for i in range(0, len(text), max_chars)]
    begin, end, after = [], [], []  # of each unit: its place, and the boundary behind it
    unit = max(2, max_chars // 2)
    for k, (a, b) in enumerate(spans):
        while b - a > unit:
            cut = _cluster_cut(text, a + unit, a + 1)
            begin.append(a), end.append(cut), after.append(INSIDE_WORD)
            a = cut
        begin.append(a), end.append(b)
        if k + 1 == len(spans):
            after.append(PARAGRAPH)
            continue
        breaks = text.count("\n", b, spans[k + 1][0]) if text[b] != " " or spans[k + 1][0] > b + 1 else 0
        if breaks:
            after.append(PARAGRAPH if breaks > 1 else LINE)
        else:
            after.append(SENTENCE if not text[b - 1].isalnum() and _SENTENCE_END.search(text[max(a, b - 8) : b]) else WORD)
    n = len(begin)

    first, o = [], 0  # of each unit: where the overlap before a segment that starts there begins
    for s in range(n):
        room = begin[s] - unit
        o = max(o, s - overlap)
        while begin[o] < room:
            o += 1
        first.append(o)

    def fits(s: int, e: int) -> bool:
        return e - first[s] <= max_tokens and end[e - 1] - begin[first[s]] <= max_chars

    starts, s = [0], 0  # atoms: sentences, or parts of those that don't fit
    for i in range(1, n):
        grow_first = s == 0 and i < overlap and fits(0, i + 1)
        if after[i - 1] >= SENTENCE and not grow_first or not fits(s, i + 1):
            starts.append(i)
            s = i
    nxt = {a: b for a, b in zip(starts, [*starts[1:], n])}
    prv = {b: a for a, b in nxt.items()}
    heap = [(after[m - 1], nxt[m] - a, a, m) for a, m in nxt.items() if m < n]
    heapq.heapify(heap)
    while heap:
        _, size, a, m = heapq.heappop(heap)
        if nxt.get(a) != m or m not in nxt or nxt[m] - a != size:
            continue  # one of the two has grown since
        e = nxt[m]
        if not fits(a, e):
            continue  # segments only grow, so it never will
        nxt[a] = e
        del nxt[m]
        prv[e] = a
        if e < n:
            heapq.heappush(heap, (after[e - 1], nxt[e] - a, a, e))
        if a > 0:
            p = prv[a]
            heapq.heappush(heap, (after[a - 1], e - p, p, a))
    return [
        Piece(begin[first[a]], begin[a], end[nxt[a] - 1], nxt[a] - first[a])
        for a in sorted(nxt)
    ]


def oversized(text: Column, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS) -> Column:
    """Whether a text is over a limit, in the JVM; a token takes two characters or more, so short texts aren't counted."""
    tokens = F.regexp_count(text, F.lit(JAVA_WS.replace("[", "[^", 1) + "+"))
    return (F.length(text) > max_chars) | ((F.length(text) >= 2 * max_tokens + 1) & (tokens > max_tokens))


def split_items(df: DataFrame, id_col: str, text_col: str, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """``id_col`` and PIECE_SCHEMA, one row per piece, in a map without any shuffle.

    Items within the limits stay in the JVM; only oversized texts go to Python.
    """
    df = settle_names(df, (id_col, text_col))
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    over = F.coalesce(oversized(F.col("text"), max_tokens, max_chars), F.lit(False))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for item, text in zip(f["item"], f["text"]):
                pieces = split_text(text, max_tokens, max_chars, overlap)
                out += [(item, i, len(pieces), text[p.start : p.end], p.tokens, p.start, p.new_from, p.end, True) for i, p in enumerate(pieces)]
            yield pd.DataFrame(out, columns=["item", *(c.split()[0] for c in PIECE_SCHEMA.split(", "))])

    cut = rows.where(over).mapInPandas(run, f"item {kind}, {PIECE_SCHEMA}")
    length = F.coalesce(F.length("text"), F.lit(0))
    whole = rows.where(~over).select(
        "item", F.lit(0).alias("piece_index"), F.lit(1).alias("n_pieces"), F.col("text").alias("piece_text"),
        F.coalesce(F.regexp_count("text", F.lit(JAVA_WS.replace("[", "[^", 1) + "+")), F.lit(0)).alias("piece_tokens"),
        F.lit(0).alias("from_char"), F.lit(0).alias("new_from"), length.alias("to_char"), F.lit(False).alias("oversized"),
    )
    return whole.unionByName(cut).withColumnRenamed("item", id_col)


def found(chunks: DataFrame, articles: DataFrame) -> DataFrame:
    """Items that the splitter took as oversized: ``kind``, ``item_id``, each once."""
    parts = [
        split_items(df, key, text).where(F.col("oversized") & (F.col("piece_index") == 0)).select(F.lit(kind).alias("kind"), F.col(key).alias("item_id"))
        for kind, df, key, text in (("chunk", chunks, "chunk_id", "chunk_text"), ("article", articles, "id", "content_hi"))
    ]
    return parts[0].unionByName(parts[1]).distinct()
