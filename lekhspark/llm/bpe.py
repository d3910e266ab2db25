"""Encoding of texts with a public byte-level BPE vocabulary.

A text is cut by the vocabulary's pre-tokenization rule, every piece becomes bytes, and
neighbours are merged lowest rank first, leftmost among equals. For a piece of n bytes a
segment tree over the byte positions holds at each leaf the rank of the pair that starts
there and at each inner node the least ``rank << 32 | position``, so the root names the
next merge. A merge changes the leaves of the merged token, of its live left neighbour and
of the swallowed one; each is a point update of O(log n), so a piece costs O(n log n)
however long it is.

Merges never cross pieces, so a worker keeps the ids of the pieces and space-led words it has
met (bounded by ``cache_entries``; the caches only save time and never change a result).

Defined cases: a null text and an empty text give the empty list; every other text, white
space included, is encoded as it is; texts that hold the spelling of a special token are
ordinary text. Repeated rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhspark.llm.arrow import WS_CLASS, Shared, sliced
from lekhspark.session import settle_names

#: Where the vocabulary files lie; a parameter of every function here.
DEFAULT_VOCAB = os.environ.get("LEKHSPARK_BPE_VOCAB", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the pre-tokenization rule that belongs to the vocabulary, white space spelled out.
PIECE_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{WS_CLASS}\p{{L}}\p{{N}}]+|[{WS_CLASS}]+(?![^{WS_CLASS}])|[{WS_CLASS}]+"
)

_NONE = (1 << 62) - 1


class BytePairEncoder:
    """Ranks by token bytes; the rank is the id."""

    def __init__(self, ranks: dict[bytes, int], cache_entries: int = 500_000):
        self.ranks = ranks
        self.pieces = regex.compile(PIECE_PATTERN)
        self.space_run = regex.compile(rf" [{WS_CLASS}]|[{WS_CLASS}] ")
        self.cache: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, list[int]] = {}
        self.cache_entries = cache_entries

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        n, ranks = len(piece), self.ranks
        if n == 1:
            return (ranks[piece],)
        token = [piece[i : i + 1] for i in range(n)]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        base = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * base)
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                tree[base + i] = r << 32 | i
        for v in range(base - 1, 0, -1):
            a, b = tree[2 * v], tree[2 * v + 1]
            tree[v] = a if a < b else b

        def put(i: int, key: int) -> None:
            v = base + i
            tree[v] = key
            v >>= 1
            while v:
                a, b = tree[2 * v], tree[2 * v + 1]
                low = a if a < b else b
                if tree[v] == low:
                    return
                tree[v] = low
                v >>= 1

        while tree[1] != _NONE:
            i = tree[1] & 0xFFFFFFFF
            j = nxt[i]
            token[i] += token[j]
            token[j] = b""
            put(j, _NONE)
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                r = ranks.get(token[i] + token[k])
                put(i, _NONE if r is None else r << 32 | i)
            else:
                put(i, _NONE)
            h = prv[i]
            if h >= 0:
                r = ranks.get(token[h] + token[i])
                put(h, _NONE if r is None else r << 32 | h)
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i]])
            i = nxt[i]
        return tuple(out)

    def _encode_span(self, span: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces.findall(span):
            ids = self.cache.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode())
                if len(piece) <= 256:
                    if len(self.cache) >= self.cache_entries:
                        self.cache.clear()
                    self.cache[piece] = ids
            out += ids
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.space_run.search(text):
            return self._encode_span(text)
        # A single space before a visible character always starts a piece, so words encode on their own.
        words = self.words
        head, *rest = text.split(" ")
        out = self._encode_span(head) if head else []
        for w in rest:
            ids = words.get(w)
            if ids is None:
                ids = self._encode_span(" " + w)
                if len(w) <= 64:
                    if len(words) >= self.cache_entries:
                        words.clear()
                    words[w] = ids
            out += ids
        return out


def load_encoder(raw: bytes) -> BytePairEncoder:
    """From a file of lines ``base64(token) rank``; it must hold all 256 single bytes."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    return BytePairEncoder(ranks)


def encode_corpus(df: DataFrame, vocab_path: str = DEFAULT_VOCAB, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids array<int>``, one row per row of ``df``; a map without any shuffle.

    The vocabulary (under 1 MB, fixed) is read by the driver and broadcast.
    """
    with open(vocab_path, "rb") as f:
        shared = Shared(df.sparkSession, load_encoder, f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.get()
        for b in sliced(batches, "text"):
            flat: list[int] = []
            ends = np.zeros(b.num_rows + 1, np.int32)
            for i, t in enumerate(b.column(1).to_pylist(), 1):
                flat += enc.encode(t)
                ends[i] = len(flat)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["id", "ids"])

    df = settle_names(df, (id_col, text_col))
    kind = df.schema[id_col].dataType.simpleString()
    return (
        df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(run, f"id {kind}, ids array<int>")
        .withColumnRenamed("id", id_col)
    )
