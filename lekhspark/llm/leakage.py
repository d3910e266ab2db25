"""Evaluation passages that leak, whole or in part, into a corpus.

The passages, normalised to words, make one generalised suffix automaton (a few thousand
states; the items are a bounded table and the automaton is broadcast). Every text streams
through it: after each word the automaton holds the longest stretch that ends there and occurs
in some passage, and its suffix links hold the shorter ones of other passages. The maximal stretches
of ``seed_words`` words or more of each item are its seeds, whatever other items hold.

A leak may have one word in eight replaced, left out or added, so seeds of one item that follow
one another in passage and text are then chained with all shorter matches between them: the
longest stretch of the passage whose edits stay within the allowance decides, and it must be
``min_words`` passage words long. A stretch of 20 words with two edits always holds a matching
run of six words (three edits are allowed from 24 on, which leaves six as well), so no leak is
without a seed of ``seed_words = 6``.

``spans`` gives the places of the leaked stretches in the text and how much of the passage each covers;
``remove`` takes those beyond a length or a coverage out of the text.

Normal form of both sides: markup and character references undone, NFKC, lower case, invisible
characters removed, and only letters, marks and digits kept, as words.

Items are worked on in blocks of about ``max_items`` (one automaton is broadcast at a time), so their number isn't limited.

Defined cases: null and empty texts and passages hold nothing; passages shorter than
``min_words`` never leak; a document that repeats a passage gives one row of ``detect`` and one of ``spans`` for each
place; two items of the same passage both leak; repeated rows give each case once (in ``spans`` and ``remove``
each row of the documents is a row of its own).
"""

from __future__ import annotations

import html
import json
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhspark.llm.arrow import Shared
from lekhspark.session import settle_names

MIN_WORDS, SEED_WORDS, MAX_ITEMS = 20, 6, 100_000
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
_LT, _GT = r"&(?:lt|LT|#0*60|#[xX]0*3[cC]);", r"&(?:gt|GT|#0*62|#[xX]0*3[eE]);"
_ESCAPED_TAG = re.compile(rf"{_LT}(?:!--.*?--|/?[a-zA-Z](?:(?!{_LT}|{_GT})[^<>])*){_GT}", re.S)
_INVISIBLE = re.compile("[\xad͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")
_WORD = re.compile(r"[^\W_]+(?:[̀-ͯऀ-ःऺ-ॏ॑-ॗॢॣঁ-ঃ়-ৌ্ৗًؐ-ؚ-ٰٟ]+[^\W_]*)*")


def without_markup(text: str) -> str:
    """The text with every tag, written out or escaped, as spaces: places stay where they are."""
    if "<" in text:
        text = _TAG.sub(lambda m: " " * len(m[0]), text)
    if "&" in text:
        text = _ESCAPED_TAG.sub(lambda m: " " * len(m[0]), text)
    return text


def normal_words(text: str) -> list[str]:
    """The words two texts are compared by."""
    text = without_markup(text)
    if "&" in text:
        text = html.unescape(text)
        if "<" in text:
            text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.lower())


class SuffixAutomaton:
    """Generalised over several word sequences; every state knows the items its stretches occur in and all their ends."""

    def __init__(self, items: list[tuple[int, list[int]]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[dict[int, list[int]]] = [{}]  # item -> places after its last word
        self.items = dict(items)
        for number, seq in items:
            last = 0
            for at, w in enumerate(seq, 1):
                last = self._extend(last, w)
                self.ends[last].setdefault(number, []).append(at)
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if (up := self.link[s]) > 0:
                for number, places in self.ends[s].items():
                    self.ends[up].setdefault(number, []).extend(places)
        self.final = [any(len(self.items[number]) in places for number, places in e.items()) for e in self.ends]

    def _new(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.link) - 1

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return cur

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def seeds(self, seq: list[int], least: int) -> list[tuple[int, int, int, int]]:
        """Maximal stretches of ``least`` words or more of every item: item, end in the passage, end in the text, length.

        After each word, all places where some stretch of the items ends that ends here too lie in the state and along its suffix
        links, each at its longest in the first state that has it; a stretch is over where passage and text go on differently.
        """
        nxt, link, length, items = self.next, self.link, self.length, self.items
        out = []
        state = size = 0

        def flush(end: int) -> None:
            after = seq[end] if end < len(seq) else -1
            seen: set[tuple[int, int]] = set()
            s, n = state, size
            while n >= least:
                up = link[s]
                more = length[up] >= least
                # Most often every place goes on as the text does; then none of them is over.
                if more or len(nxt[s]) != 1 or after not in nxt[s] or self.final[s]:
                    for number, places in self.ends[s].items():
                        passage = items[number]
                        for p in places:
                            if (number, p) not in seen:
                                if more:
                                    seen.add((number, p))
                                if p == len(passage) or passage[p] != after:
                                    out.append((number, p, end, n))
                s, n = up, length[up]

        root = nxt[0]
        for i, w in enumerate(seq):
            if not state and w not in root:
                continue
            while state >= 0 and w not in nxt[state]:
                state = link[state]
                if state >= 0:
                    size = length[state]
            if state < 0:
                state = size = 0
            else:
                state, size = nxt[state][w], size + 1
                if size >= least:
                    flush(i + 1)
        return out


def leak_spans(passage: list[int], text: list[int], seeds: list[tuple[int, int, int]], min_words: int = MIN_WORDS, one_in: int = 8) -> list[tuple[int, int, int]]:
    """Places ``from, to`` in the text, with the passage words covered, of the longest stretch through each seed that the text holds
    with at most one edit in ``one_in``; those of fewer than ``min_words`` words are left out.

    ``seeds``: end in the passage, end in the text, length. Only alignments through a seed are sought, in a
    band around its diagonal that is as wide as the edits a whole passage allows.
    """
    n, out = len(passage), []
    band = n // one_in + 1
    done: set[tuple[int, int]] = set()
    for p_end, t_end, size in seeds:
        if (p_end - t_end, p_end) in done:
            continue
        done.add((p_end - t_end, p_end))
        p0, t0 = p_end - size, t_end - size
        # Best ways left and right of the seed, by number of edits: how far the passage is covered at the last match.
        right = _reach(passage[p_end:], text[t_end : t_end + n - p_end + band], band)
        left = _reach(passage[:p0][::-1], text[max(0, t0 - p0 - band) : t0][::-1], band)
        best = None
        for a, (x, tx) in enumerate(right):
            for b, (y, ty) in enumerate(left):
                covered = size + x + y
                if covered >= min_words and (a + b) * one_in <= covered and (best is None or covered > best[2]):
                    best = t0 - ty, t_end + tx, covered
        if best:
            out.append(best)
    return out


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that overlap as one, with the larger number of words."""
    out: list[tuple[int, int, int]] = []
    for a, b, n in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1]), max(n, out[-1][2])
        else:
            out.append((a, b, n))
    return out


def _reach(a: list[int], b: list[int], edits: int) -> list[tuple[int, int]]:
    """For each number of edits, how many words of ``a`` can be covered, ending in a match, and how many of ``b`` that takes."""
    # far[d][k]: the furthest place in a on diagonal k = i - j with d edits (i counts words of a).
    best = [(0, 0)] * (edits + 1)
    la, lb = len(a), len(b)

    def slide(i: int, j: int) -> int:
        while i < la and j < lb and a[i] == b[j]:
            i, j = i + 1, j + 1
        return i

    far = {0: slide(0, 0)}
    best[0] = far[0], far[0]
    for d in range(1, edits + 1):
        new: dict[int, int] = {}
        top = best[d - 1]
        for k in range(-d, d + 1):
            # replaced: same diagonal; left out of the text: k - 1 -> k; added to the text: k + 1 -> k
            ways = (far.get(k, -2) + 1, far.get(k - 1, -2) + 1, far.get(k + 1, -2))
            start = max((i for i in ways if max(k, 0) <= i <= min(la, lb + k)), default=-1)
            if start < 0:
                continue
            end = slide(start, start - k)
            new[k] = end
            # An edit may come to a place as far as a match does; equal words there end the stretch as well as any.
            if end > top[0] and (end > start or end > max(k, 0) and a[end - 1] == b[end - k - 1]):
                top = end, end - k
        far, best[d] = new, top
    return best


class Detector:
    def __init__(self, items: list[tuple[int, str]], seed_words: int = SEED_WORDS, min_words: int = MIN_WORDS):
        self.vocab: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        for item, passage in items:
            seq = [self.vocab.setdefault(w, len(self.vocab)) for w in normal_words(passage)]
            if len(seq) >= min_words:
                self.items.append((item, seq))
        self.automaton = SuffixAutomaton([(i, seq) for i, (_, seq) in enumerate(self.items)])
        self.seed_words, self.min_words = seed_words, min_words
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, token: str, cache_entries: int = 300_000) -> tuple[int, ...]:
        """Numbers of the words in what stands between white space, -1 for those of no passage."""
        n = self.known.get(token)
        if n is None:
            get = self.vocab.get
            n = tuple(get(w, -1) for w in normal_words(token))
            if len(self.known) >= cache_entries:
                self.known.clear()
            if len(token) <= 64:
                self.known[token] = n
        return n

    def numbers(self, text: str) -> list[int]:
        """The text's normal words as numbers; without markup, every stretch between white space stands alone."""
        out: list[int] = []
        for token in without_markup(text).split():
            out += self._of(token)
        return out

    def places(self, text: str) -> list[tuple[int, int]]:
        """Where the stretch between white space that holds each of ``numbers`` begins and ends in the text."""
        out: list[tuple[int, int]] = []
        for m in _TOKEN.finditer(without_markup(text)):
            out += [m.span()] * len(self._of(m[0]))
        return out

    def _by_item(self, seq: list[int]) -> dict[int, list[tuple[int, int, int]]]:
        by_item: dict[int, list[tuple[int, int, int]]] = {}
        for number, p_end, t_end, size in self.automaton.seeds(seq, self.seed_words):
            by_item.setdefault(number, []).append((p_end, t_end, size))
        return by_item

    def leaks(self, text: str | None) -> list[tuple[int, int]]:
        """Items of which the text holds enough, with the longest stretch of each in words of the passage."""
        if not text or not self.items:
            return []
        seq = self.numbers(text)
        out = []
        for number, seeds in self._by_item(seq).items():
            item, passage = self.items[number]
            if found := leak_spans(passage, seq, seeds, self.min_words):
                out.append((item, max(n for _, _, n in found)))
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, float, int, int]]:
        """Every leaked stretch: item, words, their part of the passage, and from and to which character the text holds it."""
        if not text or not self.items:
            return []
        seq = self.numbers(text)
        out, at = [], None
        for number, seeds in self._by_item(seq).items():
            item, passage = self.items[number]
            for a, b, n in merged(leak_spans(passage, seq, seeds, self.min_words)):
                at = at or self.places(text)
                out.append((item, n, n / len(passage), at[a][0], at[b - 1][1]))
        return out


_TOKEN = re.compile(r"\S+")


def _load(payload: bytes) -> Detector:
    return Detector([tuple(x) for x in json.loads(payload)])


def _detectors(documents: DataFrame, items: DataFrame, item_col: str, passage_col: str, max_items: int) -> list[Shared]:
    """One detector for each block of about ``max_items`` items."""
    rows = settle_names(items, (item_col, passage_col)).select(item_col, passage_col).where(F.col(passage_col).isNotNull() & F.col(item_col).isNotNull()).distinct()
    n = max(1, math.ceil(rows.count() / max_items))
    blocks = [rows if n == 1 else rows.where(F.pmod(F.xxhash64(item_col, passage_col), F.lit(n)) == b) for b in range(n)]
    return [Shared(documents.sparkSession, _load, json.dumps(sorted([r[0], r[1]] for r in block.collect())).encode()) for block in blocks]


def _mapped(documents: DataFrame, shared: Shared, id_col: str, text_col: str, of, schema: str) -> DataFrame:
    """``id`` and what ``of(detector, text)`` gives for each text that isn't null, in one map."""
    names = ["id", *(c.split()[0] for c in schema.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = shared.get()
        for f in frames:
            yield pd.DataFrame([(i, *x) for i, t in zip(f["id"], f["text"]) for x in of(d, t)], columns=names)

    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return source.mapInPandas(run, f"id {documents.schema[id_col].dataType.simpleString()}, {schema}")


def detect(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", max_items: int = MAX_ITEMS) -> DataFrame:
    """``doc_id, item_id, n_words``: one map over the corpus for each block of items, no shuffle."""
    documents, kind = settle_names(documents, (id_col, text_col)), items.schema[item_col].dataType.simpleString()
    parts = [_mapped(documents, d, id_col, text_col, Detector.leaks, f"item {kind}, n_words int") for d in _detectors(documents, items, item_col, passage_col, max_items)]
    return reduce(DataFrame.unionByName, parts).withColumnsRenamed({"id": id_col, "item": item_col})


def spans(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", max_items: int = MAX_ITEMS) -> DataFrame:
    """``doc_id, item_id, n_words, coverage, from_char, to_char``: one row for each leaked stretch of each row."""
    documents, kind = settle_names(documents, (id_col, text_col)), items.schema[item_col].dataType.simpleString()
    schema = f"item {kind}, n_words int, coverage double, from_char int, to_char int"
    parts = [_mapped(documents, d, id_col, text_col, Detector.spans, schema) for d in _detectors(documents, items, item_col, passage_col, max_items)]
    return reduce(DataFrame.unionByName, parts).withColumnsRenamed({"id": id_col, "item": item_col})


def cut_out(text: str, places: list[tuple[int, int]]) -> str:
    """The text without these places; where something stays on both sides, a space parts it."""
    kept, last = [], 0
    for a, b, _ in merged([(a, b, 0) for a, b in places]):
        kept.append(text[last:a].rstrip() if not last else text[last:a].strip())
        last = b
    kept.append(text[last:].lstrip() if last else text)
    return " ".join(k for k in kept if k)


def remove(
    documents: DataFrame, items: DataFrame, most_words: int = MIN_WORDS - 1, most_coverage: float = 1.0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", max_items: int = MAX_ITEMS
) -> DataFrame:
    """``doc_id, text, n_removed``: every row of the documents without the leaked stretches of more than ``most_words`` words or more than ``most_coverage`` of their passage.

    Blocks of items are taken out one after another.
    """
    documents = settle_names(documents, (id_col, text_col))
    kind = documents.schema[id_col].dataType.simpleString()

    def one(df: DataFrame, shared: Shared) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            d = shared.get()
            for f in frames:
                texts, removed = [], []
                for t, n in zip(f["text"], f["n_removed"]):
                    gone = [(a, b) for _, words, part, a, b in d.spans(t) if words > most_words or part > most_coverage]
                    texts.append(cut_out(t, gone) if gone else t)
                    removed.append(n + len(gone))
                yield f.assign(text=texts, n_removed=removed)

        return df.mapInPandas(run, f"id {kind}, text string, n_removed int")

    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).alias("n_removed"))
    return reduce(one, _detectors(documents, items, item_col, passage_col, max_items), source).withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return detect(documents, items).select("doc_id", "item_id").distinct()
