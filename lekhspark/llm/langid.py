"""Languages of documents and of the stretches inside them.

Two levels. The family of a sentence is the script most of its words are written in
(Devanagari, Bengali, Arabic, Latin); within a family that has several languages, linear
support vector machines, one for each pair of languages, vote. Their features are words and
character 1- to 4-grams inside words, hashed; a sentence's value is the mean over its words,
so the value of a word is computed once per worker and kept.

The machines are trained on the driver by dual coordinate descent over a bounded sample:
at most ``docs_per_language`` labelled documents of each language, those with the smallest
hash of their id (top rows per language, picked on the executors).

Neighbouring sentences of one language form a stretch. A stretch counts as text of its
language only if one of its sentences has ``min_words`` words or more and ends like a
sentence or a paragraph; shorter ones (names, addresses, single foreign words) take the
language around them.

Confidence of a sentence: the logistic of the smallest winning margin, times the share of its
words in the family's script; of a stretch and of a document, the mean weighted by letters.
A document's ``latin_pct`` from the quality report moves its confidence a little when it
contradicts the text, and never its language: the report is unreliable.

Defined cases: a null, blank or letterless text has no stretches, and the document row has
language null and confidence 0; repeated rows give repeated results (p2_found gives each
case once); a declared language outside the seven is wrong like any other.
"""

from __future__ import annotations

import itertools
import json
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhspark.llm.arrow import Shared
from lekhspark.session import settle_names

LANGUAGES = ("hi", "en", "mr", "ne", "bn", "ur", "hi-latn")
FAMILIES = {"deva": ("hi", "mr", "ne"), "latn": ("en", "hi-latn"), "beng": ("bn",), "arab": ("ur",)}
FAMILY_OF = {lang: fam for fam, langs in FAMILIES.items() for lang in langs}
PAIRS = [p for langs in FAMILIES.values() for p in itertools.combinations(langs, 2)]

DIMS = 1 << 17
#: Longer documents aren't taken for training, so that the sample stays small; they are labelled like all others.
LONGEST = 100_000
_SCRIPTS = {
    "deva": re.compile("[ऀ-ॣ॰-ॿ]"),
    "beng": re.compile("[ঀ-৥ৰ-৿]"),
    "arab": re.compile("[؀-؋ؐ-ٟٮ-ۓە-ۯۺ-ۿݐ-ݿ]"),
    "latn": re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]"),
}
_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:[̀-ͯऀ-ःऺ-ॏ॑-ॗॢॣঁ-ঃ়-্ৗ‌‍]+[^\W\d_]*)*(?!\w)")
_SENTENCE = re.compile(r"[^\n।॥.!?۔؟|]*(?:[।॥.!?۔؟|]+(?![\s\"'”’»)\]]|$)[^\n।॥.!?۔؟|]*)*(?:[।॥.!?۔؟|]+[\"'”’»)\]]*)?")
_ADDRESS = re.compile(r"(?:[a-z]+://|www\.)\S+|[^\s@]+@\S+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?:/\S*)?", re.I | re.A)
_END = re.compile(r"[।॥.!?۔؟|]+[\"'”’»)\]]*\s*$")


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Places of the sentences: up to an end mark before white space, or to the line's end."""
    for m in _SENTENCE.finditer(text):
        if m.end() > m.start() and not m.group().isspace():
            yield m.span()


def family(s: str) -> tuple[str | None, float, list[str]]:
    """The script family of most words, its share of the words, and its words.

    Addresses of the web and of mail aren't words of a language.
    """
    by: dict[str, list[str]] = {f: [] for f in FAMILIES}
    for w in words(_ADDRESS.sub(" ", s) if "/" in s or "@" in s or "." in s else s):
        for f, r in _SCRIPTS.items():
            if r.match(w):
                by[f].append(w)
                break
    total = sum(map(len, by.values()))
    if not total:
        return None, 0.0, []
    best = max(by, key=lambda f: len(by[f]))
    return best, len(by[best]) / total, by[best]


def word_features(word: str) -> dict[int, float]:
    w = f"<{word}>"
    out: dict[int, float] = {}
    for g in [w, *(w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1))]:
        h = zlib.crc32(g.encode()) % DIMS
        out[h] = out.get(h, 0.0) + 1.0
    size = math.sqrt(sum(v * v for v in out.values()))
    return {h: v / size for h, v in out.items()}


_features = lru_cache(maxsize=50_000)(word_features)


def words(s: str) -> list[str]:
    return _WORD.findall(s.lower())


def _sentence_vector(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    total: dict[int, float] = {}
    for w in ws:
        for h, v in _features(w).items():
            total[h] = total.get(h, 0.0) + v
    at = np.fromiter(total, np.int64, len(total))
    return at, np.fromiter(total.values(), float, len(total)) / len(ws)


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 4.0, epochs: int = 8, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss linear machine by dual coordinate descent; the last weight is the bias."""
    w, bias = np.zeros(DIMS), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    # Classes of different size weigh alike.
    bound = np.where(y > 0, c / max(1, (y > 0).sum()), c / max(1, (y < 0).sum())) * len(rows) / 2
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), bound[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                bias += step
                alpha[i] = new
                moved += abs(step)
        if moved < 1e-3 * len(rows):
            break
    return w, bias


class Discriminator:
    """Family, then a vote of the pairwise machines."""

    def __init__(self, weights: dict[tuple[str, str], tuple[np.ndarray, float]], cache_words: int = 300_000):
        self.pairs = {f: [p for p in PAIRS if FAMILY_OF[p[0]] == f and p in weights] for f in FAMILIES}
        self.weights = weights
        self.cache: dict[str, dict[str, tuple[float, ...]]] = {f: {} for f in FAMILIES}
        self.cache_words = cache_words

    def _word(self, fam: str, w: str) -> tuple[float, ...]:
        known = self.cache[fam].get(w)
        if known is None:
            fs = word_features(w)
            at, v = np.fromiter(fs, np.int64, len(fs)), np.fromiter(fs.values(), float, len(fs))
            known = tuple(float(self.weights[p][0][at] @ v) for p in self.pairs[fam])
            if len(self.cache[fam]) >= self.cache_words:
                self.cache[fam].clear()
            self.cache[fam][w] = known
        return known

    def sentence(self, s: str) -> tuple[str | None, float, int, int]:
        """Language, confidence, letters and words."""
        fam, share, own = family(s)
        if fam is None:
            return None, 0.0, 0, 0
        letters = sum(map(len, own))
        pairs = self.pairs[fam]
        if not pairs:
            return FAMILIES[fam][0], share, letters, len(own)
        sums = [0.0] * len(pairs)
        for w in own:
            for k, x in enumerate(self._word(fam, w)):
                sums[k] += x
        votes = dict.fromkeys(FAMILIES[fam], 0.0)
        least = dict.fromkeys(FAMILIES[fam], math.inf)
        for (a, b), x in zip(pairs, sums):
            margin = x / len(own) + self.weights[a, b][1]
            win = a if margin >= 0 else b
            votes[win] += 1 + 1e-3 * math.tanh(abs(margin))
            least[win] = min(least[win], abs(margin))
        lang = max(votes, key=lambda v: votes[v])
        return lang, share / (1 + math.exp(-3 * min(least[lang], 10))), letters, len(own)


def normal_label(label: Column) -> Column:
    """Lower case, without a region; null for labels that declare nothing."""
    t = F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    # A suffix of four letters is a script, not a region.
    t = F.regexp_replace(F.replace(t, F.lit("_"), F.lit("-")), r"-(?:[a-z]{2}|[0-9]{3})$", "")
    return F.when(~t.isin("", "und"), t)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_language: int = 200, sentences_per_language: int = 900) -> bytes:
    """Pairwise machines as bytes, from at most ``docs_per_language`` documents of each language."""
    labelled = settle_names(labelled, (id_col, lang_col, text_col))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    texts = labelled.select(F.col(id_col).alias("id"), normal_label(F.col(lang_col)).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isin(*LANGUAGES) & (F.length("text") <= LONGEST))
    # The ids are picked without their texts, which are fetched for the picked ones only.
    picked = texts.select("id", "lang").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= docs_per_language)
    sample = texts.join(F.broadcast(picked), ["id", "lang"]).groupBy("lang", "n").agg(F.min("text").alias("text")).collect()
    rows: dict[str, list] = {x: [] for x in LANGUAGES}
    for r in sorted(sample, key=lambda r: (r["lang"], r["n"])):
        for a, b in sentences(r["text"]):
            s = r["text"][a:b]
            fam, share, ws = family(s)
            if len(ws) >= 4 and fam == FAMILY_OF[r["lang"]] and share > 0.8 and len(rows[r["lang"]]) < sentences_per_language:
                rows[r["lang"]].append(ws)
    weights = {}
    for a, b in PAIRS:
        if rows[a] and rows[b]:
            xs = [_sentence_vector(ws) for ws in rows[a] + rows[b]]
            weights[a, b] = train_svm(xs, np.array([1.0] * len(rows[a]) + [-1.0] * len(rows[b])))
    head = json.dumps([[a, b, bias] for (a, b), (_, bias) in weights.items()]).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(v.astype(np.float32).tobytes() for v, _ in weights.values())


def load(payload: bytes) -> Discriminator:
    n = int.from_bytes(payload[:4], "little")
    body = np.frombuffer(payload[4 + n :], np.float32).reshape(-1, DIMS).astype(float)
    return Discriminator({(a, b): (body[i], bias) for i, (a, b, bias) in enumerate(json.loads(payload[4 : 4 + n]))})


def stretches(text: str, model: Discriminator, min_words: int = 4) -> list[tuple[int, int, str, float, int, int]]:
    """Runs of sentences of one language: start, end, language, confidence, letters, whole sentences."""
    out: list[list] = []
    held: list[tuple[int, int]] = []
    for a, b in sentences(text):
        lang, conf, letters, n_words = model.sentence(text[a:b])
        whole = n_words >= min_words and (_END.search(text, a, b) is not None or b == len(text) or text[b] == "\n")
        if lang is None or not whole:
            if out:
                out[-1][1] = b
            else:
                held.append((a, b))
            continue
        if out and out[-1][2] == lang:
            last = out[-1]
            last[3] = (last[3] * last[4] + conf * letters) / (last[4] + letters)
            last[1], last[4], last[5] = b, last[4] + letters, last[5] + 1
        else:
            out.append([held[0][0] if held and not out else a, b, lang, conf, letters, 1])
    if not out and held:  # nothing but fragments: the text as a whole
        a, b = held[0][0], held[-1][1]
        lang, conf, letters, _ = model.sentence(text[a:b])
        if lang is not None:
            out.append([a, b, lang, conf, letters, 0])
    return [tuple(x) for x in out]


SEGMENT_SCHEMA = "seg_no int, from_char int, to_char int, lang string, confidence double, letters int, n_sentences int"


def segment(df: DataFrame, model: bytes, id_col: str = "id", text_col: str = "content_hi", keep: tuple[str, ...] = (), min_words: int = 4) -> DataFrame:
    """One row per stretch: ``id_col``, ``keep`` and SEGMENT_SCHEMA; a map without any shuffle."""
    df = settle_names(df, (id_col, *keep, text_col))
    shared = Shared(df.sparkSession, load, model)
    kept = [f"{c} {df.schema[c].dataType.simpleString()}" for c in (id_col, *keep)]
    cols = [id_col, *keep]
    source = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)], F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    schema = ", ".join([f"k{i} {k.split(' ', 1)[1]}" for i, k in enumerate(kept)] + [SEGMENT_SCHEMA])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.get()
        names = [f"k{i}" for i in range(len(cols))]
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                out += [(*row[:-1], i, *s) for i, s in enumerate(stretches(row[-1], m, min_words))]
            yield pd.DataFrame(out, columns=[*names, "seg_no", "from_char", "to_char", "lang", "confidence", "letters", "n_sentences"])

    return source.mapInPandas(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(cols)})


def label_articles(articles: DataFrame, quality: DataFrame, model: bytes) -> DataFrame:
    """``id, declared, lang, confidence, n_langs``: one row per id, its main language by letters."""
    segs = segment(articles.select("id", "content_hi").distinct(), model)
    by_lang = segs.groupBy("id", "lang").agg(F.sum("letters").alias("letters"), F.sum(F.col("confidence") * F.col("letters")).alias("weighted"))
    best = by_lang.groupBy("id").agg(
        F.max_by("lang", F.struct("letters", "lang")).alias("lang"),
        (F.max_by("weighted", F.struct("letters", "lang")) / F.sum("letters")).alias("text_conf"),
        F.count("*").alias("n_langs"),
    )
    pct = F.when(F.col("latin_pct") > 1, F.col("latin_pct") / 100).otherwise(F.col("latin_pct"))
    evidence = quality.where(F.col("id").isNotNull() & pct.between(0, 1)).groupBy("id").agg(F.avg(pct).alias("latin"))
    ids = articles.groupBy("id").agg(F.min(normal_label(F.col("lang"))).alias("declared"))
    against = F.when(F.col("lang").isin("en", "hi-latn"), 1 - F.col("latin")).otherwise(F.col("latin"))
    return (
        ids.join(best, ids["id"].eqNullSafe(best["id"]), "left").drop(best["id"])
        .join(evidence, "id", "left")
        .select("id", "declared", "lang", F.round(F.coalesce(F.col("text_conf") * (1 - 0.1 * F.coalesce(against, F.lit(0.0))), F.lit(0.0)), 6).alias("confidence"), F.coalesce("n_langs", F.lit(0)).alias("n_langs"))
    )


def found(articles: DataFrame, model: bytes) -> DataFrame:
    """``id, lang``: languages with a whole sentence in ``content_hi`` that the row doesn't declare."""
    articles = settle_names(articles, ("id", "content_hi", "lang"))
    rows = articles.select("id", "content_hi", normal_label(F.col("lang")).alias("declared"))
    segs = segment(rows, model, keep=("declared",))
    hit = segs.where((F.col("n_sentences") > 0) & ~F.col("declared").eqNullSafe(F.col("lang")))
    return hit.select("id", "lang").distinct()
