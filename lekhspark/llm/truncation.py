"""Texts cut off by field limits, and how often each source cuts.

Two kinds of evidence are brought together:

* the ending. What was put after a break (ellipses, read-more links, closing quotes, years and
  addresses in a pointer) is taken off. A text that then closes with an end mark is whole; one
  that stops inside a tag, a character reference or a character is cut; for all others the odds
  come from how often its last two words (or its last word, or any word) close a sentence in
  the full contents of the corpus, counted over all of them;
* the length. For each source the lengths of whole texts get a log-normal distribution by maximum
  likelihood, where cut texts count as right-censored at their length. The limits are weighed by
  how much more cut mass lies at a length than elsewhere; the posterior of a record is the prior
  odds of censoring at its length times the odds of its ending. Both are found by EM on the
  source's histogram of length and ending odds, which is aggregated before the shuffle, so a
  source that holds a third of the rows costs one small group.

Defined cases: null, blank and punctuation-only summaries are never cut and don't count as
values of their source; a null source is a source; repeated rows count once; a sentence that
only lacks its end mark is whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhspark.llm.arrow import Shared
from lekhspark.session import broadcast_if_small, cut_lineage, settle_names

END_MARKS = "।॥.!?۔؟"
_BROKEN = re.compile(r"(?:<[a-zA-Z/!][^<>]*|&(?:#?\w{0,8})|�+)\s*$")
_ENTITY_DOTS = re.compile(r"&hellip;|&#8230;|&#x2026;", re.I)
# Phrases of links that lead to the whole text.
READ_MORE = ("पूरा लेख पढ़ें", "पूरी ख़बर पढ़ें", "पूरा पढ़ें", "आगे पढ़ें", "और पढ़ें", "विस्तार से पढ़ें", "read more", "continue reading", "read the full article", "read full story", "more", "aage padhein", "poora padhein", "अधिक वाचा", "पुढे वाचा", "थप पढ्नुहोस्", "আরও পড়ুন", "مزید پڑھیں")
_MORE = re.compile(r"[\s\[(<]*(?:" + "|".join(map(re.escape, READ_MORE)) + r")\s*(?:[»›→>\])]|\.{2,}|…)*\s*$", re.I)
_DOTS = re.compile(r"[\s\[({]*(?:\.(?:\s?\.)+|…)+[\s\])}]*$|[\[({]\s*[\])}]\s*$")
_ARROWS = re.compile(r"[\s»›→]+$")
_URL = re.compile(r"(?:https?://|www\.)\S+\s*$", re.I)
_BRACKETS = re.compile(r"\s*[(\[][^()\[\]]*[)\]]\s*$")
_OPEN_TAIL = re.compile(r"[\s,;:(\[{<\-–—/&'‘“\"]+$")
_CLOSERS = "\"'”’»)]"
# Abbreviations whose dot ends no sentence.
ABBREVIATIONS = frozenset("डॉ प्रो श्री श्रीमती सुश्री पं क्र रु नं सं ई पू कि मी वि dr prof mr mrs ms st no vs fig rs smt shri pt etc approx ca dept govt".split())
_EDGE = "।॥.!?۔؟,;:()[]{}<>\"'“”‘’«»…|-–—"


def taken_off(text: str) -> tuple[str, str]:
    """The text before whatever was put after its end, and how that ends: ``whole``, ``broken`` or ``open``."""
    s = _ENTITY_DOTS.sub("…", text).strip()
    decorated = False
    while s:
        if _BROKEN.search(s) and not re.search(r"&#?\w+;\s*$", s):
            return _BROKEN.sub("", s).rstrip(), "broken"
        for rule in (_MORE, _DOTS, _ARROWS):
            t = rule.sub("", s)
            if t != s and t.strip():
                s, decorated = t.rstrip(), True
                break
        else:
            break
    core = s
    if not decorated:
        if (m := _URL.search(s)) and (t := s[: m.start()].rstrip()):
            head = re.split(rf"(?<=[{END_MARKS}])\s+", t)
            if head[-1][-1] in END_MARKS or len(head) > 1 and len(head[-1].split()) <= 3:
                return core, "whole"
        while (m := _BRACKETS.search(s)) and s[: m.start()].strip():
            s = s[: m.start()].rstrip()
    closed = s.rstrip(_CLOSERS + " ")
    if closed and closed[-1] in END_MARKS:
        last = closed.split()[-1]
        bare = last.strip(_EDGE)
        if last.endswith(".") and (bare.lower() in ABBREVIATIONS or bare.isdigit() and "।" in closed):
            return core, "broken"  # such a dot ends no sentence
        return core, "whole"
    return core, "open"


def last_words(s: str) -> tuple[str, str]:
    """The last two words without the signs around them; empty where there are none."""
    ws = [w for w in (x.strip(_EDGE) for x in _OPEN_TAIL.sub("", s).split()[-4:]) if w]
    return (ws[-2] if len(ws) > 1 else "", ws[-1] if ws else "")


ENDING_SCHEMA = "id string, source string, core_len int, state string, w1 string, w2 string"


def endings(df: DataFrame, id_col: str = "id", text_col: str = "summary_hi", source_col: str = "partner_label") -> DataFrame:
    """One row per distinct value that isn't blank; texts are told apart by their hash, so only short rows are shuffled."""
    df = settle_names(df, (id_col, text_col, source_col))
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"), text.alias("text"), F.xxhash64(text).alias("same")).where(F.col("text").isNotNull())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, src, text, same in zip(f["id"], f["source"], f["text"], f["same"]):
                if not text.strip(_EDGE + " \t\r\n\xa0​﻿"):
                    continue
                core, state = taken_off(text)
                out.append((i, src, len(core), state, *last_words(core), same))
            yield pd.DataFrame(out, columns=["id", "source", "core_len", "state", "w1", "w2", "same"])

    return rows.mapInPandas(run, ENDING_SCHEMA + ", same bigint").distinct().drop("same")


def repeats(contents: DataFrame, text_col: str = "content_hi") -> DataFrame:
    """``same, k``: the hash of each content that stands in several rows, and how many; texts themselves aren't shuffled."""
    return contents.select(F.xxhash64(text_col).alias("same")).groupBy("same").agg(F.count("*").alias("k")).where(F.col("k") > 1)


_CLOSES = re.compile(rf"[{END_MARKS}|][{re.escape(_CLOSERS)}]*$")


def _words(payload: bytes) -> frozenset[str]:
    return frozenset(payload.decode().split("\n"))


def closing_counts(contents: DataFrame, wanted: DataFrame, text_col: str = "content_hi", max_wanted: int = 500_000) -> DataFrame:
    """``w1, w2, n, n_final``: how often each pair of words whose second is in ``wanted`` (``w2``) stands in the corpus, and how often it closes a sentence.

    All contents are read and every place of a wanted word is counted, in one map that sums up before its rows are shuffled; wanted words beyond
    ``max_wanted`` are taken in blocks, a map each. A content that stands in ``k`` rows counts once, a ``k``-th in each.
    """
    heavy = broadcast_if_small(repeats(contents, text_col))
    one = contents.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("same")).join(heavy, "same", "left").select("text", (1 / F.coalesce("k", F.lit(1))).alias("share"))
    n = max(1, math.ceil(wanted.count() / max_wanted))
    parts = []
    for block in range(n):
        some = wanted if n == 1 else wanted.where(F.pmod(F.xxhash64("w2"), F.lit(n)) == block)
        parts.append(one.mapInPandas(_counter(Shared(contents.sparkSession, _words, "\n".join(sorted(r["w2"] for r in some.select("w2").collect())).encode())), "w1 string, w2 string, n double, n_final double"))
    return reduce(DataFrame.unionByName, parts).groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.sum("n_final").alias("n_final"))


def _counter(shared: Shared, held: int = 200_000):
    def flushed(counts: dict) -> pd.DataFrame:
        out = pd.DataFrame([(*k, *v) for k, v in counts.items()], columns=["w1", "w2", "n", "n_final"])
        counts.clear()
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = shared.get()
        known: dict[str, tuple[str, bool] | None] = {}  # of what stands between white space: the word and whether it closes, if wanted
        counts: dict[tuple[str, str], list[float]] = {}
        for f in frames:
            for text, share in zip(f["text"], f["share"]):
                for line in text.split("\n"):
                    ws = line.split()
                    last = len(ws) - 1
                    for i in range(1, last + 1):
                        w = ws[i]
                        if w in known:
                            if (hit := known[w]) is None:
                                continue
                        else:
                            word = w.strip(_EDGE)
                            hit = (word, _CLOSES.search(w) is not None) if word in wanted else None
                            if len(known) >= held:
                                known.clear()
                            known[w] = hit
                            if hit is None:
                                continue
                        c = counts.setdefault((ws[i - 1].strip(_EDGE), hit[0]), [0.0, 0.0])
                        c[0] += share
                        if hit[1] or i == last:
                            c[1] += share
            if len(counts) >= held:
                yield flushed(counts)
        yield flushed(counts)

    return run


def _log_normal(l: np.ndarray, mu: float, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    z = (np.log(l) - mu) / sigma
    pdf = np.exp(-0.5 * z * z) / (l * sigma * math.sqrt(2 * math.pi))
    upper = np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in z])
    return np.maximum(pdf, 1e-12), np.maximum(upper, 1e-12)


def fit_source(length: np.ndarray, odds: np.ndarray, n: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float, float]:
    """Posterior of being cut for each cell of a source's histogram, and its log-normal's parameters.

    ``odds``: log odds of the ending alone at even prior odds. Cut mass is spread over lengths:
    its share at a length, against a floor that is even over all, is that length's weight as a limit.
    """
    l = np.maximum(length, 1).astype(float)
    total = n.sum()
    p = 1 / (1 + np.exp(-(odds - 1.5)))
    mu, sigma = float((np.log(l) * n).sum() / total), 0.6
    for _ in range(rounds):
        cut = (n * p).sum()
        share = (cut + 1) / (total + 20)
        # right-censored maximum likelihood: expected log lengths of the cut texts beyond their cut
        z = (np.log(l) - mu) / sigma
        _, upper = _log_normal(l, mu, sigma)
        hazard = np.minimum(np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / upper, z.clip(0) + 3)
        first = mu + sigma * hazard
        second = mu * mu + sigma * sigma + sigma * hazard * (np.log(l) + mu)
        m1 = (n * ((1 - p) * np.log(l) + p * first)).sum() / total
        m2 = (n * ((1 - p) * np.log(l) ** 2 + p * second)).sum() / total
        mu, sigma = float(m1), float(min(1.5, max(0.15, math.sqrt(max(m2 - m1 * m1, 1e-4)))))
        pdf, upper = _log_normal(l, mu, sigma)
        uniq, back = np.unique(length, return_inverse=True)
        at = np.bincount(back, weights=n * p)
        width = max(60.0, float(uniq.max()))
        limit = (0.5 * at / max(cut, 1e-9) + 0.5 / width)[back]
        prior = np.log(share) - np.log1p(-share) + np.log(limit) + np.log(upper) - np.log(pdf)
        new = 1 / (1 + np.exp(-np.clip(odds + np.clip(prior, -3.0, 3.0), -30, 30)))
        if np.abs(new - p).max() < 1e-4:
            p = new
            break
        p = new
    return p, mu, sigma


def likeliest_limit(length: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[int, float]:
    """The length at which a source most likely cuts, and the part of its expected cuts that lies there; (0, 0) where nothing is cut."""
    uniq, back = np.unique(length, return_inverse=True)
    at = np.bincount(back, weights=n * p)
    best = int(at.argmax())
    return (int(uniq[best]), float(at[best] / at.sum())) if at.sum() >= 0.5 else (0, 0.0)


#: What an ending says by itself, as log odds: a closed sentence is no break by definition, half a tag, reference or character always is one.
CLOSED_ODDS, BROKEN_ODDS = -12.0, 12.0
FITTED = "source string, core_len int, odds double, p_cut double, mu double, sigma double, limit_len int, limit_part double"


def posteriors(articles: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """``id, source, core_len, state, odds, p_cut`` of each distinct summary, and its source's ``mu, sigma, limit_len, limit_part``."""
    articles = settle_names(articles, ("id", "summary_hi", "partner_label", "content_hi"))
    ends = cut_lineage(endings(articles))  # read four times, and far smaller than the texts
    # A prefix of a word may be a word, so the pair decides where it was seen; else the word; else any word.
    open_pairs = ends.where("state = 'open'").select("w1", "w2").distinct()
    pairs = cut_lineage(closing_counts(articles.select("content_hi").where(F.col("content_hi").isNotNull()), open_pairs.select("w2").distinct()))
    single = pairs.groupBy("w2").agg(F.sum("n").alias("n1"), F.sum("n_final").alias("f1"))
    p0 = 0.02
    p1 = (F.coalesce("f1", F.lit(0)) + smoothing * p0) / (F.coalesce("n1", F.lit(0)) + smoothing)
    p2 = (F.coalesce("n_final", F.lit(0)) + smoothing * p1) / (F.coalesce("n", F.lit(0)) + smoothing)
    seen = open_pairs.join(pairs, ["w1", "w2"], "left").join(single, "w2", "left").select("w1", "w2", p2.alias("p"))
    odds = (
        F.when(F.col("state") == "whole", F.lit(CLOSED_ODDS))
        .when(F.col("state") == "broken", F.lit(BROKEN_ODDS))
        .otherwise(F.log((1 - F.coalesce("p", F.lit(p0))) / F.coalesce("p", F.lit(p0))))
    )
    scored = cut_lineage(ends.join(seen, ["w1", "w2"], "left").select("id", "source", "core_len", "state", (F.round(odds * 2) / 2).alias("odds")))
    cells = scored.groupBy("source", "core_len", "odds").agg(F.count("*").alias("n"))

    def one_source(f: pd.DataFrame) -> pd.DataFrame:
        length, n = f["core_len"].to_numpy(), f["n"].to_numpy(float)
        p, mu, sigma = fit_source(length, f["odds"].to_numpy(float), n)
        limit, part = likeliest_limit(length, p, n)
        return f.assign(p_cut=p, mu=mu, sigma=sigma, limit_len=limit, limit_part=part)[[c.split()[0] for c in FITTED.split(", ")]]

    fitted = cells.groupBy("source").applyInPandas(one_source, FITTED)
    return (
        scored.alias("s")
        .join(fitted.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")) & (F.col("s.core_len") == F.col("f.core_len")) & (F.col("s.odds") == F.col("f.odds")))
        .select("s.id", "s.source", "s.core_len", "s.state", "s.odds", "f.p_cut", "f.mu", "f.sigma", "f.limit_len", "f.limit_part")
    )


def found(articles: DataFrame) -> DataFrame:
    """``id`` of every article whose summary is cut, each once."""
    return posteriors(articles).where(F.col("p_cut") > 0.5).select("id").distinct()


def rates(articles: DataFrame) -> DataFrame:
    """Per source: distinct summaries, cut ones, their share, the expected share by the posteriors, and the fit: median length, spread and the likeliest limit with its part of the cuts."""
    p = posteriors(articles)
    cut = F.col("p_cut") > 0.5
    fit = [F.round(F.exp(F.first("mu")), 3).alias("median_len"), F.round(F.first("sigma"), 6).alias("sigma"), F.first("limit_len").alias("limit_len"), F.round(F.first("limit_part"), 6).alias("limit_part")]
    return p.groupBy(F.col("source").alias("partner_label")).agg(F.count("*").alias("n_values"), F.sum(cut.cast("int")).alias("n_cut"), F.round(F.avg(cut.cast("double")), 6).alias("cut_share"), F.round(F.avg("p_cut"), 6).alias("expected_share"), *fit)
