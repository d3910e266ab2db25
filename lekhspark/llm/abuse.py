"""Abusive, threatening, demeaning or sexually explicit content.

Two word models, one for sentences that abuse and one for ordinary ones, are trained on labelled
documents. Both are interpolated Kneser-Ney trigram models: trigrams by their occurrences, bigrams and words by the number of different
words before them in the class; below stand such continuation counts of all labelled text together, so an expression that a class has
not seen gets the same, shared probability in both. The abusive class is small, so what a word adds for abuse is shrunk by ``n / (n + SHRINK)``, ``n`` being the abusive
sentences that hold it. A sentence's score is the difference of
its log-likelihoods divided by its words; it counts as abusive when the difference itself
outweighs the prior odds and the mean is above ``least_mean``. A document's score is that of its
worst sentence.

Labels are of documents, abuse is in sentences, so a latent label of each sentence of the documents
that most raters call abusive is found by hard EM with the prior ``in_positive``. A sentence never
vouches for itself (all that it adds to the counts is taken off when it is scored), so a word speaks for abuse only
with support from another sentence, and one word's part is held within ``CLIP``; so the odd sentence of a
wrongly labelled document finds no support. Documents whose raters are split are left out; documents of the same text share their votes.
Training takes at most
``max_documents`` labelled texts of ``max_bytes`` together, those with the smallest hash of each class, the
classes in their own proportion at every size (a tenth of the places at least for a class that fills it).

Words are compared in a folded form: compatibility forms, case, invisible characters, look-alike
letters, digits and signs used as letters, separators put between letters, and letters
repeated three times or more are undone; numbers are one word.

Defined cases: null, empty and wordless texts score 0 and aren't abusive; without labels of both
kinds every score is 0; repeated rows are scored alike; labels of unknown documents and null
labels are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhspark.llm.arrow import Shared
from lekhspark.llm.leakage import _INVISIBLE
from lekhspark.llm.plainform import LATIN_LOOKALIKES
from lekhspark.session import cut_lineage, settle_names

MAX_DOCUMENTS, MAX_BYTES = 20_000, 64 << 20
IN_POSITIVE, SURE, DISCOUNT, CLIP, SHRINK = 0.15, 3.0, 0.75, 5.0, 1.0
PRIOR, LEAST_MEAN = 0.003, 0.3
NEED = math.log((1 - PRIOR) / PRIOR)

_LOOKALIKE = str.maketrans({p[0].lower(): p[1].lower() for group in LATIN_LOOKALIKES.values() for p in group.split()})
# Digits and signs written for Latin letters.
_LEET = str.maketrans("0134578$@!|", "oieastbsail")
_END = re.compile(r"[।॥.!?۔؟…|]+[\"'”’»)\]]*$")
_EDGE = re.compile(r"^[^\w$@*ऀ-ॿ]+|[^\w$*ऀ-ॿ]+$")
_LATIN = re.compile("[a-z]")
_INSIDE = re.compile(r"[^\w*ऀ-ःऺ-ॏ॑-ৗۖ-ًۭ-ٰٟ]+")
_REPEATED = re.compile(r"(.)\1{2,}")


def fold(token: str) -> tuple[tuple[str, ...], bool]:
    """The folded words of what stands between white space, and whether a sentence ends there."""
    t = _INVISIBLE.sub("", unicodedata.normalize("NFKC", token)).lower()
    ends = _END.search(t) is not None
    t = _EDGE.sub("", t.rstrip("।॥!?۔؟…|"))
    if not t:
        return (), ends
    folded = t.translate(_LOOKALIKE)
    if _LATIN.search(folded) and not any("Ѐ" <= c < "԰" or "Ͱ" <= c < "Ͽ" for c in folded):
        t = folded
        if re.search(r"[a-z][0-9$@!|]|[0-9$@!|][a-z]", t):
            t = t.translate(_LEET)
        t = re.sub(r"[$@!|]", " ", t)
    t = t.replace("।", " ").replace("॥", " ")
    out: list[str] = []
    for word in t.split():
        parts = [p for p in _INSIDE.split(word) if p]
        if len(parts) > 1 and (min(map(len, parts)) <= 2 or len(parts) > 2 and sum(map(len, parts)) <= 4 * len(parts)):
            parts = ["".join(parts)]  # separators put between letters
        for p in parts:
            p = _REPEATED.sub(r"\1", p)
            out.append("#" if p.isdigit() else p)
    return tuple(out), ends


def sentences(text: str, cache: dict, cache_entries: int = 300_000) -> Iterator[list[str]]:
    for line in text.split("\n"):
        words: list[str] = []
        for token in line.split():
            known = cache.get(token)
            if known is None:
                known = fold(token)
                if len(cache) >= cache_entries:
                    cache.clear()
                if len(token) <= 64:
                    cache[token] = known
            words += known[0]
            if known[1] and words:
                yield words
                words = []
        if words:
            yield words


class _Grams:
    """Numbers of all n-grams of a list of sentences, position by position."""

    def __init__(self, sents: list[list[int]], vocabulary: int):
        lengths = np.array([len(s) + 1 for s in sents], np.int64)
        flat = np.concatenate([np.array([*s, 1], np.int64) for s in sents])  # 1: end of the sentence
        self.sentence = np.repeat(np.arange(len(sents)), lengths)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        before = lambda d: np.where(place >= d, np.roll(flat, d), 0)
        w, v, u = flat, before(1), before(2)  # 0: start of the sentence
        self.key = {1: w, 2: v * vocabulary + w, 3: (u * vocabulary + v) * vocabulary + w}
        self.context = {1: np.zeros_like(w), 2: v, 3: u * vocabulary + v}
        self.gram, self.ctx, self.gram_at, self.gram_ctx = {}, {}, {}, {}
        for n in (1, 2, 3):
            _, self.gram_at[n], self.gram[n] = np.unique(self.key[n], return_index=True, return_inverse=True)
            _, self.ctx[n] = np.unique(self.context[n], return_inverse=True)
            self.gram_ctx[n] = self.ctx[n][self.gram_at[n]]
        #: For each n-gram the (n-1)-gram it ends with: its own number there.
        self.lower = {n: self.gram[n - 1][self.gram_at[n]] for n in (2, 3)}
        # Of each n-gram of each sentence: sentence, n-gram, its places there; and back from positions to those.
        self.pair, self.pair_n = {}, {}
        for n in (1, 2, 3):
            _, at, back, times = np.unique(self.sentence * len(self.gram_at[n]) + self.gram[n], return_index=True, return_inverse=True, return_counts=True)
            self.pair[n] = self.sentence[at], self.gram[n][at], back
            self.pair_n[n] = times.astype(float)

    def kinds_of(self, n: int, weight: np.ndarray) -> np.ndarray:
        """Continuation counts: before each n-gram, the number of different words among positions with a weight."""
        seen = np.bincount(self.gram[n + 1], weights=weight) > 0
        return np.bincount(self.lower[n + 1], weights=seen, minlength=len(self.gram_at[n]))

    def counts(self, n: int, weight: np.ndarray) -> np.ndarray:
        """Kneser-Ney counts of the n-grams: occurrences of trigrams, different words before shorter ones."""
        return np.bincount(self.gram[3], weights=weight) if n == 3 else self.kinds_of(n, weight)

    def own_part(self, n: int, k: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """At each position, what its own sentence adds to the count of its n-gram, to its context's sum, and to the context's different words."""
        sentence, gram, back = self.pair[n]
        if n == 3:
            own = self.pair_n[3] * weight[self.first(3)]
        else:
            up_sentence, up_gram, _ = self.pair[n + 1]
            up = np.bincount(self.gram[n + 1], weights=weight)
            alone = (up[up_gram] > 0) & (up[up_gram] - self.pair_n[n + 1] * weight[self.first(n + 1)] <= 0)
            place = np.searchsorted(sentence * len(self.gram_at[n]) + gram, up_sentence * len(self.gram_at[n]) + self.lower[n + 1][up_gram])
            own = np.bincount(place, weights=alone, minlength=len(gram))
        gone = (k[gram] > 0) & (k[gram] - own <= 0)
        _, at = np.unique(sentence * (len(self.gram_at[n]) + 1) + self.gram_ctx[n][gram], return_inverse=True)
        return own[back], np.bincount(at, weights=own)[at][back], np.bincount(at, weights=gone)[at][back]

    def sentences_with(self, n: int, weight: np.ndarray) -> np.ndarray:
        """The sentences with a weight that hold each n-gram."""
        return np.bincount(self.pair[n][1], weights=weight[self.first(n)])

    def first(self, n: int) -> np.ndarray:
        """A position of each pair of sentence and n-gram."""
        back = self.pair[n][2]
        at = np.empty(len(self.pair_n[n]), np.int64)
        at[back] = np.arange(len(back))
        return at


def _class_probability(g: _Grams, weight: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """P(word | two before) at every position under the class whose positions have this weight (0 or 1), without what the position's own sentence adds."""
    p = shared
    for n in (1, 2, 3):
        k = g.counts(n, weight)
        own, own_sum, own_kinds = g.own_part(n, k, weight)
        total = np.bincount(g.gram_ctx[n], weights=k)[g.ctx[n]] - own_sum
        kinds = np.bincount(g.gram_ctx[n], weights=k > 0)[g.ctx[n]] - own_kinds
        c = np.maximum(k[g.gram[n]] - own, 0.0)
        p = np.where(total > 0.5, (np.maximum(c - DISCOUNT, 0) + DISCOUNT * kinds * p) / np.maximum(total, 1), p)
    return np.maximum(p, 1e-12)


def trust(sentences_with: np.ndarray | float) -> np.ndarray | float:
    """How far an expression's evidence for abuse counts, by the abusive sentences that hold it."""
    return sentences_with / (sentences_with + SHRINK)


def _shared_unigram(g: _Grams, vocabulary: int) -> np.ndarray:
    """Kneser-Ney continuation probability of each word, over both classes: by the number of different words before it."""
    after = np.bincount(g.key[1][g.gram_at[2]], minlength=vocabulary).astype(float)
    total = after.sum()
    kinds = (after > 0).sum()
    return (np.maximum(after - DISCOUNT, 0) + DISCOUNT * kinds / vocabulary) / total


def train(docs: list[tuple[str, float]], rounds: int = 8) -> bytes:
    """The models as bytes, from texts with the share of raters that call them abusive."""
    cache: dict = {}
    vocab: dict[str, int] = {"<s>": 0, "</s>": 1, "<unk>": 2}
    sents, of_doc = [], []
    for k, (text, _) in enumerate(docs):
        for s in sentences(text, cache):
            sents.append([vocab.setdefault(w, len(vocab)) for w in s])
            of_doc.append(k)
    share = np.array([x for _, x in docs])
    if not sents or not (share > 0.5).any() or not (share < 0.5).any():
        return b""
    g = _Grams(sents, len(vocab))
    unigram = _shared_unigram(g, len(vocab))
    shared = unigram[g.key[1]]
    n = len(sents)
    doc_share = share[np.array(of_doc)]
    positive, negative = doc_share > 0.5, doc_share < 0.5
    odds = math.log(IN_POSITIVE / (1 - IN_POSITIVE))
    toxic_weight, plain_weight = positive.astype(float), negative.astype(float)
    for _ in range(rounds):
        wt, wo = toxic_weight[g.sentence], plain_weight[g.sentence]
        ratio = np.clip(np.log(_class_probability(g, wt, shared)) - np.log(_class_probability(g, wo, shared)), -CLIP, CLIP)
        seen = [g.sentences_with(order, wt)[g.gram[order]] - wt for order in (1, 2)]
        ratio = np.where(ratio > 0, ratio * trust(np.where(g.key[1] == 1, seen[1], seen[0])), ratio)
        llr = np.bincount(g.sentence, weights=ratio, minlength=n)
        # Only sentences that are surely abusive are kept, else common sentences stay at the prior for ever;
        # the undecided ones train neither class.
        total = odds + llr
        kept = (positive & (total > SURE)).astype(float)
        moved = np.abs(kept - toxic_weight).max()
        toxic_weight, plain_weight = kept, (negative | positive & (total < -SURE)).astype(float)
        if not moved:
            break
    model: dict = {"vocab": vocab, "unigram": unigram.astype(np.float64), "classes": []}
    for weight in (toxic_weight[g.sentence], plain_weight[g.sentence]):
        tables = []
        for order in (1, 2, 3):
            count = g.counts(order, weight)
            total = np.bincount(g.gram_ctx[order], weights=count)
            kinds = np.bincount(g.gram_ctx[order], weights=count > 0)
            keep = count > 0
            keys = g.key[order][g.gram_at[order]]
            first_ctx = np.unique(g.context[order], return_index=True)[1]
            ctx_keys = g.context[order][first_ctx]
            tables.append((dict(zip(keys[keep].tolist(), count[keep].tolist())), dict(zip(ctx_keys.tolist(), zip(total.tolist(), kinds.tolist())))))
        model["classes"].append(tables)
    model["toxic"] = []
    for order in (1, 2):
        held = g.sentences_with(order, toxic_weight[g.sentence])
        model["toxic"].append(dict(zip(g.key[order][g.gram_at[order]][held > 0].tolist(), held[held > 0].tolist())))
    return pickle.dumps(model, protocol=5)


class Scorer:
    def __init__(self, payload: bytes, cache_entries: int = 400_000):
        self.tokens: dict[str, tuple[list[int], bool]] = {}
        self.known: dict[int, float] = {}
        self.cache_entries = cache_entries
        self.model = pickle.loads(payload) if payload else None
        if self.model:
            self.vocab = self.model["vocab"]
            self.size = len(self.vocab)
            self.by_length: dict[int, list[str]] = {}
            self.toxic = self.model["toxic"]
            toxic = self.toxic[0]
            for w, k in self.vocab.items():
                if toxic.get(k, 0) > 0.5:
                    self.by_length.setdefault(len(w), []).append(w)

    def number(self, word: str) -> int:
        k = self.vocab.get(word)
        if k is None or "*" in word:
            k = 2
            if "*" in word:  # a masked letter stands for any
                mask = re.compile(re.escape(word).replace(r"\*", "."))
                k = next((self.vocab[w] for w in self.by_length.get(len(word), ()) if mask.fullmatch(w)), 2)
        return k

    def _probability(self, tables: list, w: int, v: int, u: int) -> float:
        size = self.size
        p = float(self.model["unigram"][w]) if w != 2 else 1.0 / size
        for (grams, contexts), key, ctx in zip(tables, (w, v * size + w, (u * size + v) * size + w), (0, v, u * size + v)):
            total, kinds = contexts.get(ctx, (0.0, 0.0))
            if total > 0.5:
                p = (max(grams.get(key, 0.0) - DISCOUNT, 0.0) + DISCOUNT * kinds * p) / total
        return max(p, 1e-12)

    def _evidence(self, w: int, v: int, u: int) -> float:
        size = self.size
        a, b = (self._probability(t, w, v, u) for t in self.model["classes"])
        d = min(max(math.log(a / b), -CLIP), CLIP)
        return d * trust(self.toxic[0].get(w, 0.0) if w != 1 else self.toxic[1].get(v * size + w, 0.0)) if d > 0 else d

    def sentence(self, numbers: list[int]) -> float:
        """Difference of the log-likelihoods of a sentence, its end included."""
        size, known = self.size, self.known
        total, context, v = 0.0, 0, 0  # context: u * size + v
        for w in numbers:
            d = known.get(context * size + w)
            if d is None:
                if len(known) >= self.cache_entries:
                    known.clear()
                d = known[context * size + w] = self._evidence(w, v, context // size)
            total += d
            context, v = v * size + w, w
        d = known.get(context * size + 1)
        if d is None:
            d = known[context * size + 1] = self._evidence(1, v, context // size)
        return total + d

    def sentences(self, text: str) -> Iterator[list[int]]:
        """As the module's ``sentences``, in numbers."""
        tokens = self.tokens
        for line in text.split("\n"):
            numbers: list[int] = []
            for token in line.split():
                known = tokens.get(token)
                if known is None:
                    words, ends = fold(token)
                    known = [self.number(w) for w in words], ends
                    if len(tokens) >= self.cache_entries:
                        tokens.clear()
                    if len(token) <= 64:
                        tokens[token] = known
                numbers += known[0]
                if known[1] and numbers:
                    yield numbers
                    numbers = []
            if numbers:
                yield numbers

    def text(self, text: str | None) -> tuple[float, float, int]:
        """Mean and sum of the worst sentence, and the number of abusive sentences."""
        if not text or not self.model:
            return 0.0, 0.0, 0
        worst, n = (-math.inf, 0.0, 0.0), 0
        for s in self.sentences(text):
            total = self.sentence(s)
            mean = total / (len(s) + 1)
            n += total > NEED and mean > LEAST_MEAN
            # Short sentences scatter more, so beyond the bound of the mean the sum decides which is worst.
            worst = max(worst, (min(mean, LEAST_MEAN), total, mean))
        return (worst[2], worst[1], n) if worst[0] > -math.inf else (0.0, 0.0, 0)


def class_bounds(held: dict[int, int], most: int) -> dict[int, int]:
    """How many documents of each class are taken: all that fit, else in proportion, but a tenth of ``most`` of each class that has so many."""
    total = sum(held.values())
    if total <= most:
        return held
    least = {c: min(n, max(1, most // 10)) for c, n in held.items()}
    spare, over = most - sum(least.values()), total - sum(least.values())
    wanted = {c: max(least[c], most * n // total) for c, n in held.items()}
    if sum(wanted.values()) <= most:
        return wanted
    return {c: least[c] + max(0, spare) * (n - least[c]) // over for c, n in held.items()}


def labelled_sample(documents: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS, max_bytes: int = MAX_BYTES) -> list[tuple[str, float]]:
    """Texts with the share of all their votes that call them abusive, however many documents hold the text: at most ``max_documents`` with ``max_bytes`` together."""
    documents, labels = settle_names(documents, ("doc_id", "text")), settle_names(labels, ("doc_id", "abusive"))
    votes = labels.where(F.col("abusive").isin(0, 1)).groupBy("doc_id").agg(F.sum("abusive").alias("yes"), F.count("*").alias("n"))
    # without the text, to be shuffled cheaply
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", F.md5("text").alias("same"), F.octet_length("text").alias("size")).distinct()
    one = texts.join(votes, "doc_id").groupBy("same").agg(F.min("doc_id").alias("doc_id"), (F.sum("yes") / F.sum("n")).alias("share"), F.max("size").alias("size"))
    known = cut_lineage(one.select("doc_id", "same", "share", "size", F.signum(F.col("share") - 0.5).cast("int").alias("kind")))
    held = {r["kind"]: r["n"] for r in known.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    bounds = class_bounds(held, max_documents)
    picked = []
    for kind, n in bounds.items():
        room = max_bytes * n // max(1, sum(bounds.values()))
        for r in known.where(F.col("kind") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", "same", "share", "size").collect():
            if r["size"] <= room:
                room -= r["size"]
                picked.append((r["doc_id"], r["same"], r["share"]))
    few = documents.sparkSession.createDataFrame(picked, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, same string, share double")
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", "text", F.md5("text").alias("same")).join(F.broadcast(few), ["doc_id", "same"]).groupBy("doc_id", "same").agg(F.first("text").alias("text"), F.first("share").alias("share")).collect()
    return [(r["text"], r["share"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["same"]))]


def score(documents: DataFrame, model: bytes, keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """``doc_id``, ``keep``, ``score``, ``evidence``, ``n_abusive``: one row per row of ``documents``, in a map."""
    documents = settle_names(documents, ("doc_id", *keep, "text"))
    shared = Shared(documents.sparkSession, Scorer, model)
    kinds = [f"k{i} {documents.schema[c].dataType.simpleString()}" for i, c in enumerate(("doc_id", *keep))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.get()
        for f in frames:
            scored = [s.text(t) for t in f["text"]]
            out = f.drop(columns="text")
            out["score"], out["evidence"], out["n_abusive"] = ([x[i] for x in scored] for i in range(3))
            yield out

    source = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(("doc_id", *keep))], "text")
    return source.mapInPandas(run, ", ".join(kinds) + ", score double, evidence double, n_abusive int").withColumnsRenamed({f"k{i}": c for i, c in enumerate(("doc_id", *keep))})


def fit(documents: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS) -> bytes:
    return train(labelled_sample(documents, labels, max_documents))


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, fit(documents, labels), keep=()).where(F.col("n_abusive") > 0).select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per source (null is one): documents, abusive ones, their share, and the mean score."""
    s = score(documents, fit(documents, labels))
    flag = (F.col("n_abusive") > 0).cast("int")
    return s.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(flag).alias("n_abusive"), F.round(F.avg(flag), 6).alias("abusive_share"), F.round(F.avg("score"), 6).alias("mean_score"))
