"""One plain form for text that looks the same but differs in its characters.

A batch of Arrow text becomes one numpy array of code points with row offsets. Then, all by
whole-array steps:

1. gathers: every code point is replaced by its compatibility decomposition through a table
   of lengths and offsets; invisible characters have length 0, spaces become ``U+0020``;
2. runs of combining marks are put in canonical order by one stable sort;
3. pairs of starter and mark are composed, first unblocked mark of every starter at once,
   until nothing composes (canonical composition, so the result so far is NFKC);
4. letters spelled as two where one of the same look exists become one;
5. words (runs of letters, marks and digits) whose letters are Latin, or only look Latin,
   get Latin letters; Urdu words get Urdu letters; a bar after Devanagari or Bengali
   text becomes a danda; a colon inside such a word, or closing a word known to end so,
   becomes a visarga.

Rows without anything a step could act on are told apart beforehand and kept as they are.
No string method runs per row; the result goes back to Arrow by offsets as well.

Defined cases: null stays null, empty stays empty; line breaks stay, ``\\r\\n`` and ``\\r`` become
``\\n``; runs of ordinary spaces and letter case stay. The form is its own plain form.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhspark.llm.arrow import sliced
from lekhspark.session import settle_names

# Letters that look like a Latin letter, by script, each with that letter.
LATIN_LOOKALIKES = {
    "cyrillic": "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT ХX УY ЗZ ԌG ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv ѴV ӏl ҮY Ӏl",
    "greek": "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa οo νv ρp ιi υu κk ϳj",
    "other": "ɑa ɡg ıi ǀl ߀O օo ԍg ѡw Ꭺa ᎪA ᏴB ᏟC ᎠD ᎬE ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ",
}

# Arabic letters and the Urdu letter of the same look (isolated or final form).
URDU_LETTERS = {"ي": "ی", "ى": "ی", "ك": "ک", "ه": "ہ", "ڪ": "ک", "ە": "ہ", "ې": "ی"}
URDU_LETTERS |= {chr(0x660 + d): chr(0x6F0 + d) for d in range(10)}

# Vowel letters spelled as two signs, and the one letter of the same look.
VOWEL_PAIRS = {
    "अा": "आ", "अो": "ओ", "अौ": "औ", "अॉ": "ऑ", "अॅ": "ॲ", "आे": "ओ", "आै": "औ", "आॅ": "ऑ", "एे": "ऐ", "एॅ": "ऍ",
    "ाे": "ो", "ाै": "ौ", "ाॅ": "ॉ", "ेे": "ै", "ॅा": "ॉ", "ेा": "ो", "ैा": "ौ", "उु": "ऊ",
    "অা": "আ", "ঋৃ": "ৠ",
}
#: The letter that looks like RA, virama and I.
RA_VIRAMA_I, LETTER_II = (0x930, 0x94D, 0x907), 0x908

# Words that end in visarga or hold it, given without it; only at a word's end the colon is ambiguous.
VISARGA_WORDS = "अत प्राय पुन स्वत संभवत सम्भवत अंतत अन्तत मूलत विशेषत सामान्यत क्रमश फलत वस्तुत पूर्णत मुख्यत अधिकांशत सर्वत प्रथमत शब्दश अक्षरश अंशत साधारणत सम्पूर्णत संपूर्णत निष्कर्षत परिणामत प्रात नम शनै तत इत".split()

# Format characters that are visible.
VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
# Characters without a look that are no format characters.
INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x2800, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
BARS, DANDA, COLON, VISARGA, SPACE, NEWLINE, RETURN = "|ǀ∣│❘", 0x964, 0x3A, 0x903, 0x20, 0x0A, 0x0D

LATIN, LOOKS_LATIN, DEVANAGARI, BENGALI, ARABIC, OTHER_LETTER = 1, 2, 4, 8, 16, 32


class Tables:
    """Lookup tables by code point, built once per Python worker."""

    def __init__(self):
        size = sys.maxunicode + 1
        self.length = np.ones(size, np.uint8)
        self.offset = np.full(size, -1, np.int64)  # into pool; -1: the character itself
        self.ccc = np.zeros(size, np.uint8)
        self.kind = np.zeros(size, np.uint8)
        self.word = np.zeros(size, bool)
        pool: list[int] = []
        pairs: dict[int, int] = {}
        for cp in range(size):
            ch = chr(cp)
            cat = unicodedata.category(ch)
            if cat in ("Cn", "Cs", "Co"):
                continue
            blank = cat == "Cc" and cp in (9, 11, 12, 0x85)
            if cp in INVISIBLE or cat == "Cf" and cp not in VISIBLE_FORMAT or cat == "Cc" and not blank and cp not in (NEWLINE, RETURN):
                self.length[cp] = 0
                continue
            full = " " if cat == "Zs" or blank else "\n" if cat in ("Zl", "Zp") else unicodedata.normalize("NFKD", ch)
            if full != ch:
                seq = [ord(c) for c in full if ord(c) not in INVISIBLE]
                self.offset[cp], self.length[cp] = len(pool), len(seq)
                pool += seq
            self.ccc[cp] = unicodedata.combining(ch)
            self.word[cp] = cat[0] in "LMN"
            if cat[0] == "L":
                self.kind[cp] = OTHER_LETTER
            canon = unicodedata.decomposition(ch)
            if " " in canon and canon[0] != "<" and unicodedata.normalize("NFC", ch) == ch:
                x, y = (int(v, 16) for v in canon.split())
                pairs[x << 21 | y] = cp
        for s in range(0xAC00, 0xD7A4):  # Hangul syllables compose by rule
            lv, t = divmod(s - 0xAC00, 28)
            first, second = (0xAC00 + lv * 28, 0x11A7 + t) if t else (0x1100 + lv // 21, 0x1161 + lv % 21)
            pairs[first << 21 | second] = s
        self.pool = np.array(pool, np.uint32)
        self.pair_keys, self.pair_to = _sorted_pairs(pairs)
        self.vowel_keys, self.vowel_to = _sorted_pairs({ord(k[0]) << 21 | ord(k[1]): ord(x) for k, x in VOWEL_PAIRS.items()})
        letters = np.flatnonzero(self.kind == OTHER_LETTER)
        self.kind[letters[(letters < 0x250) | (letters >= 0x1E00) & (letters < 0x1F00)]] = LATIN
        self.kind[letters[(letters >= 0x600) & (letters < 0x700)]] = ARABIC
        self.kind[0x900:0x964] = self.kind[0x970:0x980] = DEVANAGARI
        self.kind[0x980:0x9E6] = BENGALI
        self.to_latin = np.arange(size, dtype=np.uint32)
        for x, y in (w for group in LATIN_LOOKALIKES.values() for w in group.split()):
            self.to_latin[ord(x)] = ord(y)
            self.kind[ord(x)] = LOOKS_LATIN
        self.to_urdu = np.arange(size, dtype=np.uint32)
        for x, y in URDU_LETTERS.items():
            self.to_urdu[ord(x)] = ord(y)
        self.bar = np.zeros(size, bool)
        self.bar[[ord(c) for c in BARS]] = True
        stable = [unicodedata.normalize("NFKC", chr(c)) == chr(c) != unicodedata.normalize("NFD", chr(c)) for c in np.flatnonzero(self.offset >= 0).tolist()]
        self.composed = self.offset >= 0
        self.composed[np.flatnonzero(self.composed)[~np.array(stable)]] = False
        self.loud = ((self.length != 1) | (self.offset >= 0)) & ~self.composed | self.bar | (self.kind == LOOKS_LATIN) | (self.to_urdu != np.arange(size))
        self.loud[[RETURN, COLON]] = True
        self.second = np.zeros(size, bool)
        self.second[(np.concatenate([self.pair_keys, self.vowel_keys]) & 0x1FFFFF)] = True
        self.second[RA_VIRAMA_I[2]] = True
        self.visarga_words = np.array(sorted(int(_word_hashes(_points(w), np.array([0]))[0]) for w in VISARGA_WORDS), np.uint64)


def _sorted_pairs(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array(sorted(pairs), np.int64)
    return keys, np.array([pairs[k] for k in keys.tolist()], np.uint32)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _paired(keys: np.ndarray, to: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What the pairs become; 0 where they don't combine."""
    want = left.astype(np.int64) << 21 | right.astype(np.int64)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, to[at], 0).astype(np.uint32)


_STEP = np.uint64(0x100000001B3)


def _word_hashes(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each stretch that begins at ``starts`` (the last one runs to the end)."""
    lengths = np.diff(np.append(starts, len(cps)))
    place = (np.arange(len(cps)) - np.repeat(starts, lengths)).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (cps.astype(np.uint64) + np.uint64(0x9E3779B9)) * (place * _STEP + np.uint64(0x2545F4914F6CDD1D))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return np.add.reduceat(x, starts)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def _decompose(cps: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    returns = cps == RETURN
    if returns.any():
        before_newline = np.zeros(len(cps), bool)
        before_newline[:-1] = returns[:-1] & (cps[1:] == NEWLINE) & (row[1:] == row[:-1])
        cps = np.where(returns, np.uint32(NEWLINE), cps)[~before_newline]
        row = row[~before_newline]
    length, offset = t.length[cps], t.offset[cps]
    if (length == 1).all() and (offset < 0).all():
        return cps, row
    out = np.repeat(cps, length)
    start = np.cumsum(length, dtype=np.int64) - length
    place = np.arange(len(out)) - np.repeat(start, length)
    source = np.repeat(offset, length)
    mapped = source >= 0
    out[mapped] = t.pool[source[mapped] + place[mapped]]
    return out, np.repeat(row, length)


def _reorder(cps: np.ndarray, row: np.ndarray, t: Tables) -> np.ndarray:
    """Combining marks of one run in the order of their classes; equal classes keep their order."""
    ccc = t.ccc[cps]
    wrong = (ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (row[1:] == row[:-1])
    if not wrong.any():
        return cps
    run = np.cumsum((ccc == 0) | np.append(True, row[1:] != row[:-1]))
    return cps[np.lexsort((ccc, run))]


def _compose(cps: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    original = np.arange(len(cps))
    last = np.full(len(cps), -1, np.int64)  # of a starter: the mark composed into it last
    while len(cps) > 1:
        ccc = t.ccc[cps]
        new_row = np.append(True, row[1:] != row[:-1])
        is_starter = (ccc == 0) | new_row
        starter = np.maximum.accumulate(np.where(is_starter, np.arange(len(cps)), 0))
        prev_ccc = np.append(0, ccc[:-1])
        prev = np.append(0, starter[:-1])  # the starter that governs what stands before
        head = np.where(ccc == 0, prev, starter)
        adjacent = np.arange(len(cps)) == head + 1
        free = ~new_row & (adjacent | (ccc > 0) & (prev_ccc < ccc) & (prev_ccc > 0)) & (ccc[head] == 0)
        at = np.flatnonzero(free & t.second[cps] & (original > last[original[head]]))
        if not len(at):
            break
        made = _paired(t.pair_keys, t.pair_to, cps[head[at]], cps[at])
        hit = at[made > 0]
        if not len(hit):
            break
        _, one = np.unique(head[hit], return_index=True)
        hit, to = hit[one], made[made > 0][one]
        # A starter that is itself taken in by the one before waits for the next pass.
        taken = np.zeros(len(cps), bool)
        taken[hit] = True
        ok = ~taken[head[hit]]
        hit, to = hit[ok], to[ok]
        cps = cps.copy()
        cps[head[hit]] = to
        last[original[head[hit]]] = original[hit]
        keep = np.ones(len(cps), bool)
        keep[hit] = False
        cps, row, original = cps[keep], row[keep], original[keep]
    return cps, row


def _join_vowels(cps: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    while len(cps) > 1:
        made = np.append(_paired(t.vowel_keys, t.vowel_to, cps[:-1], cps[1:]), np.uint32(0))
        made[:-1][row[1:] != row[:-1]] = 0
        made[1:][made[:-1] > 0] = 0
        hit = np.flatnonzero(made)
        three = np.zeros(len(cps), bool)
        if len(cps) > 2:
            three[:-2] = (cps[:-2] == RA_VIRAMA_I[0]) & (cps[1:-1] == RA_VIRAMA_I[1]) & (cps[2:] == RA_VIRAMA_I[2]) & (row[:-2] == row[2:])
        if not len(hit) and not three.any():
            break
        cps, keep = cps.copy(), np.ones(len(cps), bool)
        cps[hit] = made[hit]
        keep[hit + 1] = False
        cps[three] = LETTER_II
        at = np.flatnonzero(three)
        keep[at + 1] = keep[at + 2] = False
        cps, row = cps[keep], row[keep]
    return cps, row


def _by_language(cps: np.ndarray, row: np.ndarray, t: Tables) -> np.ndarray:
    kind = t.kind[cps]
    word = t.word[cps]
    edge = np.append(True, (word[1:] != word[:-1]) | (row[1:] != row[:-1]))
    # Words of two scripts written together part where the script changes; digits go with what stands before.
    group = np.where(kind & (LATIN | LOOKS_LATIN | OTHER_LETTER) > 0, 1, np.where(kind > 0, 2, 0))
    known = np.maximum.accumulate(np.where(group > 0, np.arange(len(cps)), 0))
    before = np.append(0, group[known][:-1])
    edge |= word & (group > 0) & (before > 0) & (before != group)
    starts = np.flatnonzero(edge)
    lengths = np.diff(np.append(starts, len(cps)))
    holds = np.bitwise_or.reduceat(np.where(word, kind, 0), starts)
    out = cps
    alike = (holds & LOOKS_LATIN > 0) & (holds & ~np.uint8(LATIN | LOOKS_LATIN) == 0)
    if alike.any():
        out = np.where(np.repeat(alike, lengths), t.to_latin[out], out)
    urdu = holds & ARABIC > 0
    if urdu.any():
        out = np.where(np.repeat(urdu, lengths), t.to_urdu[out], out)
    indic = kind & (DEVANAGARI | BENGALI) > 0
    bars = np.flatnonzero(t.bar[cps])
    if len(bars):
        visible = np.where((cps != SPACE) & (cps != NEWLINE), np.arange(len(cps)), -1)
        before = np.append(-1, np.maximum.accumulate(visible)[:-1])[bars]
        digit = (cps[before] >= 0x30) & (cps[before] <= 0x39) | (cps[before] >= 0x966) & (cps[before] < 0x970)
        row_indic = np.zeros(int(row[-1]) + 1, bool)
        row_indic[row[indic]] = True
        closes = (before >= 0) & (row[before] == row[bars]) & (indic[before] | (digit | np.isin(cps[before], _CLOSERS)) & row_indic[row[bars]])
        out = out.copy() if out is cps else out
        out[bars[closes]] = DANDA
    colons = np.flatnonzero(cps == COLON)
    colons = colons[(colons > 0)]
    colons = colons[indic[colons - 1] & (row[colons - 1] == row[colons])]
    if len(colons):
        nxt = np.minimum(colons + 1, len(cps) - 1)
        inside = (nxt > colons) & (row[nxt] == row[colons]) & (kind[nxt] & (DEVANAGARI | BENGALI) > 0)
        own = np.searchsorted(starts, colons, side="right") - 2  # the word before
        known = np.isin(_word_hashes(cps, starts)[own], t.visarga_words)
        out = out.copy() if out is cps else out
        out[colons[inside | known]] = VISARGA
    return out


_CLOSERS = np.array([ord(c) for c in "\"')]”’%"], np.uint32)


def plain_points(cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and the ascending row number of each, in plain form."""
    t = tables()
    if not len(cps):
        return cps, row
    cps, row = _decompose(cps, row, t)
    # Look-alike letters may bring further pairs together. Every round but the last shortens the text or moves a
    # character one step along tables that hold no cycle (a look-alike becomes a Latin letter, an Arabic letter an Urdu one,
    # a bar or colon a sign of no table), or sorts marks that such a step has brought together; so it ends.
    while len(cps):
        before = cps
        cps = _reorder(cps, row, t)
        cps, row = _compose(cps, row, t)
        cps, row = _join_vowels(cps, row, t)
        cps = _by_language(cps, row, t)
        if len(cps) == len(before) and (cps == before).all():
            break
    return cps, row


def _suspects(cps: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Rows that might not be in plain form; all others are, by the absence of anything a step acts on."""
    t = tables()
    odd = t.loud[cps]
    ccc, second = t.ccc[cps], t.second[cps]
    odd[1:] |= (ccc[:-1] > 0) & (ccc[1:] > 0) & ((ccc[:-1] > ccc[1:]) | second[1:])
    odd[1:] |= t.composed[cps[:-1]] & (ccc[1:] > 0)
    at = np.flatnonzero(second)
    at = at[at > 0]
    left, right = cps[at - 1], cps[at]
    odd[at] |= (_paired(t.pair_keys, t.pair_to, left, right) > 0) | (_paired(t.vowel_keys, t.vowel_to, left, right) > 0) | (left == RA_VIRAMA_I[1]) & (right == RA_VIRAMA_I[2])
    out = np.zeros(n, bool)
    out[row[odd]] = True
    return out


def _to_points(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the array, and the row of each; one decoding for the whole batch."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    cps = _points(raw.tobytes().decode("utf-8", "replace"))
    first = np.append(0, np.cumsum(raw & 0xC0 != 0x80))  # characters before each byte
    return cps, np.repeat(np.arange(len(texts)), np.diff(first[offsets - offsets[0]]))


def _from_points(cps: np.ndarray, row: np.ndarray, n: int, null: np.ndarray) -> pa.Array:
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode()
    width = 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)
    ends = np.append(0, np.cumsum(np.bincount(row, weights=width, minlength=n).astype(np.int64)))
    valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()) if null.any() else None
    if ends[-1] < 2**31:
        return pa.StringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data), valid)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(data), valid)


def plain_array(texts: pa.Array) -> pa.Array:
    """The plain form of a string array; only rows that a step could act on go through the steps."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return texts
    null = texts.is_null().to_numpy(zero_copy_only=False)
    filled = texts.fill_null("") if null.any() else texts
    cps, row = _to_points(filled)
    odd = _suspects(cps, row, len(texts))
    if not odd.any():
        return texts
    few = filled.filter(pa.array(odd))
    some = _from_points(*plain_points(*_to_points(few)), len(few), np.zeros(len(few), bool))
    return pc.replace_with_mask(texts, pa.array(odd), some.cast(texts.type))


def plain_columns(df: DataFrame, key_col: str, *text_cols: str) -> DataFrame:
    """``row_key, field, text, plain``: one row per row and column of ``df``, in one map."""
    names = list(text_cols)
    df = settle_names(df, (key_col, *names))
    source = df.select(F.col(key_col).cast("string").alias("k"), *[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, name in enumerate(names):
                for b in sliced([whole.select(["k", f"t{i}"])], f"t{i}", 4 << 20):
                    text = b.column(1)
                    plain = plain_array(text)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * b.num_rows, pa.string()), text, plain.cast(text.type)], names=["row_key", "field", "text", "plain"])

    return source.mapInArrow(run, "row_key string, field string, text string, plain string")


def found(articles: DataFrame, query_log: DataFrame) -> DataFrame:
    """Values that aren't in plain form: ``src, row_key, field``, each once."""
    parts = [
        plain_columns(df, key, *cols).where(F.col("text") != F.col("plain")).select(F.lit(src).alias("src"), "row_key", "field")
        for src, df, key, cols in (("articles_canonical", articles, "id", ("title_hi", "content_hi")), ("query_log", query_log, "id", ("query_raw",)))
    ]
    return parts[0].unionByName(parts[1]).distinct()
