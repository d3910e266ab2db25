"""What the JVM has no expression for: Unicode forms, token cleaning, romanization. Arrow UDFs over whole batches."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _text_udf(f: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """Null stays null; each distinct value of a batch is computed once."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        codes, uniques = pd.factorize(s, use_na_sentinel=True)
        done = [f(u) for u in uniques] + [None]
        return pd.Series([done[c] for c in codes], dtype=object)

    return run


# What the repair of damaged text replaces.
CURLY = str.maketrans({"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"'})
_CONTROLS = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f﻿￹-￻]")
_DOUBLE_ENCODED = re.compile("[\xc2-\xf4][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]+")


def repair_text(s: str) -> str:
    """A stated subset of text repair: UTF-8 read as a Western code page is decoded again, control characters
    go, line ends become \\n, curly quotes straight, and the result is in NFC."""
    if _DOUBLE_ENCODED.search(s):
        for page in ("cp1252", "latin-1"):
            try:
                s = s.encode(page).decode("utf-8")
                break
            except UnicodeError:
                continue
    s = s.replace("\r\n", "\n").replace("\r", "\n").replace(" ", "\n").replace(" ", "\n").replace("\x85", "\n")
    return unicodedata.normalize("NFC", _CONTROLS.sub("", s).translate(CURLY))


repair = _text_udf(repair_text)
#: HTML character references, numeric and named, resolved once (what comes out is not looked at again).
resolved = _text_udf(lambda s: html.unescape(s) if "&" in s else s)
nfkc = _text_udf(lambda s: unicodedata.normalize("NFKC", s))
repaired_nfkc = _text_udf(lambda s: unicodedata.normalize("NFKC", repair_text(s)))

# Spellings of one topic.
SYNONYMS = {"training & facilitation": "training and facilitation", "t&f": "training and facilitation"}


def clean_token_text(s: str) -> str:
    """Case-folded, without combining marks, synonyms brought together."""
    t = unicodedata.normalize("NFKD", s.strip().casefold())
    t = "".join(ch for ch in t if not unicodedata.combining(ch))
    return SYNONYMS.get(t, t)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _clean_tokens(s: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def one(x: str) -> str:
        if x not in known:
            known[x] = clean_token_text(x)
        return known[x]

    return s.map(lambda v: None if v is None else [one(x) for x in v if x is not None and x.strip()])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _normal_tokens(s: pd.Series) -> pd.Series:
    def one(x: str) -> str:
        return unicodedata.normalize("NFKC", repair_text(x)).strip().lower()

    return s.map(lambda v: None if v is None else [t for t in map(one, v) if t])


def clean_tokens(values: Column) -> Column:
    return _clean_tokens(values)


def normal_tokens(values: Column) -> Column:
    return _normal_tokens(values)


# The Harvard-Kyoto letters of Devanagari, each sign with its romanization.
HK_VOWELS = dict(zip("अ आ इ ई उ ऊ ऋ ॠ ऌ ॡ ए ऐ ओ औ".split(), "a A i I u U R RR lR lRR e ai o au".split()))
HK_SIGNS = dict(zip("ा ि ी ु ू ृ ॄ ॢ ॣ े ै ो ौ".split(), "A i I u U R RR lR lRR e ai o au".split()))
HK_CONSONANTS = dict(
    zip(
        "क ख ग घ ङ च छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल व श ष स ह ळ".split(),
        "k kh g gh G c ch j jh J T Th D Dh N t th d dh n p ph b bh m y r l v z S s h L".split(),
    )
)
HK_MARKS = {"ं": "M", "ः": "H", "ँ": "~", "ऽ": "'", "।": "|", "॥": "||", "ॐ": "OM"} | {chr(0x966 + d): str(d) for d in range(10)}
_VIRAMA, _NUKTA = "्", "़"
# Noncharacters: the first stands for the vowel a consonant carries by itself, the second leads a sign that takes its place.
_OWN, _TAKEN = "\ufdd0", "\ufdd1"
_ROMAN = {**HK_VOWELS, **HK_MARKS, **{c: r + _OWN for c, r in HK_CONSONANTS.items()}, **{c: _TAKEN + r for c, r in HK_SIGNS.items()}, _VIRAMA: _TAKEN, _NUKTA: ""}
_ROMAN |= {c: _ROMAN[unicodedata.normalize("NFD", c)[0]] for c in map(chr, (0x929, 0x931, 0x934, *range(0x958, 0x960)))}
_ROMAN_TABLE = str.maketrans(_ROMAN)


def to_roman_text(s: str) -> str:
    """Devanagari to Harvard-Kyoto: a consonant carries ``a`` unless a vowel sign or a virama follows; nuktas go, other characters stay."""
    if s.isascii():
        return s
    return s.translate(_ROMAN_TABLE).replace(_OWN + _TAKEN, "").replace(_TAKEN, "").replace(_OWN, "a")


to_roman = _text_udf(to_roman_text)
