"""Text functions as expressions of the JVM: cleaning, normal forms, scripts, tokens, snippets.

White space means ASCII white space and all Unicode separators, spelled out so that no
expression depends on a regex flag.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\p{Z}\x{85}]"
NOT_WS = r"[^\s\p{Z}\x{85}]"


#: The characters of the class WS.
WS_CHARS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_all(c: Column) -> Column:
    return F.trim(c, F.lit(WS_CHARS))


def is_nullish(c: Column) -> Column:
    """Null, or nothing but white space."""
    return c.isNull() | (trim_all(c) == "")


def non_blank(c: Column) -> Column:
    """The value itself, or null where it is blank."""
    return F.when(~is_nullish(c), c)


def first_non_blank(*cs: Column, default: str = "") -> Column:
    return F.coalesce(*[non_blank(c) for c in cs], F.lit(default))


# The markup steps, each a pattern and what it becomes; they are tried in this order.
HTML_STEPS = (
    (r"(?is)<script.*?>.*?</script>", " "),
    (r"(?is)<style.*?>.*?</style>", " "),
    (r"\[[^\]]+\]", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<br\s*/?\s*>", " \n "),
    (r"(?is)<li(?:\s[^>]*)?>", " \n- "),
    (r"(?is)<(?:p|div|h[1-6])(?:\s[^>]*)?>", " \n\n "),
    (r"(?s)<[a-zA-Z/!][^>]*>", " "),
)


def collapse_space(c: Column) -> Column:
    """Line ends as \\n, runs of blanks as one space, three or more line ends as two, nothing at either end."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return trim_all(c)


#: A tag that is opened and never closed: what follows can't be told from the tag.
_UNCLOSED = r"(?s)<[a-zA-Z/!][^<>]*$"


def html_to_text(c: Column) -> Column:
    """Readable text of post markup: scripts, short codes, comments and tags gone, blocks as paragraphs, character references resolved once; null becomes ""."""
    from lekhspark.functions.unicode import resolved

    t = F.coalesce(c, F.lit(""))
    for pattern, to in HTML_STEPS:
        t = F.regexp_replace(t, pattern, to)
    return collapse_space(resolved(t))


def html_stats(c: Column, clean: Column | None = None) -> Column:
    """ok, reason and the lengths before and after; the null text counts as parsed, one that ends inside a tag doesn't."""
    clean = html_to_text(c) if clean is None else clean
    ok = ~F.coalesce(c.rlike(_UNCLOSED), F.lit(False))
    return F.struct(
        ok.alias("ok"), F.when(c.isNull(), "null").when(ok, "parsed").otherwise("unclosed tag").alias("reason"),
        F.coalesce(F.length(c), F.lit(0)).alias("original_len"), F.length(clean).alias("clean_len"),
    )


def strip_tags(c: Column) -> Column:
    """The fallback: every tag becomes a space."""
    return collapse_space(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<[^>]+>", " "))


def drop_joiners(c: Column) -> Column:
    return F.translate(c, "​‌‍﻿", "")


def space_marks(c: Column) -> Column:
    """No space before a mark of punctuation, one after it (inside addresses and numbers as well)."""
    c = F.regexp_replace(c, f"{WS}+([।,;:!?])", "$1")
    return F.regexp_replace(c, f"([।,;:!?])({NOT_WS})", "$1 $2")


def normal_text(c: Column) -> Column:
    """The normal form of a text that is composed already (see ``unicode.nfkc``); blank becomes null."""
    return F.when(~is_nullish(c), space_marks(collapse_space(drop_joiners(c))))


def script_stats(c: Column) -> Column:
    """Length and the shares of Devanagari and Latin characters; zeros for blank texts."""
    n = F.when(~is_nullish(c), F.length(c)).otherwise(0)
    part = lambda p: F.when(n > 0, F.regexp_count(c, F.lit(p)) / n).otherwise(F.lit(0.0))
    return F.struct(n.alias("len"), part(r"\p{IsDevanagari}").alias("dev_pct"), part(r"\p{IsLatin}").alias("latin_pct"))


def split_pipe(c: Column) -> Column:
    """Values between bars, trimmed, blank ones dropped; null gives none."""
    parts = F.filter(F.transform(F.split(c, r"\|"), trim_all), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def as_list(c: Column, is_array: bool) -> Column:
    """A list column as it is, a plain one as a list of its value; null gives the empty list."""
    return clean_list(c if is_array else F.when(c.isNotNull(), F.array(c.cast("string"))))


def clean_list(c: Column) -> Column:
    """The list without null and blank values; null gives the empty list."""
    return F.coalesce(F.filter(c, lambda x: ~is_nullish(x)), F.array().cast("array<string>"))


# The steps of the index normal form of romanized text; v becomes w before the last. A word is looked for by its letters first, since a boundary is tried at every character.
ROMAN_INDEX_STEPS = ((r"[^a-z0-9]+", " "), (r"([aiueo])\1+", "$1"), (r"yojna\b(?<=\byojna)", "yojana"))
# The steps of the gazetteer's normal form, which keeps doubled vowels.
ROMAN_LOOSE_STEPS = ((f"{WS}+", " "), (r"aa+", "aa"), (r"ee+", "ee"), (r"ii+", "ii"), (r"oo+", "oo"), (r"uu+", "uu"))


def roman_index(c: Column) -> Column:
    """Romanized text as it is indexed: spelling variants brought together; blank gives ""."""
    apart, doubled, variant = ROMAN_INDEX_STEPS
    t = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), *apart), *doubled)
    return F.trim(F.regexp_replace(F.replace(t, F.lit("v"), F.lit("w")), *variant))


def lower_spaced(c: Column) -> Column:
    return F.regexp_replace(F.lower(trim_all(F.coalesce(c, F.lit("")))), f"{WS}+", " ")


def roman_loose(c: Column) -> Column:
    t = F.lower(trim_all(F.coalesce(c, F.lit(""))))
    for pattern, to in ROMAN_LOOSE_STEPS:
        t = F.regexp_replace(t, pattern, to)
    return t


def query_mode(raw: Column, threshold: float = 0.02) -> Column:
    """``mixed`` where both scripts pass the threshold, ``dev`` where Devanagari does, else ``roman``."""
    s = script_stats(raw)
    dev, latin = s["dev_pct"] > threshold, s["latin_pct"] > threshold
    return F.when(dev & latin, "mixed").when(dev, "dev").otherwise("roman")


#: What separates tokens: all but letters, digits, underscores and the Devanagari block (danda included).
TOKEN_SPLIT = r"[^\p{L}\p{N}_\x{0900}-\x{097F}]+"


def tokens(c: Column) -> Column:
    """Lower-case tokens of two characters or more, in order, repeats kept."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), TOKEN_SPLIT), lambda x: F.length(x) >= 2)


def loose_tokens(c: Column) -> Column:
    return F.filter(F.split(lower_spaced(c), TOKEN_SPLIT), lambda x: F.length(x) >= 2)


def join_non_blank(*cs: Column, sep: str = "\n\n") -> Column:
    return F.concat_ws(sep, *[F.when(~is_nullish(c), trim_all(c)) for c in cs])


def paragraphs(c: Column) -> Column:
    """Parts between empty lines, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n\n"), trim_all), lambda x: x != "")


# Separators of the sentence split in their order, and those put back behind every part.
SENTENCE_SEPARATORS, KEPT_SEPARATORS = ("।", "?", "!", "\n", ";", ":"), ("।", "?", "!")


def sentence_parts(c: Column) -> Column:
    """Parts after splitting by each separator in turn; a text that a separator parts gets it behind every part."""
    text = trim_all(F.coalesce(c, F.lit("")))
    parts = F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))

    def by(parts: Column, sep: str) -> Column:
        def one(p: Column) -> Column:
            segs = F.filter(F.transform(F.split(p, rf"\Q{sep}\E"), trim_all), lambda s: s != "")
            tail = sep if sep in KEPT_SEPARATORS else ""
            return F.when(F.size(segs) <= 1, F.array(p)).otherwise(F.transform(segs, lambda s: F.concat(s, F.lit(tail))))

        return F.flatten(F.transform(parts, one))

    return F.filter(F.transform(reduce(by, SENTENCE_SEPARATORS, parts), trim_all), lambda s: s != "")


def words(c: Column) -> Column:
    """The default tokenizer for sizes: runs of non-white-space."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"{WS}+"), lambda x: x != "")


def count_words(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(f"{NOT_WS}+"))


class Tokenizer:
    """How sizes are measured: ``tokens`` gives the array of a text's tokens, ``count`` their number, ``join`` puts some of them together again.

    Any other set of functions of Columns can stand for the default, for instance Arrow UDFs over the vocabulary of a model.
    """

    def __init__(self, tokens=words, count=None, join=lambda ts: F.array_join(ts, " ")):
        self.tokens, self.join = tokens, join
        self.count = count or (lambda c: F.size(tokens(c)))


WORDS = Tokenizer(words, count_words)


def truncate_words(c: Column, n: int, tokenizer: Tokenizer = WORDS) -> Column:
    """text, was_truncated, tokens: the first ``n`` tokens where there are more, else the text."""
    w = tokenizer.tokens(c)
    over = F.size(w) > n
    return F.struct(F.when(over, tokenizer.join(F.slice(w, 1, n))).otherwise(F.coalesce(c, F.lit(""))).alias("text"), over.alias("was_truncated"), F.size(w).alias("tokens"))


def prefixed(c: Column, kind: str) -> Column:
    """The text as an embedding model takes it: ``query`` or ``passage``."""
    if kind not in ("query", "passage"):
        raise ValueError(f"unknown kind {kind!r}")
    return F.concat(F.lit(f"{kind}: "), trim_all(F.coalesce(c, F.lit(""))))


def stable_id(c: Column) -> Column:
    """An unsigned 64-bit number from the first half of the SHA-1, as decimal(20,0)."""
    return F.conv(F.substring(F.sha1(c), 1, 16), 16, 10).cast("decimal(20,0)")


def chunk_id(article_id: Column, index: Column) -> Column:
    return F.format_string("%s::c%04d", article_id, index)


def snippet(c: Column, chars: int = 420) -> Column:
    """One line of at most ``chars`` characters; null stays null, blank becomes null."""
    t = trim_all(F.regexp_replace(c, f"{WS}+", " "))
    return F.when(t != "", F.substring(t, 1, chars))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def column_alias(name: str) -> str:
    """A header in the form aliases are compared by."""
    import re

    return re.sub(r"[\s\-]+", "_", name.strip().lower())
