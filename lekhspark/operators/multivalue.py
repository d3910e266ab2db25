"""Several values packed in one field, taken apart with their positions.

A finite-state tokenizer reads a field once. Its states are: at the start of a value, in a bare value, in
a quoted value, and behind a closing quote; it counts the depth of closed brackets and
undoes doubled quotes, backslash escapes and HTML character references (a resolved reference is never a
delimiter or a quote). Delimiters count only outside quotes and brackets. A field in square brackets is a list.
Values of the gazetteer are recognised whole at the start of a value, even where they hold delimiters or quotes.
A slash separates only with white space beside it.

Defined cases: null and blank fields have no values; blank values are skipped and take no position; repeats
are kept; an unclosed quote or bracket is an ordinary character; an empty table gives no rows; other columns
are not read. Positions count from 1.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhspark.session import settle_names

# The signs that separate values.
DELIMITERS = "|;,،؛、·•\n\r\t¦│，；｜"
FIELDS = ("Categories", "Tags", "Locations", "Contributors")
_HINT = re.compile("[" + re.escape(DELIMITERS) + r"/\[]")
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_QUOTES = {'"': '"', "“": "”", "«": "»", "'": "'"}
_OPEN, _CLOSE = "([{", ")]}"
MAX_GAZETTEER = 200_000


class Tokenizer:
    """``protected``: values that are one even where they hold delimiters."""

    def __init__(self, protected: list[str] = ()):
        self.by_start: dict[str, list[str]] = {}
        for v in sorted({v.strip() for v in protected if v}, key=lambda v: -len(v)):
            if v and (any(c in v for c in DELIMITERS) or "/" in v or v[0] in _QUOTES or any(c in v for c in _OPEN)):
                self.by_start.setdefault(v[0], []).append(v)

    def values(self, field: str | None) -> list[str]:
        if field is None or not field.strip():
            return []
        if not _HINT.search(field):
            text = self._single(field)
            return [text] if text else []
        chars, literal = self._resolved(field)
        return self._scan(chars, literal)

    def _single(self, field: str) -> str:
        return self._clean(*self._resolved(field))

    @staticmethod
    def _resolved(field: str) -> tuple[str, list[bool] | None]:
        """The text with references resolved, and which characters came from one."""
        if "&" not in field or not _REFERENCE.search(field):
            return field, None
        out, literal, at = [], [], 0
        for m in _REFERENCE.finditer(field):
            plain = field[at : m.start()]
            sign = html.unescape(m.group())
            out += [plain, sign]
            literal += [False] * len(plain) + [sign != m.group()] * len(sign)
            at = m.end()
        out.append(field[at:])
        literal += [False] * (len(field) - at)
        return "".join(out), literal

    def _whole(self, s: str, i: int) -> str | None:
        """A protected value that starts at i and ends before a delimiter or the end."""
        for v in self.by_start.get(s[i], ()):
            if s.startswith(v, i):
                j = i + len(v)
                while j < len(s) and s[j].isspace() and s[j] not in DELIMITERS:
                    j += 1
                if j == len(s) or s[j] in DELIMITERS or s[j] in "/]":
                    return v
        return None

    def _quoted(self, s: str, i: int) -> tuple[str, int] | None:
        """A quoted value that opens at i: its text and the place behind its closing quote; None where it never closes."""
        close, buf, j = _QUOTES[s[i]], [], i + 1
        while j < len(s):
            c = s[j]
            if c == "\\" and j + 1 < len(s) and s[j + 1] in "\"'\\/":
                buf.append(s[j + 1])
                j += 2
            elif c == close:
                if s[j + 1 : j + 2] == close and close in "\"'":
                    buf.append(close)
                    j += 2
                else:
                    return "".join(buf), j + 1
            else:
                buf.append(c)
                j += 1
        return None

    def _scan(self, s: str, literal: list[bool] | None) -> list[str]:
        n = len(s)
        marked = (lambda i: literal[i]) if literal else (lambda i: False)
        first, last = 0, n
        bare = s.strip()
        if bare[:1] == "[" and bare[-1:] == "]":
            first, last = s.index("[") + 1, s.rindex("]")
        out: list[str] = []
        i = first

        def separates(j: int) -> bool:
            if marked(j):
                return False
            if s[j] == "/":
                return (j > 0 and s[j - 1].isspace()) or (j + 1 < last and s[j + 1].isspace())
            return s[j] in DELIMITERS

        while i < last:
            if s[i].isspace() or separates(i):
                i += 1
                continue
            if (v := self._whole(s[:last], i)) is not None:
                out.append(v)
                i += len(v)
                continue
            if s[i] in _QUOTES and not marked(i) and (q := self._quoted(s[:last], i)):
                text, j = q
                k = j
                while k < last and s[k].isspace() and not separates(k):
                    k += 1
                if k >= last or separates(k):
                    if text.strip():
                        out.append(text.strip())
                    i = k
                    continue
            j, depth = i, 0
            while j < last and (depth or not separates(j)):
                if s[j] in _OPEN and not marked(j):
                    depth += _CLOSE[_OPEN.index(s[j])] in s[j + 1 : last]
                elif s[j] in _CLOSE and depth and not marked(j):
                    depth -= 1
                j += 1
            text = self._clean(s[i:j], None)
            if text:
                out.append(text)
            i = j
        return out

    def _clean(self, text: str, _literal: list[bool] | None = None) -> str:
        """Without white space and quotes around it."""
        t = text.strip()
        if t and self._whole(t, 0) == t:
            return t
        while len(t) > 1 and t[0] in _QUOTES and (q := self._quoted(t, 0)) and q[1] == len(t):
            t = q[0].strip()
        return t


def gazetteer_values(gazetteer: DataFrame, limit: int = MAX_GAZETTEER) -> dict[str, list[str]]:
    """Values by field in lower case, for the tokenizer: only those that hold a sign it acts on, all others need no protection. Refuses more than ``limit`` of these."""
    signs = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in {*DELIMITERS, *_QUOTES, *_OPEN, "/"}) + "]"
    rows = gazetteer.where(F.col("value").rlike(signs)).select("field", "value").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} gazetteer values that hold delimiters, quotes or brackets")
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault((r["field"] or "").lower(), []).append(r["value"])
    return out


def explode_values(df: DataFrame, gazetteer: DataFrame | None = None, key_col: str = "src_row", fields: tuple[str, ...] = FIELDS, least: int = 1) -> DataFrame:
    """``key_col, field, pos, value`` of every field with ``least`` values or more; a map without any shuffle."""
    protected = gazetteer_values(gazetteer) if gazetteer is not None else {}
    df = settle_names(df, (key_col, *fields))
    kind = df.schema[key_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizers = [Tokenizer(protected.get(f.lower(), ())) for f in fields]
        for frame in frames:
            out = []
            keys = frame["key"].tolist()
            for i, (f, t) in enumerate(zip(fields, tokenizers)):
                for key, text in zip(keys, frame[f"f{i}"]):
                    values = t.values(text)
                    if len(values) >= least:
                        out += [(key, f, p, v) for p, v in enumerate(values, 1)]
            yield pd.DataFrame(out, columns=["key", "field", "pos", "value"])

    source = df.select(F.col(key_col).alias("key"), *[F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return source.mapInPandas(run, f"key {kind}, field string, pos int, value string").withColumnRenamed("key", key_col)


def found(articles: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Values of fields that hold two or more, of rows that aren't structurally damaged."""
    from lekhspark.operators import rejects

    checked = rejects.check_rows(articles)
    sound = checked.where(~F.coalesce(rejects.reason(F.col("errors")).isin("columns", "quoting"), F.lit(False)))
    return explode_values(sound, gazetteer, least=2).select(F.col("src_row").cast("long").alias("src_row"), "field", "pos", "value").distinct()
