"""Building the gazetteer and finding its values in queries.

Detection goes through a query once: substrings whose length some value has are looked up, then tokens are. The
gazetteer is broadcast behind a check of its size. Distinct queries are computed once however often they repeat.

Defined cases: blank queries match nothing; null values are left out; an empty gazetteer gives no matches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhspark.functions import text
from lekhspark.functions.unicode import to_roman_text
from lekhspark.session import cut_lineage
from lekhspark.sources.upsert import next_ids

MAX_VALUES, PER_FIELD = 500_000, 3
# Fields in their order, whether single tokens count, and the confidence from which they filter.
FIELD_RULES = (("locations", True, 1), ("contributors", False, 2), ("categories", True, 4), ("tags", True, 4))


def build(canon: DataFrame, fields: tuple[str, ...] = ("locations_norm", "categories_norm", "tags_norm", "contributors_norm")) -> DataFrame:
    """``field, ord, value, value_roman``: distinct values of each list, longest first, then by code points."""
    parts = []
    for f in fields:
        v = canon.select(F.explode(f).alias("v")).select(text.trim_all(F.col("v")).alias("value")).where((F.col("value") != "") & F.col("value").isNotNull()).distinct()
        parts.append(v.select(F.lit(f.removesuffix("_norm")).alias("field"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # Numbered by range partitions over all fields, then from each field's first number, so no task sorts a whole field.
    numbered = cut_lineage(next_ids(out, "_n", -1, [F.col("field"), -F.length("value"), F.col("value")]))
    first = numbered.groupBy("field").agg(F.min("_n").alias("_first"))
    return numbered.join(F.broadcast(first), "field").select("field", (F.col("_n") - F.col("_first")).cast("int").alias("ord"), "value", text.roman_loose(F.col("value")).alias("value_roman"))


def _spaced(s: str) -> str:
    return " ".join(s.lower().split())


def _roman(s: str) -> str:
    """The loose roman form (``text.roman_loose``): doubled vowels stay double, longer runs become double."""
    return re.sub(r"([aeiou])\1+", r"\1\1", _spaced(s))


def _tokens(s: str) -> set[str]:
    return {t for t in regex.split(r"[^\p{L}\p{N}_ऀ-ॿ]+", s) if len(t) >= 2}


class Detector:
    def __init__(self, rows: list[tuple[str, int, str, str]], per_field: int = PER_FIELD):
        self.per_field = per_field
        self.values: dict[str, dict[int, str]] = {}
        self.phrases: dict[str, dict[str, list[int]]] = {}
        self.roman: dict[str, dict[str, list[int]]] = {}
        self.tokens: dict[str, dict[str, list[int]]] = {}
        self.roman_tokens: dict[str, dict[str, list[int]]] = {}
        self.first: dict[str, dict[str, int]] = {}
        for field, at, value, roman in rows:
            self.values.setdefault(field, {})[at] = value
            for table, keys in ((self.phrases, [_spaced(value)]), (self.roman, [roman or _roman(value)]), (self.tokens, _tokens(_spaced(value))), (self.roman_tokens, _tokens(_roman(value)))):
                for k in keys:
                    if k:
                        table.setdefault(field, {}).setdefault(k, []).append(at)
        self.lengths = {f: sorted({len(k) for k in d}) for f, d in self.phrases.items()}
        self.roman_lengths = {f: sorted({len(k) for k in d}) for f, d in self.roman.items()}

    @staticmethod
    def _inside(q: str, table: dict[str, list[int]], lengths: list[int]) -> set[int]:
        out: set[int] = set()
        for n in lengths:
            if n > len(q):
                break
            for i in range(len(q) - n + 1):
                if hit := table.get(q[i : i + n]):
                    out.update(hit)
        return out

    def detect(self, query: str, mode: str) -> list[tuple[str, int, int, str, int]]:
        """field, pass, order, value, points: per field the first values by pass and gazetteer order."""
        q = _spaced(query or "")
        if not q:
            return []
        words = _tokens(q)
        loose = _roman(q) if mode != "dev" else ""
        romanized = _roman(to_roman_text(q)) if mode == "dev" else ""
        out = []
        for field, by_token, _ in FIELD_RULES:
            if field not in self.values:
                continue
            best = {a: 1 for a in self._inside(q, self.phrases[field], self.lengths[field])}
            if mode != "dev":
                for a in self._inside(loose, self.roman.get(field, {}), self.roman_lengths.get(field, [])):
                    best.setdefault(a, 1)
            if by_token:
                for step, ws, table in ((2, words, self.tokens), (3, _tokens(romanized), self.roman_tokens)):
                    for w in ws:
                        for a in table.get(field, {}).get(w, ()):
                            best.setdefault(a, step)
            for a, step in sorted(best.items(), key=lambda x: (x[1], x[0]))[: self.per_field]:
                out.append((field, step, a, self.values[field][a], 2 if step == 1 else 1))
        return out


def detectors(gazetteer: DataFrame, most: int = MAX_VALUES) -> list[Detector]:
    """One for each block of about ``most`` values."""
    rows = gazetteer.where(F.col("value").isNotNull()).select("field", "ord", "value", "value_roman")
    n = max(1, math.ceil(rows.count() / most))
    blocks = [rows if n == 1 else rows.where(F.pmod(F.xxhash64("field", "ord"), F.lit(n)) == b) for b in range(n)]
    return [Detector(sorted((r["field"], r["ord"], r["value"], r["value_roman"]) for r in block.collect())) for block in blocks]


MATCH_SCHEMA = "query string, mode string, field string, step int, value string, points int"


def detect(queries: DataFrame, gazetteer: DataFrame, query_col: str = "query_used", mode_col: str = "query_mode", most: int = MAX_VALUES) -> DataFrame:
    """MATCH_SCHEMA: the matched values of every distinct query. A gazetteer of more than ``most`` values is gone through in blocks whose best are brought together."""
    source = queries.select(F.col(query_col).alias("query"), F.col(mode_col).alias("mode")).where(F.col("query").isNotNull()).distinct()
    schema = MATCH_SCHEMA.replace("step int,", "step int, ord int,")

    def one(d: Detector) -> DataFrame:
        shared = queries.sparkSession.sparkContext.broadcast(d)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            det = shared.value
            for f in frames:
                out = [(q, m, *hit) for q, m in zip(f["query"], f["mode"]) for hit in det.detect(q, m)]
                yield pd.DataFrame(out, columns=["query", "mode", "field", "step", "ord", "value", "points"])

        return source.mapInPandas(run, schema)

    parts = [one(d) for d in detectors(gazetteer, most)]
    if len(parts) > 1:
        w = Window.partitionBy("query", "mode", "field").orderBy("step", "ord")  # PER_FIELD rows of each block at most
        parts = [reduce(DataFrame.unionByName, parts).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= PER_FIELD).drop("_n")]
    return parts[0].drop("ord")


def confidence(matches: DataFrame) -> DataFrame:
    """``query, mode, field, confidence, matched``: points and values (in order) by query and field."""
    ordered = F.array_sort(F.collect_list(F.struct("step", F.col("value"))))  # three values at most
    return matches.groupBy("query", "mode", "field").agg(F.sum("points").cast("int").alias("confidence"), F.transform(ordered, lambda x: x["value"]).alias("matched"))


def _literal(v: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(v, F.lit("`"), F.lit("\\`")), F.lit("`"))


def auto_filter(conf: DataFrame) -> DataFrame:
    """``query, mode, filter_by``: the filter that surely matched fields make; null where none does."""
    rules = [F.when((F.col("field") == f) & (F.col("confidence") >= least), F.lit(i)) for i, (f, _, least) in enumerate(FIELD_RULES)]
    clause = F.concat(F.col("field"), F.lit("_norm:=["), F.array_join(F.transform("matched", _literal), ","), F.lit("]"))
    ranked = conf.withColumn("_o", F.coalesce(*rules)).withColumn("_c", clause)
    parts = F.array_sort(F.collect_list(F.when(F.col("_o").isNotNull(), F.struct(F.col("_o").alias("o"), F.col("_c").alias("c")))))  # four fields at most
    return ranked.groupBy("query", "mode").agg(parts.alias("p")).select("query", "mode", F.when(F.size("p") > 0, F.array_join(F.transform("p", lambda x: x["c"]), " && ")).alias("filter_by"))
