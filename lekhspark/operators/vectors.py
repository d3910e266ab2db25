"""Vector search for a table of queries, exact or by an index, the vector collections, and the default embedding.

Each batch of vectors meets the query matrix (broadcast in blocks of about ``BLOCK`` queries; the driver holds one block at a time) in matrix products; each task keeps
the best ``k`` of all its batches for each query, and only those are shuffled, once, and merged. Tasks are as many as two for each core, so what is shuffled grows with queries, not with vectors.

An index parts the vectors into cells, each around a landmark (spherical k-means on a bounded sample); their number grows with the square root of the
rows. A query visits the ``probes`` cells whose landmarks respond most, so of an index stored by cell only those folders are read. The exact
way compares all rows.

Defined cases: null, all-zero and non-finite vectors and those of another dimension than the query are skipped; repeated keys count once;
ties are broken by key; fewer than ``k`` vectors give fewer hits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekhspark.functions import text
from lekhspark.session import cut_lineage, settle_names

#: Queries broadcast together and multiplied together, vectors they meet at once, and hits a task holds before it drops those behind the best.
BLOCK, CHUNK, SLICE, POOL = 4_096, 256, 2_048, 500_000
#: Vectors an index is fitted on, cells for each root of the rows, and cells a query visits.
SAMPLE_ROWS, CELLS_PER_ROOT, PROBES = 16_384, 0.3, 16


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the usable vectors, and their places."""
    norm = np.linalg.norm(x, axis=1)
    use = np.isfinite(norm) & (norm > 0)
    return x[use] / norm[use, None], np.flatnonzero(use)


def _arrow_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that have ``dims`` numbers, as a matrix, and their places; null numbers become NaN."""
    lengths = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(float), nan=-1)
    at = np.flatnonzero(lengths == dims)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(at), dims), at


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Of each row the places of its ``k`` largest numbers, largest first, the smaller place first among equals."""
    m = s.shape[1]
    take = min(m, k + 16)
    if take == m:
        return np.argsort(-s, axis=1, kind="stable")[:, :k]
    some = np.argpartition(-s, take - 1, axis=1)[:, :take]
    values = np.take_along_axis(s, some, 1)
    order = np.lexsort((some, -values), axis=1)[:, :k]
    best = np.take_along_axis(some, order, 1)
    # Where the last of the best equals the least that was taken, equals may have been left out.
    tied = np.flatnonzero(np.take_along_axis(s, best[:, -1:], 1)[:, 0] <= values.min(axis=1))
    if len(tied):
        best[tied] = np.argsort(-s[tied], axis=1, kind="stable")[:, :k]
    return best


def fit_landmarks(sample: np.ndarray, cells: int, seed: int = 0, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; a landmark that loses all its vectors moves to a random one."""
    rng = np.random.default_rng(seed)
    x = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where((size < 1e-6)[:, None], x[rng.choice(len(x), len(c))], total / np.maximum(size, 1e-6)[:, None])
    return c.astype(np.float32)


@dataclass(frozen=True)
class VectorIndex:
    """Vectors with their ``cell``, and the cells' landmarks. Rows without a usable vector are in cell -1, which nobody visits."""

    rows: DataFrame
    marks: np.ndarray

    def write(self, path: str, key_col: str, mode: str = "overwrite") -> None:
        """The rows in a folder for each cell, a large cell in several files."""
        self.rows.repartition("cell", F.pmod(F.xxhash64(key_col), F.lit(8))).write.mode(mode).partitionBy("cell").parquet(f"{path}/rows")
        marks = [(i, m.tolist()) for i, m in enumerate(self.marks)]
        self.rows.sparkSession.createDataFrame(marks, "cell int, mark array<float>").coalesce(1).write.mode(mode).parquet(f"{path}/marks")


def read_index(spark, path: str) -> VectorIndex:
    marks = spark.read.parquet(f"{path}/marks").orderBy("cell").collect()  # one for each cell
    return VectorIndex(spark.read.parquet(f"{path}/rows"), np.array([r["mark"] for r in marks], np.float32))


def build_index(vectors: DataFrame, key_col: str, vec_col: str = "vector", dims: int | None = None, sample_rows: int = SAMPLE_ROWS, cells_per_root: float = CELLS_PER_ROOT) -> VectorIndex:
    """Every row of ``vectors`` with its cell. Landmarks are fitted on the ``sample_rows`` vectors with the smallest hash of their key, four or more for each cell.

    ``dims``: the size of the vectors that count; by default the most frequent one.
    """
    vectors = settle_names(vectors, (key_col, vec_col, "cell")).withColumnsRenamed({"cell": "cell_extra"})
    names = vectors.columns
    if dims is None:
        sizes = vectors.where(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").first()
        dims = sizes["d"] if sizes else 1
    drawn = vectors.where(F.size(vec_col) == dims).select(F.col(vec_col).alias("v")).orderBy(F.xxhash64(F.col(key_col).cast("string")), F.col(key_col)).limit(sample_rows).collect()
    x = np.array([[np.nan if e is None else e for e in r["v"]] for r in drawn], np.float64).reshape(-1, dims)
    x = np.unique(_unit(x)[0], axis=0) if len(x) else x
    cells = int(max(1, min(cells_per_root * vectors.count() ** 0.5, len(x) / 4)))
    marks = fit_landmarks(x, cells) if len(x) else np.zeros((0, dims), np.float32)
    shared = vectors.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.full(b.num_rows, -1, np.int32)
            raw, own = _arrow_rows(b.column(b.num_columns - 1), dims)
            u, at = _unit(raw)
            if len(u) and len(shared.value):
                cell[own[at]] = (u.astype(np.float32) @ shared.value.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(cell)], names=[*b.schema.names[:-1], "cell"])

    schema = ", ".join([f"c{i} {vectors.schema[c].dataType.simpleString()}" for i, c in enumerate(names)] + ["cell int"])
    source = vectors.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(vec_col).alias("v"))
    return VectorIndex(source.mapInArrow(run, schema).toDF(*names, "cell"), marks)


class _Pool:
    """A task's best ``k`` rows of each query over all its batches, by score, then key; of a repeated key the best row."""

    def __init__(self, asked: int, k: int, schema: pa.Schema):
        self.asked, self.k, self.schema = asked, k, schema
        self.least = np.full(asked, -np.inf)  # so many distinct keys as are wanted score this at least
        self.kept: list[pa.RecordBatch] = []
        self.hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = self.held = 0

    def add(self, rows: pa.RecordBatch, x: np.ndarray, q: np.ndarray, asks: np.ndarray, decimals: int) -> None:
        """``rows`` with their vectors ``x``, in order of their keys and each key once, against the queries ``asks``."""
        found = []
        for start in range(0, len(asks), CHUNK):
            some = asks[start : start + CHUNK]
            s = np.round(q[some] @ x.T, decimals)
            hit = s >= self.least[some][:, None]
            if hit.sum() <= 2 * self.k * len(some):
                who, at = np.nonzero(hit)
            else:
                best = _best(s, self.k)
                score = np.take_along_axis(s, best, 1)
                who, at = np.nonzero(score >= self.least[some][:, None])
                if score.shape[1] == self.k:
                    self.least[some] = np.maximum(self.least[some], score[:, -1])
                at = best[who, at]
            found.append((some[who], at, s[who, at]))
        who, at, score = (np.concatenate(f) for f in zip(*found))
        if len(who):
            used, at = np.unique(at, return_inverse=True)
            self.kept.append(rows.take(pa.array(used)))
            self.hits.append((who, at + self.rows, score))
            self.rows += len(used)
            self.held += len(who)
        if self.held > max(POOL, 2 * self.asked * self.k):
            self.reduce()

    def reduce(self) -> None:
        table = pa.Table.from_batches(self.kept, self.schema).combine_chunks()
        who, row, score = (np.concatenate(h) for h in zip(*self.hits))
        plain = [f.name for f in self.schema if not pa.types.is_nested(f.type)]
        place = np.empty(len(table), np.int64)
        place[pc.sort_indices(table, [(c, "ascending") for c in plain]).to_numpy()] = np.arange(len(table))
        key = table["c0"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((place[row], -score, key[row], who))
        first = np.concatenate([[True], (np.diff(who[order]) != 0) | (np.diff(key[row[order]]) != 0)])
        order = order[first]
        order = order[np.lexsort((place[row[order]], -score[order], who[order]))]
        begins = np.concatenate([[0], np.cumsum(np.bincount(who[order], minlength=self.asked))])
        n = np.arange(len(order)) - begins[who[order]]
        last = order[n == self.k - 1]
        self.least[who[last]] = np.maximum(self.least[who[last]], score[last])
        order = order[n < self.k]
        used, row = np.unique(row[order], return_inverse=True)
        self.kept = table.take(pa.array(used)).combine_chunks().to_batches()
        self.hits, self.rows, self.held = [(who[order], row, score[order])], len(used), len(order)

    def best(self) -> Iterator[tuple[np.ndarray, pa.Table, np.ndarray]]:
        """Numbers of queries, their rows and scores."""
        if self.held:
            self.reduce()
            table = pa.Table.from_batches(self.kept, self.schema)
            who, row, score = self.hits[0]
            for start in range(0, len(who), 50_000):
                part = slice(start, start + 50_000)
                yield who[part], table.take(pa.array(row[part])).combine_chunks(), score[part]


def top_k(queries: DataFrame, vectors: DataFrame | VectorIndex, k: int, key_col: str, vec_col: str = "vector", payload: tuple[str, ...] = (), decimals: int = 9, probes: int = PROBES) -> DataFrame:
    """``query_id, key_col, payload, score, rank``. ``queries``: ``query_id, vector``. Cosines are rounded so that ties are ties everywhere.

    ``vectors``: a table, all of whose rows are compared, or an index, of which each query visits ``probes`` cells.
    """
    spark = queries.sparkSession
    marks = vectors.marks if isinstance(vectors, VectorIndex) else None
    rows = vectors.rows if isinstance(vectors, VectorIndex) else vectors
    names = [key_col, *payload]
    kinds = [rows.schema[c].dataType.simpleString() for c in names]
    qkind = queries.schema["query_id"].dataType.simpleString()
    if qkind not in ("bigint", "string"):
        raise ValueError("query_id must be a bigint or a string")
    schema = ", ".join([f"query_id {qkind}", *[f"c{i} {t}" for i, t in enumerate(kinds)], "score double"])
    source = rows.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], (F.col("cell") if marks is not None else F.lit(0)).alias("cell"), F.col(vec_col).alias("v")).where(F.col("c0").isNotNull())
    asked = cut_lineage(queries.select("query_id", "vector").where(F.col("vector").isNotNull()))
    n_blocks = max(1, math.ceil(asked.count() / BLOCK))
    parts = []
    for number in range(n_blocks):
        block = asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == number)
        by_dims: dict[int, list] = {}
        for r in sorted(block.collect(), key=lambda r: r["query_id"]):
            by_dims.setdefault(len(r["vector"]), []).append((r["query_id"], r["vector"]))
        sets, cells = [], set()
        for dims, qs in by_dims.items():
            if marks is not None and dims != marks.shape[1]:
                continue
            q, at = _unit(np.array([[np.nan if e is None else e for e in v] for _, v in qs], np.float64).reshape(len(qs), dims))
            visits = None
            if marks is not None and len(marks):
                visits = np.zeros((len(q), len(marks)), bool)
                np.put_along_axis(visits, _best(q.astype(np.float32) @ marks.T, min(probes, len(marks))), True, axis=1)
                cells.update(np.flatnonzero(visits.any(axis=0)).tolist())
            sets.append((dims, np.array([qs[i][0] for i in at], dtype=object), q, visits))
        shared = spark.sparkContext.broadcast(sets)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pools: list[_Pool] = []
            for b in (whole.slice(start, SLICE) for whole in batches for start in range(0, whole.num_rows, SLICE)):
                shown = b.select(list(range(len(names))))
                pools = pools or [_Pool(len(q), k, shown.schema) for _, _, q, _ in shared.value]
                cell = b.column(len(names)).to_numpy()
                for pool, (dims, _, q, visits) in zip(pools, shared.value):
                    raw, own = _arrow_rows(b.column(b.num_columns - 1), dims)
                    x, at = _unit(raw)
                    if not len(x) or not len(q):
                        continue
                    at = own[at]
                    keys = pd.Series(b.column(0).take(pa.array(at)).to_pylist(), dtype=object)
                    nth = keys.groupby(keys).cumcount().to_numpy()  # rows of a repeated key are taken one after another
                    order = keys.sort_values(kind="stable").index.to_numpy()
                    for n in range(nth.max() + 1):
                        some = order[nth[order] == n]
                        for c in np.unique(cell[at[some]]):
                            here = some[cell[at[some]] == c]
                            asks = np.flatnonzero(visits[:, c]) if visits is not None else np.arange(len(q))
                            if len(asks):
                                pool.add(shown.take(pa.array(at[here])), x[here], q, asks, decimals)
            for pool, (_, ids, _, _) in zip(pools, shared.value):
                for who, table, score in pool.best():
                    held = [table.column(i).combine_chunks() for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[who].tolist(), pa.int64() if qkind == "bigint" else pa.string()), *held, pa.array(score)], names=["query_id", *[f"c{i}" for i in range(len(names))], "score"])

        read = source if marks is None else source.where(F.col("cell").isin(sorted(cells)))
        parts.append(read.coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(run, schema))
    # By query at once: the same rows would be shuffled a second time for their order.
    merged = reduce(DataFrame.unionByName, parts).repartition("query_id").groupBy("query_id", "c0").agg(F.max("score").alias("score"), *[F.min(f"c{i}").alias(f"c{i}") for i in range(1, len(names))])
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "c0")
    top = merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("query_id", *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "score", "rank")


def article_text(title: Column, summary: Column, max_tokens: int = 384, tokenizer: text.Tokenizer = text.WORDS) -> Column:
    """What an article's vector is made of: title and summary, cut to size, as a passage; with the truncation flag."""
    cut = text.truncate_words(text.join_non_blank(title, summary), max_tokens, tokenizer)
    return F.struct(text.prefixed(cut["text"], "passage").alias("text"), cut["was_truncated"].alias("was_truncated"), cut["tokens"].alias("tokens"))


def hashing_embedding(dims: int = 64):
    """The default model, the same everywhere: signed hashed word and character-trigram counts, scaled to length 1; blank texts give zeros."""

    def place(feature: str) -> tuple[int, float]:
        h = hashlib.sha1(feature.encode()).digest()
        return int.from_bytes(h[:6], "big") % dims, 1.0 if h[6] & 1 else -1.0

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, np.ndarray] = {}
        for s in batches:
            out = []
            for t in s:
                v = np.zeros(dims)
                for w in (t or "").lower().split():
                    if w not in known:
                        if len(known) > 200_000:
                            known.clear()
                        own = np.zeros(dims)
                        padded = f"<{w}>"
                        for feature in {w, *(padded[i : i + 3] for i in range(len(padded) - 2))}:
                            at, sign = place(feature)
                            own[at] += sign
                        known[w] = own
                    v = v + known[w]
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32))
            yield pd.Series(out)

    return embed


def embed_articles(canon: DataFrame, embed, max_tokens: int = 384, tokenizer: text.Tokenizer = text.WORDS) -> DataFrame:
    """The article-vector table."""
    t = canon.withColumn("_t", article_text(F.col("title_hi"), F.col("summary_hi"), max_tokens, tokenizer))
    return t.select("id", "url", "published_date", "published_ts", embed(F.col("_t.text")).alias("vector"), F.col("_t.was_truncated").alias("was_truncated"))


def embed_chunks(chunks: DataFrame, embed, max_tokens: int = 384, tokenizer: text.Tokenizer = text.WORDS) -> DataFrame:
    """The chunk-vector table."""
    t = chunks.withColumn("_t", text.truncate_words(F.col("chunk_text"), max_tokens, tokenizer))
    names = ["chunk_id", "article_id", "chunk_index", "url", "published_date", "published_ts", "title_hi", "chunk_tokens"]
    return t.select(*names, embed(text.prefixed(F.col("_t.text"), "passage")).alias("vector"), F.col("_t.was_truncated").alias("was_truncated"))


def vector_points(table: DataFrame, key_col: str, dims: int, numeric_key: bool = False) -> DataFrame:
    """Rows of a vector collection: point id and payload; rows without a vector of ``dims`` are left out.

    The point id is the key as a number (``numeric_key``; keys that are no number are refused when the rows are read) or a stable hash of it.
    Payload: missing texts are blank, numbers 0.
    """
    payload = [c for c in table.columns if c not in ("vector", "was_truncated")]
    key = F.col(key_col)
    point = F.coalesce(key.try_cast("decimal(20,0)"), F.raise_error(F.concat(F.lit("no number: "), key)).cast("decimal(20,0)")) if numeric_key else text.stable_id(key)
    blank = {"string": F.lit(""), "int": F.lit(0), "bigint": F.lit(0)}
    kinds = {c: table.schema[c].dataType.simpleString() for c in payload}
    shown = [(F.coalesce(F.col(c), blank[kinds[c]].cast(kinds[c])) if c != key_col and kinds[c] in blank else F.col(c)).alias(c) for c in payload]
    return table.where(F.size("vector") == dims).select(point.alias("point_id"), *shown, "vector")


def create_collection(spark, path: str, payload: str, dims: int) -> None:
    """An empty collection in place of any there is; ``payload``: its columns beside ``point_id`` and ``vector``. The size is kept in the schema."""
    schema = T.StructType.fromDDL(f"point_id decimal(20,0), {payload}, vector array<float>")
    schema["vector"].metadata["dims"] = dims
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def collection_dims(spark, path: str) -> int:
    return spark.read.parquet(path).schema["vector"].metadata["dims"]


def upsert_points(spark, path: str, points: DataFrame) -> DataFrame:
    """One row with what was written and what was refused (vectors of another size than the collection's), and a few refused ids; points replace those of the same id."""
    from lekhspark.sources.upsert import replace_table, upsert

    old = spark.read.parquet(path)
    dims = old.schema["vector"].metadata["dims"]
    fits = F.coalesce((F.size("vector") == dims) & F.col("point_id").isNotNull(), F.lit(False))
    report = ingest_report(points.select(F.col("point_id").cast("string").alias("key"), fits.alias("ok")))
    new = points.where(fits).select(*old.columns)
    replace_table(upsert(old, new, ["point_id"]).withMetadata("vector", {"dims": dims}), path)
    return report


def ingest_report(outcome: DataFrame, samples: int = 50) -> DataFrame:
    """``n_ok, n_failed, failed``: counts, and at most ``samples`` keys of failures, the smallest. ``outcome``: ``key, ok``."""
    failed = outcome.where(~F.col("ok")).select("key").orderBy("key").limit(samples).agg(F.sort_array(F.collect_list("key")).alias("failed"))
    return outcome.agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed")).crossJoin(F.broadcast(failed))


def truncation_report(articles: DataFrame, chunks: DataFrame, samples: int = 10) -> DataFrame:
    """One row: vectors and truncated ones of both tables, and at most ``samples`` examples, articles before chunks, by key."""
    a = articles.select(F.lit(0).alias("o"), F.col("id").alias("key"), "was_truncated")
    both = a.unionByName(chunks.select(F.lit(1).alias("o"), F.col("chunk_id").alias("key"), "was_truncated"))
    few = both.where("was_truncated").orderBy("o", "key").limit(samples).agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "key"))), lambda x: x["key"]).alias("examples"))
    count = lambda o: (F.count_if(F.col("o") == o), F.count_if((F.col("o") == o) & F.col("was_truncated")))
    (n_a, t_a), (n_c, t_c) = count(0), count(1)
    return both.agg(n_a.alias("n_articles"), t_a.alias("truncated_articles"), n_c.alias("n_chunks"), t_c.alias("truncated_chunks")).crossJoin(F.broadcast(few))
