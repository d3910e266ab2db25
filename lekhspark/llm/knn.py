"""The most similar vectors for every vector of a table.

Vectors are scaled to length 1, equal vectors are folded into one class (with its ``k + 1``
smallest keys, all that can ever stand among ``k`` neighbours; the further keys of a class get their own
neighbours, its ``k`` smallest keys, in ``further_members``), and classes are hashed into the
cells of ``tables`` hash tables. Every class lies in one cell of each table; as a query it also
visits further cells, in the order of their estimated success. In each visited cell the
similarity to all its members is computed as one matrix product, and the best of all visited
cells are merged and ranked by exact cosine.

A table's hash is the landmark with the largest response; landmarks are fitted on a bounded
sample (vectors with the smallest key hash: ``sample_rows``, or four for each cell up to ``MAX_SAMPLE``) by spherical k-means from another
random start for each table, and dense regions get more of them. Their number grows with the square root
of the rows (``cells_per_root``): in proportion to the rows, topics would be parted ever more often and recall would
fall. The estimated success of a cell falls
with its landmark's response, so cells are visited in that order. (Hashing by random p-stable
projections was measured first; see the README for why it isn't used, and for recall.)

Cells near one another share a part, and a vector is sent to a part once, with the list of cells it visits there. A part
that the sample shows to hold more than ``PART_ROWS`` points or queries is split into blocks of points times blocks of queries, so
no task outgrows its memory however skewed the topics are.

The matrix products grow as the rows to the power 1.5; all else grows with the rows. No pairs within a cell are emitted, only ``k`` candidates for each query and part.

Defined cases: null, all-zero or non-finite vectors and those of other dimension have no
neighbours and are nobody's neighbour; rows with a null key are left out; a key with several
vectors counts with the smallest; ties are broken by key; a table with fewer than ``k + 1``
vectors gives shorter lists, an empty one none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lekhspark.llm.arrow import Shared
from lekhspark.operators.vectors import fit_landmarks
from lekhspark.session import broadcast_if_small, cut_lineage, settle_names

DIMS, K, TABLES, PROBES = 64, 5, 1, 8
SAMPLE_ROWS, MAX_SAMPLE, CELLS_PER_ROOT = 16_384, 262_144, 0.3
PART_CELLS, PART_ROWS = 16, 200_000


def _scaled(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors times a power of two each, which loses nothing, so that no square overflows; and their lengths."""
    r = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])
    return r, np.sqrt(np.einsum("ij,ij->i", r, r, dtype=np.float64))


def _unit(x: np.ndarray) -> np.ndarray:
    r, norm = _scaled(np.asarray(x, np.float64))
    return r / norm[:, None]


def _per_key(df: DataFrame, key_col: str, vec_col: str, dims: int) -> DataFrame:
    """``key, vec``: the usable vector of each key."""
    v = F.col("vec")
    good = (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key_col).cast("string").alias("key"), F.col(vec_col).cast("array<float>").alias("vec"))
    return rows.where(F.col("key").isNotNull() & F.coalesce(good, F.lit(False))).groupBy("key").agg(F.min("vec").alias("vec"))


def classes(df: DataFrame, key_col: str, vec_col: str, dims: int, k: int) -> DataFrame:
    """``id, others, vec``: one row per distinct vector, its smallest key and up to ``k`` further ones."""
    w = Window.partitionBy("vec").orderBy("key")
    few = _per_key(df, key_col, vec_col, dims).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    keys = F.sort_array(F.collect_list("key"))
    return few.groupBy("vec").agg(keys.alias("keys")).select(F.element_at("keys", 1).alias("id"), F.slice("keys", 2, k).alias("others"), "vec")


def parts_of(marks: np.ndarray, weight: np.ndarray, size: int = PART_CELLS) -> np.ndarray:
    """The part of each cell: cells are halved along their widest direction until ``size`` or fewer are left."""
    part = np.empty(len(marks), np.int32)
    todo, n = [np.arange(len(marks))], 0
    while todo:
        ids = todo.pop()
        if len(ids) <= size:
            part[ids], n = n, n + 1
            continue
        w = weight[ids]
        v = (marks[ids] - np.average(marks[ids], axis=0, weights=w)) * np.sqrt(w)[:, None]
        order = ids[np.argsort((marks[ids] @ np.linalg.svd(v, full_matrices=False)[2][0]), kind="stable")]
        half = np.cumsum(weight[order])
        cut = int(np.clip(np.searchsorted(half, half[-1] / 2), 1, len(ids) - 1))
        todo += [order[cut:], order[:cut]]
    return part


def visited(u: np.ndarray, marks: np.ndarray, probes: int) -> np.ndarray:
    """The cells each unit vector visits, its own first."""
    s = u @ marks.T
    best = np.argpartition(-s, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1, kind="stable"), 1)


def plan_table(x: np.ndarray, marks: np.ndarray, probes: int, rows: int, part_rows: int, part_cells: int) -> dict:
    """Landmarks, parts, and how many blocks of points and of queries each part is split into, as the sample's shares of all ``rows`` suggest."""
    u = _unit(x).astype(np.float32)
    cells = np.concatenate([visited(u[i : i + 4096], marks, probes) for i in range(0, len(u), 4096)])
    part = parts_of(marks, np.bincount(cells[:, 0], minlength=len(marks)) + 1.0, part_cells)
    n = int(part.max()) + 1
    points = np.bincount(part[cells[:, 0]], minlength=n) * rows / len(u)
    queries = np.bincount(np.concatenate([np.unique(r) for r in part[cells]]), minlength=n) * rows / len(u)
    return {"marks": marks, "part": part, "points": np.ceil(points / part_rows).clip(1).astype(int), "queries": np.ceil(queries / part_rows).clip(1).astype(int)}


def top_candidates(r: np.ndarray, norm: np.ndarray, unit: np.ndarray, queries: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``k`` most similar points but itself, and their exact cosines; -1 fills up.

    ``queries``, ``points``: rows of ``r`` (with lengths ``norm``; ``unit``: scaled to length 1 in single precision), ascending in key order, so the smaller wins a tie.
    """
    n, m = len(queries), len(points)
    at, cos = np.full((n, k), -1), np.full((n, k), -2.0)
    if not m:
        return at, cos
    p32 = unit[points]
    take = min(m, k + 4)
    step = max(1, (8 << 20) // m)
    for i in range(0, n, step):
        q = queries[i : i + step]
        s = unit[q] @ p32.T
        own = np.minimum(np.searchsorted(points, q), m - 1)
        mine = points[own] == q
        s[np.flatnonzero(mine), own[mine]] = -3
        best = np.argpartition(-s, take - 1, axis=1)[:, :take] if take < m else np.tile(np.arange(m), (len(q), 1))
        exact = np.einsum("ijd,id->ij", r[points[best]], r[q], dtype=np.float64) / (norm[points[best]] * norm[q][:, None])
        exact[(best == own[:, None]) & mine[:, None]] = -3
        exact = np.round(exact, 12)
        order = np.lexsort((best, -exact), axis=1)[:, :k]
        b, e = points[np.take_along_axis(best, order, 1)], np.take_along_axis(exact, order, 1)
        b[e < -1.5], e[e < -1.5] = -1, -2
        at[i : i + step, : b.shape[1]], cos[i : i + step, : b.shape[1]] = b, e
    return at, cos


_ROW = "tbl int, part int, pb int, qb int, cell int, visits array<int>, id string, others array<string>, vec binary"
_FOUND = "id string, others array<string>, near array<struct<neg:double,id:string,others:array<string>>>"
NEIGHBOUR_SCHEMA = "id string, others array<string>, near array<struct<cos:double,id:string,others:array<string>>>"


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """Values with their ascending row numbers as one list per row."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(rows, minlength=n))).astype(np.int32)), pa.array(values.astype(np.int32)))


def _placed(t: int, plan: dict, u: np.ndarray, ids: pa.Array, probes: int) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """For rows of unit vectors: which rows go to parts, and the columns of _ROW before ``id``; rows of split parts once for each block that needs them."""
    cells = visited(u, plan["marks"], probes)
    n_parts = len(plan["points"])
    code = (np.arange(len(u))[:, None] * n_parts + plan["part"][cells]).ravel()
    order = np.argsort(code, kind="stable")
    pairs, group = np.unique(code[order], return_inverse=True)
    row, part = pairs // n_parts, pairs % n_parts
    visits = cells.ravel()[order]
    cell = np.where(part == plan["part"][cells[row, 0]], cells[row, 0], -1)
    constant = lambda x, n: pa.array(np.full(n, x, np.int32))
    whole = (plan["points"] * plan["queries"])[part] == 1
    if whole.any():
        keep = whole[group]
        to = np.cumsum(whole) - 1
        n = int(whole.sum())
        yield row[whole], [constant(t, n), pa.array(part[whole].astype(np.int32)), constant(0, n), constant(0, n), pa.array(cell[whole].astype(np.int32)), _lists(to[group[keep]], visits[keep], n)]
    if whole.all():
        return
    spot = np.array([hash_of(i) for i in ids.to_pylist()], np.uint64)
    for p in np.unique(part[~whole]):
        mine = part == p
        pb, qb = spot[row] % np.uint64(plan["points"][p]), (spot[row] >> np.uint64(20)) % np.uint64(plan["queries"][p])
        for x in range(plan["points"][p]):
            for y in range(plan["queries"][p]):
                is_point, asks = (pb == x) & (cell >= 0), qb == y
                sel = mine & (is_point | asks)
                if not (n := int(sel.sum())):
                    continue
                to = np.cumsum(sel) - 1
                keep = (sel & asks)[group]
                yield row[sel], [constant(t, n), constant(p, n), constant(x, n), constant(y, n), pa.array(np.where(is_point, cell, -1)[sel].astype(np.int32)), _lists(to[group[keep]], visits[keep], n)]


def hash_of(key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "little")


def _searched(tab: pa.Table, dims: int, k: int, least: float) -> pa.Table:
    """The neighbours of the queries of one part (or block of it) among its points, cell by cell."""
    tab = tab.take(pc.sort_indices(tab["id"])).combine_chunks()
    flat = lambda name: tab[name].chunk(0) if tab[name].num_chunks else tab[name].combine_chunks()
    ids, others, vec, visits = flat("id"), flat("others"), flat("vec"), flat("visits")
    n = len(ids)
    start = vec.offset * 4 * dims
    r, norm = _scaled(np.frombuffer(vec.buffers()[2], np.float32, n * dims, start).reshape(n, dims))
    unit = (r / norm[:, None]).astype(np.float32)
    cell = flat("cell").to_numpy()
    asks = np.repeat(np.arange(n), pc.list_value_length(visits).to_numpy())
    seen = visits.flatten().to_numpy()
    by_cell = np.argsort(seen, kind="stable")
    at, cos = np.full((n, k), -1), np.full((n, k), -2.0)
    for c in np.unique(cell[cell >= 0]):
        lo, hi = np.searchsorted(seen[by_cell], [c, c + 1])
        q = asks[by_cell[lo:hi]]
        if not len(q):
            continue
        a, e = top_candidates(r, norm, unit, q, np.flatnonzero(cell == c), k)
        a, e = np.concatenate([at[q], a], axis=1), np.concatenate([cos[q], e], axis=1)
        order = np.lexsort((a, -e), axis=1)[:, :k]
        at[q], cos[q] = np.take_along_axis(a, order, 1), np.take_along_axis(e, order, 1)
    good = (at >= 0) & (cos >= least)
    out = np.flatnonzero(np.isin(np.arange(n), asks) & (good.any(axis=1) | (pc.list_value_length(others).to_numpy() > 0) | (least <= -1)))
    good, at, cos = good[out], at[out], cos[out]
    near = pa.StructArray.from_arrays([pa.array(-cos[good]), ids.take(pa.array(at[good])), others.take(pa.array(at[good]))], names=["neg", "id", "others"])
    offsets = pa.array(np.append(0, np.cumsum(good.sum(axis=1))).astype(np.int32))
    keep = pa.array(out)
    return pa.table({"id": ids.take(keep), "others": others.take(keep), "near": pa.ListArray.from_arrays(offsets, near)})


def neighbours(
    df: DataFrame, key_col: str, vec_col: str = "vector", k: int = K, dims: int = DIMS, tables: int = TABLES, probes: int = PROBES, sample_rows: int = SAMPLE_ROWS,
    cells_per_root: float = CELLS_PER_ROOT, least: float = -1.0, part_rows: int = PART_ROWS, part_cells: int = PART_CELLS,
) -> DataFrame:
    """NEIGHBOUR_SCHEMA: of each class its ``k`` nearest other classes, most similar first.

    ``least``: only neighbours of at least that cosine are wanted; then classes of one key that have none give no row.
    """
    df = settle_names(df, (key_col, vec_col))
    spark = df.sparkSession
    rows = df.count()
    cells = int(max(8, cells_per_root * rows**0.5))
    sample_rows = max(sample_rows, min(MAX_SAMPLE, 4 * cells))
    sample = df.select(F.col(key_col).cast("string").alias("key"), F.col(vec_col).alias("v")).where(F.size("v") == dims).orderBy(F.xxhash64("key"), "key").limit(sample_rows).select("v").toPandas()["v"]
    x = np.array([v for v in sample if all(e is not None and np.isfinite(e) for e in v) and any(v)], np.float32).reshape(-1, dims)
    if not len(x):
        return spark.createDataFrame([], NEIGHBOUR_SCHEMA)
    x = np.unique(x, axis=0)
    cells = min(cells, max(8, len(x) // 4), len(x))
    visit = min(probes, cells)
    plans = [plan_table(x, fit_landmarks(_unit(x), cells, seed), visit, rows, part_rows, part_cells) for seed in range(tables)]
    shared = Shared(spark, pickle.loads, pickle.dumps(plans, protocol=5))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = shared.get()
        names = [c.split()[0] for c in _ROW.split(", ")]
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                b = whole.slice(start, 2048)
                if not b.num_rows:
                    continue
                raw = np.ascontiguousarray(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), np.float32)
                r, norm = _scaled(raw)
                u = (r / norm[:, None]).astype(np.float32)
                vecs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dims), len(u), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
                for t, plan in enumerate(plans):
                    for row, columns in _placed(t, plan, u, b.column(0), visit):
                        to = pa.array(row)
                        yield pa.RecordBatch.from_arrays([*columns, b.column(0).take(to), b.column(1).take(to), vecs.take(to)], names=names)

    best = classes(df, key_col, vec_col, dims, k).mapInArrow(hashed, _ROW).groupBy("tbl", "part", "pb", "qb").applyInArrow(lambda tab: _searched(tab, dims, k, least), _FOUND)
    # Each query has at most tables x probes x blocks rows of k candidates, so the lists collected here are bounded.
    merged = F.sort_array(F.array_distinct(F.flatten(F.collect_list("near"))))
    near = F.transform(F.slice(merged, 1, k), lambda x: F.struct((-x["neg"]).alias("cos"), x["id"].alias("id"), x["others"].alias("others")))
    return best.groupBy("id").agg(F.first("others").alias("others"), near.alias("near"))


def members(near: DataFrame, k: int = K, least: float = -1.0) -> DataFrame:
    """``a, b, cos, rank``: neighbours of keys from those of classes, folded classes unfolded as far as ``k`` needs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, others, around in zip(f["id"], f["others"], f["near"]):
                own = sorted([i, *others])
                beyond = sorted(((-n["cos"], key) for n in around for key in [n["id"], *n["others"]]))
                for a in own:
                    ranked = ([(1.0, b) for b in own if b != a] + [(-c, b) for c, b in beyond])[:k]
                    out += [(a, b, c, r) for r, (c, b) in enumerate(ranked, 1) if c >= least]
            yield pd.DataFrame(out, columns=["a", "b", "cos", "rank"])

    # Classes of one key among classes of one key, most often all, need no unfolding.
    single = (F.size("others") == 0) & ~F.exists("near", lambda x: F.size(x["others"]) > 0)
    plain = near.where(single).select(F.col("id").alias("a"), F.posexplode("near").alias("at", "n")).select("a", F.col("n.id").alias("b"), F.col("n.cos").alias("cos"), (F.col("at") + 1).alias("rank"))
    unfolded = near.where(~single).mapInPandas(run, "a string, b string, cos double, rank int")
    return plain.where((F.col("rank") <= k) & (F.col("cos") >= least)).unionByName(unfolded)


def further_members(df: DataFrame, key_col: str, vec_col: str = "vector", k: int = K, dims: int = DIMS) -> DataFrame:
    """``a, b, cos, rank`` of the keys that ``members`` leaves out: those of a class behind its ``k + 1`` smallest, whose neighbours are its ``k`` smallest.

    Vectors are counted by their hash; only rows of keys that hold one of more than ``k + 1`` keys are looked at further.
    """
    df = settle_names(df, (key_col, vec_col)).select(F.col(key_col).cast("string").alias("key"), F.col(vec_col).cast("array<float>").alias("vec")).where(F.col("key").isNotNull())
    same = F.xxhash64(F.transform("vec", lambda x: x + F.lit(0.0).cast("float")))  # 0 and -0 are one number
    crowded = cut_lineage(df.where(F.size("vec") == dims).select("key", same.alias("same")).distinct().groupBy("same").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("same"))
    if crowded.isEmpty():
        return df.sparkSession.createDataFrame([], "a string, b string, cos double, rank int")
    keys = df.withColumn("same", same).join(broadcast_if_small(crowded), "same", "left_semi").select("key").distinct()
    df = df.join(keys, "key", "left_semi")
    full = classes(df, "key", "vec", dims, k).where(F.size("others") == k)
    kept = broadcast_if_small(full.select("vec", F.array_insert("others", 1, F.col("id")).alias("kept")), 100_000)
    rest = _per_key(df, "key", "vec", dims).join(kept, "vec").where(F.col("key") > F.element_at("kept", -1))
    near = rest.select(F.col("key").alias("a"), F.posexplode(F.slice("kept", 1, k)).alias("at", "b"))
    return near.select("a", "b", F.lit(1.0).alias("cos"), (F.col("at") + 1).alias("rank"))


def found(articles: DataFrame, chunks: DataFrame, least: float = 0.9) -> DataFrame:
    """``kind, id_a, id_b``: mutual neighbours of cosine ``least`` or more."""
    parts = []
    for kind, df, key in (("article", articles, "id"), ("chunk", chunks, "chunk_id")):
        # Rounding of the last bits mustn't part a pair that lies on the bound.
        one_way = members(neighbours(df, key, least=least - 1e-9), least=least - 1e-9)
        both = one_way.groupBy(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).agg(F.count("*").alias("n"))
        parts.append(both.where(F.col("n") == 2).select(F.lit(kind).alias("kind"), "id_a", "id_b"))
    return parts[0].unionByName(parts[1])
