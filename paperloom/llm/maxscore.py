"""Exact top-k inner-product search by MaxScore over sharded vectors.

A vector's components, scaled and floored to integers, are the weights in the
postings of its terms (one per dimension). Vectors are dealt into shards and
queries into blocks; every shard meets every block once in a grid. In a shard
each term has score bounds for a query, from the least and the largest weight
of its posting. Terms are sorted by the width of their bounds; those whose
bounds together can't lift a vector to the k-th best score found so far are
non-essential. The essential postings are traversed for all vectors; the rest
are probed, a few terms at a time, only for vectors whose partial score and
remaining bound are still competitive (ties are). The shards' best are merged
by query.

Defined results: vectors that are null, empty or hold a null or non-finite
component, and rows with a null id, take no part; rows with the query's own id
are no candidates for it; of equal query rows one is answered, different
vectors of one id are answered apart; repeated candidates each count, ties go
to the smaller id; a shorter vector counts as padded with zeros; with fewer
than k candidates all are returned; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_map import bounded_batches, schema_of
from .session import read_table

SHARD_ROWS = 8192
QUERY_ROWS = 2048


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers (as objects where doubles couldn't hold them)."""
    flat = column.combine_chunks()
    n = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def search(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best among ``vectors``, whose rows are sorted by id."""
    ok = ids != own
    if not ok.any():
        return ids[:0], np.zeros(0, np.int64)
    low, high = vectors.min(0), vectors.max(0)
    a, b = query * low, query * high
    least, most = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(-(most - least), kind="stable")
    first = np.flatnonzero(ok)[: max(64, 4 * k)]
    seen = np.sort(vectors[first] @ query)[::-1]
    bar = seen[k - 1] if len(seen) >= k else -np.inf
    rest = np.r_[np.cumsum((most - least)[order][::-1])[::-1], 0]  # what the terms from here on can add to the floor
    floor = least.sum()
    essential = int(np.searchsorted(-(floor + rest), -bar, side="right")) if np.isfinite(bar) else len(order)
    essential = max(1, min(essential, len(order)))
    terms = order[:essential]
    partial = vectors[:, terms] @ query[terms]
    live = np.flatnonzero(ok)
    part = partial[live]
    at = essential
    bound = np.r_[np.cumsum(most[order][::-1])[::-1], 0]
    while True:
        keep = part + bound[at] >= bar
        live, part = live[keep], part[keep]
        if at == len(order) or not len(live):
            break
        terms = order[at : at + step]
        part = part + vectors[np.ix_(live, terms)] @ query[terms]
        at += len(terms)
        if len(live) > k:  # what is certain by now may raise the bar
            sure = np.partition(part, len(part) - k)[len(part) - k] + (least[order[at:]].sum())
            bar = max(bar, sure)
    best = np.lexsort((ids[live], -part))[:k]
    return ids[live[best]], part[best]


def top_k(frame: DataFrame, queries: str, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, key, score: the k best of all other rows for each row where the SQL condition ``queries`` on the column id holds."""
    bounded_batches(frame.sparkSession)
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    fine = F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad
    rows = frame.filter(fine).select(F.col(key).cast("long").alias("id"), whole.alias("v"))
    asked = rows.filter(queries).distinct().withColumn("own", F.xxhash64("id", "v"))
    n, width, m = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1)), F.count(F.when(F.expr(queries), 1))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    right = asked.withColumn("block", F.pmod("own", F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    kind, arrow = schema_of("query_id long, own long, vec_id long, score long")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(a) and len(b):
            ids = a.column("id").to_numpy()
            by = np.argsort(ids, kind="stable")
            ids, x, q = ids[by], _matrix(a.column("v"), width)[by], _matrix(b.column("v"), width)
            if np.abs(x).max() * np.abs(q).max() * width >= 2**52:
                x, q = (np.array([[int(c) for c in r] for r in z], object) for z in (x, q))
            for row, own, hash_ in zip(q, b.column("id").to_pylist(), b.column("own").to_pylist(), strict=True):
                best, scores = search(x, ids, row, own, k) if x.dtype != object else plain(x, ids, row, own, k)
                out[0] += [own] * len(best)
                out[1] += [hash_] * len(best)
                out[2] += best.tolist()
                out[3] += [int(s) for s in scores]
        return pa.Table.from_arrays([pa.array(o, f.type) for o, f in zip(out, arrow, strict=True)], schema=arrow)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, kind)
    w = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(key), "score")


def plain(x: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, list[int]]:
    """The same by all products, for integers that doubles can't hold."""
    scores = [int(sum(a * b for a, b in zip(r, query, strict=True))) for r in x]
    best = sorted((i for i in range(len(ids)) if ids[i] != own), key=lambda i: (-scores[i], ids[i]))[:k]
    return ids[best], [scores[i] for i in best]


def op5_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), "id % 50 = 0")


#: op5_maxscore_top_k in DuckDB's SQL, by all inner products.
SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
q AS (SELECT DISTINCT vec_id, w FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, q.w AS asked, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score FROM q JOIN v c ON q.vec_id <> c.vec_id)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS place FROM s) WHERE place <= 5
"""
