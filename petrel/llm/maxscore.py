"""Exact top-k inner products of quantised vectors by MaxScore.

A vector is a document, a dimension is a term and the quantised component its weight. Within a shard of candidates,
postings are one array per dimension. A query bounds each of its terms by the largest product that any candidate of the shard can
give it (weights may be negative, so a bound is taken from the largest or the smallest weight). Terms are ordered by how far they can
lift or lower a score; the longest tail whose bounds together stay below the k-th best score known is
non-essential. Essential postings are traversed for all candidates; the others are probed, a few
terms at a time, only for candidates that remain competitive. What is known rises with every step: a candidate's partial score and the lower bounds of
the terms it lacks are a score that it reaches at least, and the k-th best of these is the next threshold. The best k of each shard are merged.

Queries are a stated set and are held against all candidates in cells of (shard, block of queries), each of bounded
size, so no task needs all of either; a cell gives back k rows a query.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part; a missing component of a shorter
vector counts as 0; rows that share an id are one candidate if their vectors are equal and candidates of their own if not, and are never
candidates of the query with their id; queries that share an id are answered by the smallest vector; ties go to the smaller id, then to the
smaller vector; a null id takes no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

K, SCALE, EVERY = 20, 64, 20
#: Candidates a shard and queries a block hold, about; a cell's memory is bounded by these, not by the tables.
SHARD, BLOCK = 16384, 2048
#: Non-essential terms probed at once.
PROBE = 8
OUT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & fine)
    return v.select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v")).distinct()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to a width."""
    lengths = np.asarray(pc.list_value_length(column))
    flat = np.asarray(column.flatten())
    out = np.zeros((len(column), width), np.int64)
    if len(column) and (lengths == width).all():
        out[:] = flat.reshape(-1, width)
    else:
        at = np.concatenate([[0], np.cumsum(lengths)])
        for r, (a, b) in zip(out, zip(at[:-1], at[1:], strict=True), strict=True):
            r[: b - a] = flat[a:b]
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids (positions are ascending by id)."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores > kth)
        at = np.concatenate([at, np.flatnonzero(scores == kth)[: k - len(at)]])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((at, -scores[at]))]


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int = K) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, (positions, scores) of its best k among the candidates, which are ascending by id.

    Sums are exact: products of integers of this size fit into doubles (checked), or Python integers take their place.
    """
    exact = np.abs(queries.astype(float)).sum(1).max(initial=0) * np.abs(vectors.astype(float)).max(initial=0) < 2**53
    queries, vectors = (x.astype(float if exact else object) for x in (queries, vectors))
    postings = np.ascontiguousarray(vectors.T)
    high, low = vectors.max(0), vectors.min(0)
    out = []
    seed = slice(0, min(len(ids), 8 * k))
    for query_id, q in zip(query_ids, queries, strict=True):
        upper, lower = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
        terms = np.argsort(-(upper - lower), kind="stable")
        terms = terms[q[terms] != 0]
        upper, weight = upper[terms], q[terms]
        rest = np.concatenate([np.cumsum(upper[::-1])[::-1], [0]])  # what the terms from here on can still add at most
        least = np.concatenate([np.cumsum(lower[terms][::-1])[::-1], [0]])  # and at least
        others = ids != query_id
        # The first threshold: the k-th best of a few candidates, scored in full.
        some = np.flatnonzero(others[seed])
        scores = vectors[some] @ q
        theta = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else None
        alive, partial, done = np.flatnonzero(others), None, 0
        while done < len(terms):
            if partial is None:
                # Essential terms: up to the first whose tail alone stays below the threshold. Where no tail does, as without a threshold that
                # counts, the first few terms are taken for a start.
                below = np.flatnonzero(rest[:-1] < theta) if theta is not None else []
                essential = max(1, int(below[0])) if len(below) else min(PROBE, len(terms))
                partial = weight[:essential] @ postings[terms[:essential]]
                partial, done = partial[alive], essential
            else:
                part = terms[done : done + PROBE]
                partial = partial + weight[done : done + len(part)] @ postings[part][:, alive] if len(alive) * 4 > len(ids) else partial + vectors[np.ix_(alive, part)] @ weight[done : done + len(part)]
                done += len(part)
            if len(alive) > k:
                known = partial + least[done]
                kth = np.partition(known, len(known) - k)[len(known) - k]
                theta = kth if theta is None else max(theta, kth)
            if theta is not None:
                keep = partial + rest[done] >= theta
                alive, partial = alive[keep], partial[keep]
        if partial is None:
            partial = np.zeros(len(alive))
        at = _best(ids[alive], partial, k)
        out.append((alive[at], partial[at]))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each row of ``vectors`` for which ``is_query`` holds."""
    v = quantised(pick(vectors, vec_id="long", embedding="array<double>"), scale)
    queries = v.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = v.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("m"), F.max(F.size("v")).alias("w")).first()
    if not sizes.m:
        return v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards, blocks, width = -(-sizes.n // shard), -(-sizes.m // block), sizes.w
    # Cells: every candidate meets every block of queries, every query every shard.
    cells = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    c = v.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("s"), cells(blocks, "b"))
    q = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int").alias("b"), cells(shards, "s"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        got: list[tuple] = []
        if left.num_rows and right.num_rows:
            asked, found = (t.select(["vec_id", "v"]).combine_chunks() for t in (left, right))
            qi, ci = np.asarray(asked["vec_id"]), np.asarray(found["vec_id"])
            qm, cm = (_matrix(t["v"].combine_chunks(), width) for t in (asked, found))
            order = np.lexsort((*cm.T[::-1], ci))
            ci, cm = ci[order], cm[order]
            for i, (at, scores) in zip(qi, search(qi, qm, ci, cm, k), strict=True):
                got += [(int(i), int(ci[p]), int(s)) for p, s in zip(at, scores, strict=True)]
        cols = list(zip(*got, strict=True)) or [(), (), ()]
        return pa.table([pa.array(x, pa.int64()) for x in cols], ["query_id", "vec_id", "score"])

    # One row a query, cell and hit. A task keeps the best k of each query of what it has made before anything is shuffled, and the sorted rows of a
    # query are then ranked as a stream.
    hits = q.groupBy("s", "b").cogroup(c.groupBy("s", "b")).applyInArrow(cell, OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def every(n: int = EVERY) -> Column:
    return F.col("vec_id") % n == 0


QUERY_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
