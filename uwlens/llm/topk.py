"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are cut into cells of ``CELL_ROWS`` rows.  A cell is staged as one row: its matrix and, for each
dimension, its rows sorted by that component (the sorted lists).  Queries are cut into blocks of ``QUERY_ROWS``.
Each query block meets each group of ``GROUP_CELLS`` cells in one place, and a task goes through the cells with
the best rows found so far.  For one query and cell:

* sorted access goes down the lists of all dimensions with a non-zero query component at once, from the end
  that raises the product, by depths that double;
* each row seen for the first time gets its whole product (random access);
* the threshold is the product of the query with the components at the present depth: no row that is still
  unseen has more.  The search stops as soon as the threshold is below the k-th best product (not when it is
  equal, as an unseen row of the same score may have a smaller id).

The groups' best rows meet per query in a window of which Spark keeps k rows per task before it shuffles.  No
task holds more than one cell and one query block, and no cell's size depends on ids or values, so a vector that
a third of all rows share is dealt like others.  The work is that of all queries against all rows, in blocks.

Defined results: a null vector and one with a null, NaN or infinite component take no part; a shorter vector
counts as zero in the dimensions it lacks; a query's own row, and only that row, is not among its candidates
(another row of its id is); repeated queries each have their rows; equal scores go to the smaller id, a null id
after all others; fewer candidates than k are all given; an empty table and one without queries give no rows.
Ids are integers.  Columns other than the two named are ignored.  Scores are exact while they fit bigint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import arrow_rows, even_length, integer_vectors, numbered

K = 5
CELL_ROWS = 2048
QUERY_ROWS = 512
GROUP_CELLS = 4
FIRST_DEPTH = 16
NO_ID = (1 << 63) - 1
_FOUND = "query_no bigint, query_id bigint, vec_id bigint, score bigint"


def _packed(frame: pd.DataFrame) -> dict[str, bytes]:
    """Row numbers, ids and components as bytes; the matrix in the smallest integer type that holds it."""
    x = np.stack(frame["x"].to_list()).astype(np.int64)
    kind = np.min_scalar_type(int(-np.abs(x).max(initial=0)) - 1)
    return {"kind": kind.str, "nos": frame["row_no"].to_numpy(np.int64).tobytes(), "ids": frame["vec_id"].to_numpy(np.int64).tobytes(),
            "x": x.astype(kind).tobytes()}


def _cell(frame: pd.DataFrame) -> pd.DataFrame:
    packed = _packed(frame)
    x = np.frombuffer(packed["x"], packed["kind"]).reshape(len(frame), -1)
    lists = np.argsort(x.T, axis=1, kind="stable").astype(np.uint16)
    return pd.DataFrame([{"cell": frame["cell"].iat[0], **packed, "lists": lists.tobytes()}])


def _query_block(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([{"block": frame["block"].iat[0], **_packed(frame)}])


class _Best:
    """The k best (score, id, row) so far of one query."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, object), np.empty(0, np.int64)

    @property
    def kth(self):
        return self.scores[-1] if len(self.scores) == self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.kth is not None:
            near = scores >= self.kth
            scores, ids = scores[near], ids[near]
        if not len(scores):
            return
        scores, ids = np.concatenate([self.scores.astype(scores.dtype), scores]), np.concatenate([self.ids, ids])
        order = (np.lexsort((ids, -scores)) if scores.dtype != object
                 else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))))[:self.k]
        self.scores, self.ids = scores[order], ids[order]


class Lists:
    """A cell's matrix, its ids and its sorted lists."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, nos: np.ndarray, lists: np.ndarray, top: int):
        """``top``: the largest absolute component of any query that will be asked."""
        largest = int(np.abs(x.astype(np.int64)).max(initial=0))
        # whole products in doubles are exact below 2^53; beyond that Python's integers
        self.number = np.float64 if largest * top * max(1, x.shape[1]) < 1 << 53 else object
        self.x = (x if self.number is np.float64 else x.astype(np.int64)).astype(self.number)
        self.ids, self.nos, self.lists = ids, nos, lists
        self.values = np.take_along_axis(self.x.T, lists.astype(np.int64), axis=1)

    def search(self, q: np.ndarray, own: int, best: _Best) -> int:
        """The threshold algorithm for one query; returns how many rows it looked at."""
        rows = len(self.ids)
        q = (q if self.number is np.float64 else q.astype(np.int64)).astype(self.number)
        used = np.flatnonzero(q)
        rising = q[used] > 0
        seen = np.zeros(rows, bool)
        seen[self.nos == own] = True
        depth, step = 0, FIRST_DEPTH
        while depth < rows:
            at = np.where(rising, rows - 1 - depth, depth)
            threshold = self.values[used, at] @ q[used] if len(used) else 0
            if best.kth is not None and threshold < best.kth:
                break
            to = min(rows, depth + step) if len(used) else rows
            fresh = ~seen
            if len(used) and to < rows:
                met = np.zeros(rows, bool)
                met[self.lists[used[rising], rows - to:rows - depth].ravel()] = True
                met[self.lists[used[~rising], depth:to].ravel()] = True
                fresh &= met
            if fresh.any():
                best.add(self.x[fresh] @ q if len(used) else np.zeros(int(fresh.sum()), self.number), self.ids[fresh])
                seen |= fresh
            depth, step = to, step * 2
        return int(seen.sum())


def _searched(k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def found(queries, best: list[_Best]) -> pd.DataFrame:
        nos, ids = queries
        sizes = [len(b.ids) for b in best]
        return pd.DataFrame({"query_no": np.repeat(nos, sizes), "query_id": np.repeat(ids, sizes),
                             "vec_id": np.concatenate([b.ids for b in best]),
                             "score": np.array([int(s) for b in best for s in b.scores], np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, queries, best, x = None, None, [], None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if key != (r.block, r.cells):
                    if best:
                        yield found(queries, best)
                    key, queries = (r.block, r.cells), (np.frombuffer(r.q_nos, np.int64), np.frombuffer(r.q_ids, np.int64))
                    x = np.frombuffer(r.q_x, r.q_kind).reshape(len(queries[0]), -1)
                    best = [_Best(k) for _ in queries[0]]
                nos = np.frombuffer(r.nos, np.int64)
                cell = Lists(np.frombuffer(r.x, r.kind).reshape(len(nos), -1), np.frombuffer(r.ids, np.int64), nos,
                             np.frombuffer(r.lists, np.uint16).reshape(-1, len(nos)), int(np.abs(x.astype(np.int64)).max(initial=0)))
                for q, own, mine in zip(x, queries[0], best, strict=True):
                    cell.search(q, own, mine)
        if best:
            yield found(queries, best)

    return run


def top_products(rows: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each row that satisfies ``is_query``, a condition on ``vec_id``."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "top-products")
    vectors, dims, n = even_length(numbered(integer_vectors(rows, id_col, vector_col), scratch, "vectors"))
    if not dims:
        vectors = vectors.withColumn("x", F.array(F.lit(0).cast("bigint")))
    ident = F.coalesce(F.col("vec_id").cast("bigint"), F.lit(NO_ID)).alias("vec_id")
    packed = "kind string, nos binary, ids binary, x binary"
    asked = numbered(vectors.where(is_query).select(ident, F.col("row_no").alias("no"), "x"), scratch, "asked")
    blocks = ceil(asked.count() / QUERY_ROWS)
    groups = ceil(ceil(n / CELL_ROWS) / GROUP_CELLS)
    if not blocks or not groups:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    with arrow_rows(spark, CELL_ROWS):
        cells = scratch.save(
            vectors.select(F.floor(F.col("row_no") / CELL_ROWS).alias("cell"), "row_no", ident, "x")
            .groupBy("cell").applyInPandas(_cell, f"cell bigint, {packed}, lists binary"), "cells")
        queries = scratch.save(
            asked.select(F.floor(F.col("row_no") / QUERY_ROWS).alias("block"), F.col("no").alias("row_no"), "vec_id", "x")
            .groupBy("block").applyInPandas(_query_block, f"block bigint, {packed}"), "queries")
    numbers = lambda most: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(most - 1).cast("bigint")))
    # each block goes to each group of cells once, each cell to each block once
    left = cells.select(F.floor(F.col("cell") / GROUP_CELLS).alias("cells"), numbers(blocks).alias("block"),
                        "cell", "kind", "nos", "ids", "x", "lists")
    right = queries.select("block", numbers(groups).alias("cells"),
                           *[F.col(c).alias(f"q_{c}") for c in ("kind", "nos", "ids", "x")])
    with arrow_rows(spark, GROUP_CELLS):
        found = scratch.save(left.join(right.hint("merge"), ["block", "cells"]).mapInPandas(_searched(k), _FOUND), "found")
    order = Window.partitionBy("query_no").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score"))
