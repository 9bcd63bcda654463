"""Whitening and exact top-k against plain numpy on whole tables."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from uwlens.llm import queries, topk, whitening
from uwlens.llm.common import Scratch
from uwlens.llm.vectors import numbered

from .util import SF

SCHEMA = "vec_id bigint, embedding array<float>, label int, Component string, score double, x int, row_no int"


def vectors(spark, rows):
    """An embeddings table with extra columns whose names clash with results and working names."""
    return spark.createDataFrame([(i, v, None, "c", 0.5, 1, 2) for i, v in rows], SCHEMA)


def awkward(spark):
    """Null and non-finite vectors, null, repeated and negative ids, repeated rows, ties, unequal lengths, a hot vector."""
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(1, 90)]
    rows += [(50, [0.5] * 6), (50, [0.5] * 6), (100, [0.5] * 6), (None, [0.5] * 6), (None, None), (150, None),
             (200, [0.1, None, 0.3, 0.4, 0.5, 0.6]), (201, [float("nan")] * 6), (250, [float("inf")] + [0.0] * 5),
             (300, []), (301, [0.25, -0.25]), (350, [0.0] * 6), (-50, [-1.0, 1.0, -1.0, 1.0, -1.0, 1.0])]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)]
    return vectors(spark, rows)


def integers(rows):
    """(id, integer vector) of the rows that take part, filled up to the longest."""
    kept = [(r.vec_id, [math.floor(256 * float(np.float32(c))) for c in r.embedding]) for r in rows
            if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    longest = max((len(x) for _, x in kept), default=0)
    return [(i, tuple(x + [0] * (longest - len(x)))) for i, x in kept]


def tables(spark):
    return [spark.read.parquet(f"{SF}/embeddings.parquet"), awkward(spark)]


def none(spark):
    return vectors(spark, [(1, [0.5])]).where("vec_id < 0")


@pytest.mark.parametrize("at", [0, 1])
def test_whitening_matches_numpy(spark, at):
    table = tables(spark)[at]
    every = integers(table.collect())
    fit = sorted({x for _, x in every})
    n, matrix = len(fit), np.array(fit, dtype=np.int64)
    sums = [int(s) for s in matrix.sum(axis=0)]
    centred = matrix - np.array(sums) / n
    covariance = centred.T @ centred / n
    values, components = np.linalg.eigh(covariance)
    values, components = values[::-1][:4], components[:, ::-1][:, :4]

    got = whitening.whiten(table).collect()
    assert len(got) == 4 * len(every)
    by_id = defaultdict(list)
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(covariance), rel=1e-9)
        by_id[r.vec_id].append(r)
    want = defaultdict(list)
    for i, x in every:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        white = (np.array(x) - np.array(sums) / n) @ components / np.sqrt(values)
        want[i] += [(c + 1, deviation, white[c]) for c in range(4)]
    signs = {}
    for i, rows in by_id.items():
        assert sorted((r.component, int(r.deviation)) for r in rows) == sorted((c, d) for c, d, _ in want[i])
        a = sorted((r.component, abs(r.whitened)) for r in rows)
        assert np.allclose([w for _, w in a], [w for _, w in sorted((c, abs(w)) for c, _, w in want[i])], atol=1e-8)
        if len(rows) == 4:
            for r in rows:
                other = next(w for c, _, w in want[i] if c == r.component)
                if abs(other) > 1e-6:
                    signs.setdefault(r.component, np.sign(other * r.whitened))
                    assert np.sign(other * r.whitened) == signs[r.component]


def test_whitening_in_panels_and_blocks_of_few_rows(spark, monkeypatch):
    table = awkward(spark)
    key = lambda r: (str(r.vec_id), r.component, round(r.whitened, 9))
    whole = sorted(map(key, whitening.whiten(table).collect()))
    monkeypatch.setattr(whitening, "PANEL_ROWS", 37)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 6 * 5)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 2)
    assert sorted(map(key, whitening.whiten(table).collect())) == whole


def test_whitening_without_variance_or_rows(spark):
    assert whitening.whiten(none(spark)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [])])).count() == 0
    line = whitening.whiten(vectors(spark, [(i, [i / 256, 2 * i / 256, 0.0]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-9 for r in line)


def expected_products(rows, k=5):
    every = list(enumerate(integers(rows)))
    out = []
    for at, (i, q) in every:
        if i is None or i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(q, x, strict=True)), j is None, j) for b, (j, x) in every if b != at]
        out += [(i, rank + 1, j, -s) for rank, (s, _, j) in enumerate(sorted(scored, key=lambda t: (t[0], t[1], t[2] or 0))[:k])]
    return out


@pytest.mark.parametrize("at", [0, 1])
def test_top_products_match_brute_force(spark, at, monkeypatch):
    table = tables(spark)[at]
    want = sorted(map(str, expected_products(table.collect())))
    assert sorted(str(tuple(r)) for r in topk.top_products(table, F.col("vec_id") % 50 == 0).collect()) == want
    for name, value in (("CELL_ROWS", 7), ("QUERY_ROWS", 2), ("GROUP_CELLS", 3)):
        monkeypatch.setattr(topk, name, value)
    assert sorted(str(tuple(r)) for r in topk.top_products(table, F.col("vec_id") % 50 == 0).collect()) == want


def test_top_products_of_few_or_no_rows(spark):
    ask = F.col("vec_id") % 50 == 0
    assert topk.top_products(none(spark), ask).count() == 0
    assert topk.top_products(vectors(spark, [(1, [0.5])]), ask).count() == 0
    assert topk.top_products(vectors(spark, [(50, [0.5])]), ask).count() == 0
    got = topk.top_products(vectors(spark, [(50, [0.5]), (7, [0.25]), (3, [0.25])]), ask).collect()
    assert [tuple(r) for r in got] == [(50, 1, 3, 128 * 64), (50, 2, 7, 128 * 64)]


def test_arrow_setting_comes_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    topk.top_products(awkward(spark), F.col("vec_id") % 50 == 0).count()
    assert spark.conf.get(name) == before


def test_threshold_stops_the_search_early():
    """Products that one dimension decides: the search leaves the lists after their heads."""
    rng = np.random.default_rng(2)
    x = np.column_stack([np.arange(2000) * 50, rng.integers(-3, 4, (2000, 5))]).astype(np.int64)
    lists = np.argsort(x.T, axis=1, kind="stable").astype(np.uint16)
    cell = topk.Lists(x, np.arange(2000), np.arange(2000), lists, 300)
    for q in (np.array([9, 1, -1, 2, 0, 1]), np.array([-9, 1, -1, 2, 0, 1])):
        best = topk._Best(5)
        seen = cell.search(q, -1, best)
        order = sorted(range(2000), key=lambda i: (-int(x[i] @ q), i))[:5]
        assert best.ids.tolist() == order and seen < 500
        best.scores = best.scores + 10**7
        assert cell.search(q, -1, best) == 0  # nothing here can beat what other cells had
    wide = topk.Lists(x * (1 << 40), np.arange(2000), np.arange(2000), lists, 1 << 20)  # beyond exact doubles
    best = topk._Best(5)
    wide.search(np.array([1 << 19, 0, 0, 0, 0, 1]), -1, best)
    assert best.scores[0] == max(int(a) * (1 << 59) + int(b) * (1 << 40) for a, b in zip(x[:, 0], x[:, 5]))


def test_numbers_have_no_gaps(spark):
    df = spark.range(0, 1000, 1, 7).where("id % 7 <> 3 and (id < 143 or id > 285)")
    got = numbered(df, Scratch(spark, "numbered"), "t").collect()
    assert sorted(r.row_no for r in got) == list(range(df.count())) and {r.id for r in got} == {r.id for r in df.collect()}


def test_registered_queries(spark):
    white = queries.op11_whitening(spark, SF)
    assert dict(white.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                  "explained": "double", "identity_error": "double"}
    top = queries.op12_top_products(spark, SF)
    assert dict(top.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
