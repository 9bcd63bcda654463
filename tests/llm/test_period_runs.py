"""Periodic runs against a plain scan of every lag."""

import hashlib
import random
import zlib

import numpy as np

from uwlens.llm import queries
from uwlens.llm.period_runs import _seeds, find_runs, periodic_runs

from .util import SF, awkward, documents, empty


def every_lag(words):
    """All runs by comparing the words at every lag."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in dropped)


def looping(rng, n, kinds, loops):
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(loops if n > 9 else 0):
        a, p = rng.randrange(n), rng.randrange(1, max(2, n // rng.choice([4, 5, 8, 20, 60])))
        for i in range(a, min(n, a + rng.randrange(p, n))):
            words[i] = words[a + (i - a) % p]
    return words


def test_runs_of_random_words():
    rng = random.Random(11)
    for _ in range(400):
        words = looping(rng, rng.randrange(0, 500), rng.choice([1, 2, 3, 5, 50]), rng.randrange(4))
        assert [tuple(r) for r in find_runs(np.array(words, np.int64)).tolist()] == every_lag(words)


def test_long_periods_come_from_minimizers():
    rng = random.Random(4)
    block = [rng.randrange(10**6) for _ in range(777)]
    words = np.array([rng.randrange(10**6) for _ in range(500)] + block * 5 + [rng.randrange(10**6) for _ in range(900)], np.int64)
    assert (777, 500) in {(r[2], r[0]) for r in find_runs(words).tolist()}
    at, lag = _seeds(words, 512)
    assert set(lag.tolist()) == {777} and len(at) < len(words) / 20


def test_operator_on_tables(spark):
    rng = random.Random(9)
    loops = documents(spark, [(i, " ".join(f"w{w}" for w in looping(rng, rng.randrange(300), 4, 3)), "s") for i in range(200)])
    huge = documents(spark, [(1, " ".join(["x", "y", "z"] * 40_000), "s"), (2, "a b " * 10 + "c", None), (2, "a b " * 10 + "c", None)])
    for docs in (awkward(spark), empty(spark), loops, huge):
        got = periodic_runs(docs)
        assert got.columns[:len(docs.columns)] == docs.columns
        rows = got.collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(r.doc_id), str(r.text)) for r in docs.collect())
        for r in rows:
            words = (r.text or "").encode().split()
            runs = [(0, 120_000, 3)] if len(words) == 120_000 else every_lag(words) if len(words) < 5000 else None
            assert r.n_words == len(words)
            if runs is not None:
                assert [tuple(x) for x in r.runs] == runs
                assert r.collapsed.encode() == collapsed(words, runs)


def test_query_by_the_contract(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_periodic_runs(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    with_runs = 0
    for r in got:
        words = (rows[r.doc_id] or "").encode().split()
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = every_lag(words)
        with_runs += bool(runs)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs)).hexdigest()
    assert with_runs > 5
    assert [t for _, t in queries.op13_periodic_runs(spark, SF).dtypes] == ["bigint"] * 6 + ["string"] * 2


def test_workers_take_small_batches_of_texts(spark):
    """Finding runs needs many times a batch's size, so the session's batch limits are cut to the operator's."""
    periodic_runs(documents(spark, [(1, "a b", "s")]))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 250
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 1 << 20
