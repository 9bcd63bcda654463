"""The language model's restaurants are those of whole preceding tokens."""

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from uwlens.llm import pitman_yor

from .util import documents

WORDS = ("xing", "ying", "a", "b", "c")


def _hash(token: bytes) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(token))


def test_contexts_with_the_same_ending_are_told_apart(spark):
    """After "xing" comes a, after "ying" comes b: a model that only sees the ending cannot know."""
    train = [(i, t, "s") for i, t in enumerate(["xing a", "ying b"] * 40)]
    asked = [(100, "xing a", "s"), (101, "xing b", "s"), (102, "ying b", "s"), (103, "ying a", "s")]
    got = pitman_yor.score_documents(documents(spark, train + asked), F.col("doc_id") >= 100)
    score = {r.doc_id: r.score for r in got.collect()}
    assert score[100] > score[101] + 1 and score[102] > score[103] + 1


def test_every_trained_context_is_a_distribution(spark):
    """Held-out texts hold each pair of words, so each part knows each context's totals: over all training
    tokens and the unseen one, probabilities add up to 1 after any word."""
    pairs = " ".join(f"{u} {w} {u}" for u in WORDS for w in WORDS)
    ends = [(200 + i, w, "s") for i, w in enumerate(WORDS)]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(["xing a ying b c", "ying b", "xing a a", "c xing a"] * 9)] + [(100, pairs, "s"), *ends])
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"), (F.col("doc_id") >= 100).alias("held_out"))
    table, model = pitman_yor.fit(rows, pitman_yor.Scratch(spark, "test-py"), 3)
    rows = table.collect()
    seen = {int(c): int(s) for r in rows for p in [pitman_yor.Part(r.part, r.body)] for c, s in zip(p.contexts, p.seats, strict=True)}
    assert seen[int(_hash(b"xing"))] == 27 and seen[int(_hash(b"ying"))] == 18 and seen[pitman_yor.START] == 36
    parts = [pitman_yor._Samples(pitman_yor.Part(r.part, r.body), model) for r in rows]
    for word in WORDS:
        total, context = 0.0, _hash(word.encode())
        for s in parts:
            n = len(s.part.words)
            log_p, _ = s.entries(s.part.words, np.ones(n, int), np.full(n, context))
            total += (10 ** log_p).sum()
        knows = next(s for s in parts if context in s.part.contexts)
        log_p, trained = knows.entries(np.array([1], np.uint64), np.array([1]), np.array([context]))
        assert trained[0] == 0 and total + 10 ** log_p[0] == pytest.approx(1.0, abs=1e-9)


def _seated_one_by_one(tokens, discounts, sweeps, kept, rng):
    """Plain Gibbs sampler of the same model, customer by customer: the averaged probability of (context, token)."""
    base = 1 / (len({t for _, t in tokens}) + 1)
    cells, root = {}, {}  # (context, token) and token -> customers per table

    def root_p(t):
        n, m = sum(map(sum, root.values())), sum(map(len, root.values()))
        mine = root.get(t, [])
        return (sum(mine) - discounts[1] * len(mine) + (1 + discounts[1] * m) * base) / (1 + n)

    def shares(u, t):
        of = [v for (c, _), v in cells.items() if c == u]
        n, m = sum(map(sum, of)), sum(map(len, of))
        mine = cells.get((u, t), [])
        return sum(mine) - discounts[0] * len(mine), (1 + discounts[0] * m) * root_p(t), 1 + n

    def put(tables, fresh, d):
        weights = np.array([k - d for k in tables] + [fresh])
        at = rng.choice(len(weights), p=weights / weights.sum())
        if at == len(tables):
            tables.append(0)
        tables[at] += 1
        return at == len(tables) - 1 and tables[at] == 1

    def take(tables):
        at = rng.choice(len(tables), p=np.array(tables) / sum(tables))
        tables[at] -= 1
        if not tables[at]:
            del tables[at]
            return True
        return False

    total = dict.fromkeys(set(tokens), 0.0)
    for sweep in range(sweeps):
        for u, t in tokens:
            if sweep and take(cells[u, t]):
                take(root[t])
            _, fresh, _ = shares(u, t)
            if put(cells.setdefault((u, t), []), fresh, discounts[0]):
                n_tables = sum(map(len, root.values()))
                put(root.setdefault(t, []), (1 + discounts[1] * n_tables) * base, discounts[1])
        if sweep >= sweeps - kept:
            for u, t in total:
                own, back, n = shares(u, t)
                total[u, t] += (own + back) / n / kept
    return total


def test_probabilities_are_those_of_a_plain_sampler(spark):
    texts = ["xing a ying b c", "ying b", "xing a a", "c xing a", "ying c", "b xing c"] * 5
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.lit(False).alias("held_out"))
    table, model = pitman_yor.fit(rows, pitman_yor.Scratch(spark, "test-py"), 3)
    samples = [pitman_yor._Samples(pitman_yor.Part(r.part, r.body), model) for r in table.collect()]
    chains = [("^", *t.split(), "$") for t in texts]
    want = _seated_one_by_one([p for c in chains for p in zip(c, c[1:])], model.discounts, 120, 100, np.random.default_rng(3))
    names = {w: _hash(w.encode()) for w in WORDS} | {"$": _hash(pitman_yor.END), "^": np.uint64(pitman_yor.START)}
    for (u, t), p in want.items():
        own = next(s for s in samples if names[t] in s.part.words)
        log_p, _ = own.entries(np.array([names[t]]), np.array([1]), np.array([names[u]]))
        assert 10 ** log_p[0] == pytest.approx(p, abs=0.06), (u, t)


def test_every_part_has_a_partition_of_its_own(spark):
    """A hash of the part's number would put several parts in one task and none in others."""
    rows = documents(spark, [(i, f"w{i} v{i % 7} u{i % 31}", "s") for i in range(300)]).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.lit(False).alias("held_out"))
    table, _ = pitman_yor.fit(rows, pitman_yor.Scratch(spark, "test-py"), 12)
    files = table.groupBy(F.input_file_name().alias("file")).agg(F.count("part").alias("n")).where("n > 0").collect()
    assert len(files) == 12 and {r.n for r in files} == {1}


def test_workers_of_the_language_model_give_memory_back(spark):
    """After arrays of 64 MiB in all are freed, a worker holds little more than before."""
    names = ("MALLOC_MMAP_THRESHOLD_", "MALLOC_TRIM_THRESHOLD_", "ARROW_DEFAULT_MEMORY_POOL")
    environment = spark.sparkContext.environment
    before = {n: environment.pop(n, None) for n in names}
    try:
        environment[names[2]] = "mimalloc"  # a value that was given stays
        pitman_yor.score_documents(documents(spark, [(1, "a b", "s")]), F.lit(False))

        def kept(batches):
            import os

            def resident() -> int:
                with open("/proc/self/statm") as f:
                    return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

            for _ in batches:
                np.ones(3 << 20)  # freed at once: glibc would now raise its threshold to this size
                was = resident()
                arrays = [np.ones(1 << 20) for _ in range(8)]
                last = np.ones(1 << 20)
                del arrays
                yield pd.DataFrame({"kept": [resident() - was - last.nbytes], "given": [os.environ[names[2]]]})

        got = spark.range(1, numPartitions=1).mapInPandas(kept, "kept bigint, given string").first()
    finally:
        for n, v in before.items():
            environment.pop(n, None)
            if v is not None:
                environment[n] = v
    assert got.kept < 8 << 20 and got.given == "mimalloc"
