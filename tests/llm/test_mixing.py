from collections import defaultdict

import pytest

from uwlens.llm import mixing

from .util import SF, awkward, blank_words, documents, empty


def targets_of(sizes, weights=(5, 2, 1)):
    """Water filling by the contract: cap, reshare the excess by weight, repeat."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: 3 * sizes[s] for s in over}


def check(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(blank_words(r.text))
    got = mixing.systematic_copies(docs).collect()
    assert len(got) == len(rows)
    want = targets_of(dict(sizes)) if sizes else {}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    again = mixing.systematic_copies(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_tables(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), awkward(spark), empty(spark)):
        check(docs)


def test_hot_source_and_many_small_ones(spark):
    rows = [(i, "w " * (1 + i % 7), "hot" if i % 3 else f"s{i % 41:02d}") for i in range(900)] + [(9999, "big " * 4000, "zz")]
    check(documents(spark, rows))
