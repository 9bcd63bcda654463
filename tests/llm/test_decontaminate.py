import random

from uwlens.llm import decontaminate

from .util import SF, awkward, bench_words, documents, empty


def brute(docs, items):
    windows = {}
    for item_id, text in items:
        w = bench_words(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add(None if item_id is None else str(item_id))
    lengths = sorted({len(w) for w in windows})
    out = []
    for doc_id, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i:i + k])]
        out.append((doc_id, len(w), len(hit), sorted(found - {None}), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def got(docs, bench, **kw):
    found = decontaminate.contamination(docs, bench, **kw).select("doc_id", "n_words", "n_hit", "items", "contaminated")
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_given_tables_and_blocks(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in bench.collect()]), key=str)
    for block_words in (100_000, 40):  # one block; many blocks over several column functions
        assert got(docs, bench, block_words=block_words) == want


def test_overlaps_short_items_and_repeats(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("a b c".split()) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 8, 13, 14, 30]))) for i in range(2, 25)] + [(None, "x y z"), (30, ""), (31, None), (32, "x y z"), (32, "x y z")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(i, text(rng.choice([0, 2, 13, 60])), "s") for i in range(60)] + [(99, "A! x, Y z", None)]
    docs = documents(spark, rows)
    assert got(docs, bench) == sorted(brute([(i, t) for i, t, _ in rows], items), key=str)


def test_removed_spans_are_gone_and_columns_stay(spark):
    bench = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20)))], "item_id bigint, text string")
    body = " ".join(f"w{i}" for i in range(600))
    docs = documents(spark, [(1, f"{body}, Q0 " + " ".join(f"q{i}" for i in range(1, 20)) + f"! {body}", "s"), (2, body, "s"), (3, " ".join(f"q{i}" for i in range(20)), "s")])
    left = decontaminate.decontaminate(docs, bench)
    rows = {r.doc_id: r.text for r in left.collect()}
    assert left.columns == docs.columns and rows == {1: f"{body}, ! {body}", 2: body}


def test_awkward_and_empty(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string")
    docs = awkward(spark)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(1, "one two three four five six")])
    assert got(docs, bench) == sorted(want, key=str)
    assert got(empty(spark), bench) == []
    assert all(not r[4] for r in got(docs, bench.where("item_id < 0")))
