import hashlib
import random
from collections import defaultdict

from uwlens.llm import exact_dedup, near_dedup
from uwlens.llm.components import components
from uwlens.llm.common import Scratch

from .util import SF, awkward, blank_words, documents, empty, lowered


def exact_expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def test_exact_matches_brute_force(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), awkward(spark), empty(spark)):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        for bits in (1 << 27, 64):  # a filter that is far too small only lets more rows shuffle
            got = [tuple(r) for r in exact_dedup.exact_duplicates(docs, filter_bits=bits).collect()]
            assert sorted(got, key=key) == sorted(exact_expected(rows), key=key)


def test_exact_drop_keeps_one_row_per_text_and_all_columns(spark):
    docs = awkward(spark)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    texts = [lowered(r.text) for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({lowered(r.text) for r in docs.collect()})


def test_hot_group_and_unique_rows(spark):
    docs = documents(spark, [(i, "Same TEXT" if i % 3 == 0 else f"own {i}", "s") for i in range(3000)])
    got = exact_dedup.exact_duplicates(docs).where("group_size > 1").collect()
    assert len(got) == 1000 and sum(r.kept for r in got) == 1 and {r.keep_id for r in got} == {2997}


def shingles(text):
    w = blank_words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_expected(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append(doc_id)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)], rows[i][0] == least[find(i)]) for i in range(len(rows))]


def near_got(docs):
    return [tuple(r) for r in near_dedup.near_duplicates(docs).collect()]


def test_near_matches_brute_force(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), awkward(spark), empty(spark)):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert sorted(near_got(docs), key=key) == sorted(near_expected(rows), key=key)


def test_near_copies_of_one_text_and_a_shared_passage(spark):
    """A family of copies with few to many edits (chains of links), and unlike texts around one passage."""
    rng = random.Random(4)
    base = [f"b{n}" for n in range(160)]
    rows = [(0, " ".join(base), "s")]
    for i in range(1, 160):
        words = list(base)
        for at in rng.sample(range(160), rng.choice([1, 1, 2, 3, 4, 8])):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words), "s"))
    passage = " ".join(f"p{n}" for n in range(60))
    rows += [(1000 + i, f"{passage} " + " ".join(f"o{i}n{n}" for n in range(rng.choice([4, 5, 30, 60]))), "s") for i in range(120)]
    got = near_got(documents(spark, rows))
    assert sorted(got) == sorted(near_expected([(i, t) for i, t, _ in rows]))


def test_near_drop_goes_by_row_not_by_id(spark):
    """Clean rows stay when their id, or the null id, also stands at a near copy; copies without ids go."""
    left = near_dedup.drop_near_duplicates(awkward(spark))
    assert left.columns == awkward(spark).columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    gone = [(None, "one TWO three four five six."), (7, rows[10][1])]
    assert sorted(got, key=key) == sorted({r for r in rows if r not in gone}, key=key)

    body = [f"t{n}" for n in range(60)]
    near = " ".join([*body, "end"])
    rows = [(1, " ".join(body), "s"), (2, near, "s"), (2, "a clean text of the same id two", "s"), (None, near + " more", "s"),
            (None, "a clean text that has no id", "s"), (None, "q " + " ".join(body[::-1]), "s"), (None, " ".join(body[::-1]), "s")]
    got = {(r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(documents(spark, rows)).collect()}
    assert got - {(i, t) for i, t, _ in rows[5:]} == {(i, t) for i, t, _ in (rows[0], rows[2], rows[4])} and len(got) == 4
    labels = near_got(documents(spark, rows))
    assert sorted(labels, key=key) == sorted(near_expected([(i, t) for i, t, _ in rows]), key=key)


def test_pruning_bounds():
    assert near_dedup.least_matches(24, 0.85, 1e-7) < 0.85 * 24
    bounds = [near_dedup.least_matches(n, 0.85, 1e-7) / n for n in range(24, 121, 24)]
    assert bounds == sorted(bounds)  # the more compared, the tighter


def test_bands_follow_the_threshold():
    for threshold, rows in ((0.85, 5), (0.8, 4), (0.5, 2)):
        assert near_dedup.band_rows(threshold) == rows
        bands, p = near_dedup.HASHES // rows, threshold**rows
        assert (1 - p)**bands + bands * p * (1 - p)**(bands - 1) < near_dedup.BAND_MISS


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101 + i) for i in range(500)] + [(7, 7)]
    roots = components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "test-cc"))
    got = {r.node: r.root for r in roots.collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 601)}}


def test_one_text_per_node_however_often_its_row_repeats(spark):
    from pyspark.sql import functions as F

    from uwlens.llm.common import text_bytes
    base = [f"w{n}" for n in range(120)]
    rows = [(1, " ".join(base), "s")] * 200 + [(None, " ".join(base[1:]), "s")] * 50 + [(i, " ".join(base[:100 + i % 20]), "s") for i in range(2, 30)]
    docs = documents(spark, rows)
    texts = docs.select(near_dedup._row_key(F.col("doc_id"), F.col("text")).alias("row_key"), text_bytes(F.col("text")).alias("text"))
    nodes = near_dedup.signed_documents(docs, "doc_id", "text").groupBy("node").agg(F.min("row_key").alias("row_key"))
    found = near_dedup._texts_of(nodes.select("node"), nodes, texts, Scratch(spark, "texts"), "t").collect()
    assert len(found) == nodes.count() == len({bytes(r.node) for r in found})
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {1}
