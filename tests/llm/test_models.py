import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from uwlens.llm import pitman_yor, quality_mil, toxicity
from uwlens.llm.common import crc_remainder

from .util import awkward, blank_words, crc, documents, empty

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_mil.train_quality(docs, labels, crc_remainder(F.col("doc_id"), 3) != 1)
    rows = docs.join(labels, "doc_id").select("doc_id", "quality", quality_mil.quality_score(F.col("text"), model).alias("score")).collect()
    held = [r for r in rows if crc(r.doc_id, 3) == 1]
    assert len(held) > 80 and np.mean([(r.score >= 0.5) == (r.quality == 1) for r in held]) >= 0.97
    kept = quality_mil.keep_good(awkward(spark), model)
    assert kept.columns == awkward(spark).columns
    assert quality_mil.keep_good(empty(spark), model).count() == 0


def test_quality_without_labels_of_both_kinds(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(3, 1), (4, 1), (None, 0), (5, None)], "doc_id bigint, quality int")
    assert quality_mil.train_quality(docs, labels, F.lit(True)).score(b"x") == 1.0
    assert quality_mil.train_quality(docs, labels.where("doc_id > 99"), F.lit(True)).score(b"") == 0.5


def test_attention_gradients():
    rng = np.random.default_rng(0)
    bags = [rng.random((n, quality_mil.FEATURES)) for n in (1, 3, 5)]
    y = np.array([0.0, 1.0, 1.0])
    model = quality_mil.fit([b.astype(np.float32) for b in bags] * 4, np.tile(y, 4))
    x, starts = np.concatenate(bags), np.array([0, 1, 4])

    def loss():
        logit, _ = model.bags(x, starts)
        return float(np.mean(np.log1p(np.exp(-logit)) * y + np.log1p(np.exp(logit)) * (1 - y)))

    for name, gradient in model.gradients(x, starts, y).items():
        p = model.params[name].reshape(-1)
        for at in (0, len(p) // 2):
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            assert gradient.reshape(-1)[at] == pytest.approx((up - loss()) / 2e-5, abs=1e-6)
            p[at] = old


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_toxicity(docs, labels, crc_remainder(F.col("doc_id"), 4) != 2)
    rows = model.score(docs.join(labels, "doc_id"), into="p").select("doc_id", "toxic", "p").collect()
    held = [r for r in rows if crc(r.doc_id, 4) == 2]
    caught = sum(r.p >= 0.3 for r in held if r.toxic)
    wrong = sum(r.p >= 0.3 for r in held if not r.toxic)
    assert caught >= 0.85 * sum(r.toxic for r in held) and wrong <= 0.02 * len(held)
    odd = model.score(awkward(spark))
    assert odd.count() == awkward(spark).count() and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert model.score(empty(spark)).count() == 0


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    model = toxicity.train_toxicity(awkward(spark), labels, F.lit(True))
    assert {r.score for r in model.score(awkward(spark)).collect()} == {0.0}


def base_scores(rows, held):
    tokens = [blank_words(t) + [b"\n"] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if not held(i) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    return total, sorted((str(i), held(i), len(ws), sum(w in counts for w in ws),
                          round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws), 5))
                         for (i, _), ws in zip(rows, tokens, strict=True))


@pytest.mark.parametrize("which", ["given", "awkward"])
def test_language_model_counts_and_base(spark, which):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet") if which == "given" else awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    total, want = base_scores(rows, lambda i: i is not None and crc(i, 7) == 2)
    got = pitman_yor.score_documents(docs, crc_remainder(F.col("doc_id"), 7) == 2).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert {r.train_tokens for r in got} == {total}
    assert all(r.score <= 0 and math.isfinite(r.perplexity) for r in got)
    if which == "given":
        assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_language_model_is_a_distribution(spark):
    """Predictive probabilities over all training tokens and the unseen one add up to 1 in any context,
    and reruns agree."""
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(["a b a c", "b a b", "a a a a b", "c"] * 6)])
    held = F.lit(False)
    scored = pitman_yor.score_documents(docs, held)
    assert sorted(map(str, scored.collect())) == sorted(map(str, pitman_yor.score_documents(docs, held).collect()))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.lit(False).alias("held_out"))
    table, model = pitman_yor.fit(rows, pitman_yor.Scratch(spark, "test-py"), 3)
    parts = {r.part: pitman_yor._Samples(pitman_yor.Part(r.part, r.body), model) for r in table.collect()}
    for context in (pitman_yor.START, 0x2000 | ord("a"), 0x2000 | ord("b"), 0x7171):
        total = 0.0
        for s in parts.values():
            n = len(s.part.words)
            log_p, _ = s.entries(s.part.words, np.ones(n, int), np.full(n, context))
            total += (10 ** log_p).sum()
        log_p, _ = pitman_yor._Samples(None, model).entries(np.array([1], np.uint64), np.array([1]), np.array([context]))
        assert total + 10 ** log_p[0] == pytest.approx(1.0, abs=1e-9)


def test_reseat_mean_matches_exact_seating():
    """Tables of n customers without a parent's pull: (Pitman-Yor, parent probability 1) known mean."""
    rng = np.random.default_rng(1)
    n, d, theta, runs = 40, 0.5, 1.0, 20_000
    tables = pitman_yor.reseat(np.full(runs, n), np.full(runs, theta), d, np.ones(runs), rng)
    mean = math.gamma(theta + 1) / (d * math.gamma(theta + d)) * math.exp(math.lgamma(theta + n + d) - math.lgamma(theta + n)) - theta / d
    assert tables.mean() == pytest.approx(mean, rel=0.01)


def test_language_model_empty(spark):
    assert pitman_yor.score_documents(empty(spark), F.lit(False)).count() == 0


def test_sample_is_bounded_by_texts_and_bytes_when_one_id_has_a_third_of_the_rows(spark):
    from uwlens.llm.labelled import labelled_rows
    rows = [(5, "the same text", "s")] * 400 + [(5, f"another text {i}", "s") for i in range(40)] + [(i, f"text of {i} " * 9, "s") for i in range(10, 800)]
    rows += [(900, "long " * 5000, "s"), (901, None, "s")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in {r[0] for r in rows}] + [(5, 0), (None, 1), (7777, 1)], "doc_id bigint, quality int")
    every = labelled_rows(docs, labels, "quality", F.lit(True), 5000, 1 << 20).collect()
    assert len(every) == len({(i, t) for i, t, _ in rows}) and {r.label for r in every if r.doc_id == 5} == {1.0}
    for most, size in ((30, 1 << 20), (5000, 4000)):
        got = labelled_rows(docs, labels, "quality", F.lit(True), most, size).collect()
        assert 0 < len(got) <= most and sum(len((r.text or "").encode()) for r in got) <= size
        assert len({(r.doc_id, r.text) for r in got}) == len(got) and {(r.doc_id, r.text) for r in got} <= {(i, t) for i, t, _ in rows}
        again = labelled_rows(docs, labels, "quality", F.lit(True), most, size).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
    assert labelled_rows(empty(spark), labels, "quality", F.lit(True), 10, 100).count() == 0
