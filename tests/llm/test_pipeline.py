import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .test_dedup import shingles
from .util import bench_words, lowered

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = [("documents", spark.read.parquet(f"{SF}/documents.parquet"))], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.Scratch(spark, "test-pipeline").save(stage(spark, docs, SF), name)
        out.append((name, docs))
    return dict(out)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_keep_the_columns_of_documents(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert len({tuple(df.columns) for df in stages.values()}) == 1


def test_each_stage_against_brute_force(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = stages["quality_classifier"].collect()
    dropped = {r.doc_id for r in stages["documents"].collect()} - {r.doc_id for r in good}
    assert sum(labels.get(i) == 1 for i in dropped) <= 1 and sum(labels.get(r.doc_id) == 0 for r in good) <= 2

    best = {}
    for r in good:
        best[lowered(r.text)] = max(best.get(lowered(r.text), -1), r.doc_id)
    exact = stages["exact_dedup"].collect()
    assert sorted(r.doc_id for r in exact) == sorted(best.values())

    left = stages["near_dedup"].collect()
    num, den = corpus_pipeline.NEAR_RATIO
    assert (num, den) == (80, 100)
    sets = {r.doc_id: shingles(r.text) for r in exact}
    stay = {r.doc_id for r in left}
    linked = {(a, b) for a in sets for b in sets if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}
    assert all(not (a in stay and b in stay) for a, b in linked)
    assert set(sets) - stay == {b for a, b in linked if b not in stay} and len(left) == len(stay)

    bench = [bench_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + min(13, len(w))]) for w in bench if w for i in range(len(w) - min(13, len(w)) + 1)}
    for r in stages["decontamination"].collect():
        w = bench_words(r.text)
        assert not any(tuple(w[i:i + 13]) in windows for i in range(len(w) - 12))
    assert stages["decontamination"].where("text is not null and n_chars <> length(text)").count() == 0

    mixed = stages["source_mixing"].groupBy("doc_id").count().collect()
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in stages["decontamination"].collect()}
    assert max(r["count"] for r in mixed) <= 3


def test_near_stage_drops_pairs_from_similarity_080(spark):
    words = [f"w{n}" for n in range(100)]
    near80 = words[:84]  # 80 of 96 shingles: 0.833
    far = words[20:]  # 76 of 96 shingles: 0.79
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for text, share, stays in ((near80, 80 / 96, [1]), (far, 76 / 96, [1, 2])):
        a, b = shingles(" ".join(words)), shingles(" ".join(text))
        assert len(a & b) / len(a | b) == share
        docs = spark.createDataFrame([(1, " ".join(words), "en", "s", 1), (2, " ".join(text), "en", "s", 1)], schema)
        assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()) == stays


def test_run_is_its_stages_and_reruns_agree(spark, stages):
    assert rows(corpus_pipeline.run(spark, SF).select("doc_id")) == rows(stages["source_mixing"].select("doc_id"))


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
