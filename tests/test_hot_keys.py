"""Joins, as-of and top-1 operators when one key, day or instant holds a third of all rows or more."""

import random
from collections import Counter, defaultdict
from contextlib import contextmanager
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from uwlens.operators import asof
from uwlens.operators.joins import keyed, left_join_hot_right, split_join
from uwlens.operators.latest import latest_option, preferred_quote, top1, top1_hashed


@contextmanager
def settings(spark, **conf):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


SHUFFLED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", ["left", "right", "both", "neither"])
def test_split_join_equals_the_plain_join(spark, how, hot):
    rng = random.Random(f"{how}{hot}")
    def rows(n, is_hot, tag):
        keys = [7 if is_hot and i % 2 else rng.choice([None, *range(40)]) for i in range(n)]
        return spark.createDataFrame([(k, f"{tag}{i % 11}") for i, k in enumerate(keys)], f"k int, {tag} string")
    left, right = rows(300, hot in ("left", "both"), "l"), rows(200, hot in ("right", "both"), "r")
    with settings(spark, **SHUFFLED):
        a, b = keyed(left, ["k"], "_lm"), keyed(right, ["k"], "_rm")
        assert bool(a.cells) == (hot in ("left", "both")) and bool(b.cells) == (hot in ("right", "both"))
        assert all(n > 1 for n in (*a.cells.values(), *b.cells.values()))
        got = split_join(a.frame, b.frame, ["k"], how, left_hot=a, right_hot=b).select("k", "l", "r")
        assert same(got, left.join(right, ["k"], how).select("k", "l", "r"))


def test_split_join_on_two_columns_and_a_hot_null_key(spark):
    left = spark.createDataFrame([(1, "a", i) for i in range(50)] + [(None, "a", i) for i in range(90)] + [(2, "b", 1)], "x int, y string, l int")
    right = spark.createDataFrame([(1, "a", i) for i in range(60)] + [(None, "a", 5), (2, None, 6), (3, "c", 7)], "x int, y string, r int")
    with settings(spark, **SHUFFLED):
        a, b = keyed(left, ["x", "y"], "_lm"), keyed(right, ["x", "y"], "_rm")
        assert set(b.cells) == {(1, "a")} and set(a.cells) == {(1, "a")}
        for how in ("inner", "left"):
            got = split_join(a.frame, b.frame, ["x", "y"], how, left_hot=a, right_hot=b).drop("_lm", "_rm")
            assert same(got, left.join(right, ["x", "y"], how))
        spread = split_join(left, b.frame, ["x", "y"], "left", right_hot=b).where("x is null").select(F.spark_partition_id().alias("p"))
        assert spread.distinct().count() > 3


def test_a_hot_right_key_is_joined_in_many_tasks(spark, tmp_path):
    left = spark.range(400).select(F.col("id").alias("k"))
    right = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("v"))
    spark.sql("CREATE DATABASE IF NOT EXISTS hot_keys")
    bucketed = right.write.mode("overwrite").format("parquet").option("path", str(tmp_path / "right")).bucketBy(4, "k").sortBy("k")
    bucketed.saveAsTable("hot_keys.right_side")
    for side in (right, spark.table("hot_keys.right_side")):
        with settings(spark, **SHUFFLED):
            got = left_join_hot_right(left, side, ["k"])
            tasks = got.where("k = 7").groupBy(F.spark_partition_id().alias("p")).count().collect()
            assert sum(r["count"] for r in tasks) == right.where("k = 7").count()
            assert len(tasks) >= 3 and max(r["count"] for r in tasks) < 700  # of 1,000 rows of the key
            assert same(got, left.join(right, ["k"], "left"))


def brute(anchors, events):
    by = defaultdict(list)
    for k, t in events:
        by[k].append(t)
    return {a: min((e for e in by.get(k, ()) if k is not None and t is not None and e is not None and e >= t), default=None)
            for a, k, t in anchors}


@pytest.mark.parametrize("shape", ["day", "instant", "spread"])
def test_as_of_join_with_a_hot_key_day_and_instant(spark, shape):
    rng = random.Random(shape)
    base = datetime(2024, 3, 1)
    def moment(hot):
        if hot and shape == "instant":
            return base + timedelta(hours=5)
        return base + timedelta(seconds=rng.randrange(86_400 if hot and shape == "day" else 86_400 * 40))
    def key(i):
        return "hot" if i % 2 else rng.choice([None, "a", "b", "c"])
    anchors = [(i, key(i), None if i % 19 == 0 else moment(i % 2)) for i in range(900)]
    events = [(key(i), None if i % 23 == 0 else moment(i % 2)) for i in range(900)] + [(k, t) for _, k, t in anchors[:50]]
    a, e = spark.createDataFrame(anchors, "aid int, k string, t timestamp"), spark.createDataFrame(events, "k string, t timestamp")
    got = asof.first_at_or_after(a, e, "k", "t", "t", "nxt")
    assert got.columns == ["aid", "k", "t", "nxt"]
    assert {r.aid: r.nxt for r in got.collect()} == brute(anchors, events)

    ev = e.select(F.col("k").alias("_key"), F.col("t").alias("_et")).dropna().distinct()
    dealt = asof.sliced(a, ev, "k", "t", 8)
    hot = Counter(r._slice for r in dealt.where("_key = 'hot'").collect())
    assert len(hot) >= 3 and max(hot.values()) < 0.4 * sum(hot.values())
    assert asof.carries(dealt).count() < 8


def test_as_of_join_of_dates_and_timestamps(spark):
    a = spark.createDataFrame([(1, "x", date(2024, 1, 2)), (2, "x", date(2024, 1, 5))], "aid int, k string, d date")
    e = spark.createDataFrame([("x", datetime(2024, 1, 1, 9)), ("x", datetime(2024, 1, 2, 7)), ("x", datetime(2024, 1, 3))], "k string, t timestamp")
    assert {r.aid: r.n for r in asof.first_at_or_after(a, e, "k", "d", "t", "n").collect()} == {1: datetime(2024, 1, 2, 7), 2: None}


def options(spark, n=3000):
    rng = random.Random(1)
    rows = [(5 if i % 3 == 0 else rng.randrange(300), rng.randrange(40), rng.choice([None, date(2024, 1, 1 + rng.randrange(3))]),
             rng.choice([None, date(2024, 1, 1 + rng.randrange(3))]), rng.choice([None, Decimal("1.50"), Decimal("99.25")]), rng.choice([None, 1, 0]))
            for i in range(n)]
    return spark.createDataFrame(rows, "quote_id int, product_id int, updated_dt date, created_dt date, sub_total_premium decimal(18,2), flg_active int")


@pytest.mark.parametrize("descending", [True, False])
def test_hashed_top1_equals_the_struct_order(spark, descending):
    rows = options(spark)
    order = [F.coalesce("updated_dt", "created_dt"), F.col("sub_total_premium"), F.col("product_id")]
    payload = ["sub_total_premium", "product_id", "flg_active"]
    assert same(top1_hashed(rows, ["quote_id"], order, payload, descending), top1(rows, ["quote_id"], order, payload, descending))
    lone = rows.dropDuplicates(["quote_id", "updated_dt"])  # next to no ties
    order = [F.col("updated_dt"), F.col("product_id")]
    assert same(top1_hashed(lone, ["quote_id"], order, payload, descending), top1(lone, ["quote_id"], order, payload, descending))
    texts = rows.withColumn("t", F.lit("x"))  # a payload without a fixed width takes the sorted way
    assert same(top1_hashed(texts, ["quote_id"], order, ["t"], descending), top1(texts, ["quote_id"], order, ["t"], descending))


def test_latest_option_sorts_nothing(spark, capsys, monkeypatch):
    from uwlens.operators import latest
    plans, real = [], latest.materialized

    def recorded(df):
        capsys.readouterr()
        df.explain()
        plans.append(capsys.readouterr().out)
        return real(df)

    monkeypatch.setattr(latest, "materialized", recorded)
    latest_option(options(spark), ["sub_total_premium", "product_id"])
    assert "Sort" not in plans[0] and plans[0].count("HashAggregate") == 2


def test_preferred_quote_by_id(spark, capsys):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3] + [9] * 8), i - 100, rng.choice([None, "2024-01-01"]), f"c{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "submission_id int, quote_id int, bind_dt string, quote_code string")
    order = [F.col("bind_dt").isNull().cast("int"), F.col("quote_id")]
    assert same(preferred_quote(df, ["quote_id", "quote_code"]), top1(df, ["submission_id"], order, ["quote_id", "quote_code"], descending=False))
    capsys.readouterr()
    preferred_quote(df, ["quote_code"]).explain()
    assert "SortAggregate" not in capsys.readouterr().out
