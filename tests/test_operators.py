import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from uwlens.operators.asof import first_at_or_after
from uwlens.operators.distinct import distinct_flags, merge_on
from uwlens.operators.existence import min_over_sources, semi_join_any
from uwlens.operators.latest import latest_option, preferred_quote, top1
from uwlens.operators.lookup import first_row_per_key


def test_top1_desc_puts_null_last_and_breaks_ties(spark):
    rows = [(1, None, 5), (1, 3, 1), (1, 3, 2), (2, None, 7)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    got = {r.k: r.v for r in top1(df, ["k"], [F.col("o")], ["v"], descending=True).collect()}
    assert got == {1: 2, 2: 7}


def test_preferred_quote_bound_first_then_lowest_id(spark):
    rows = [(10, 3, None), (10, 2, None), (10, 5, "2024-01-01"), (11, 9, None), (11, 8, None)]
    df = spark.createDataFrame(rows, "submission_id int, quote_id int, bind_dt string")
    got = {r.submission_id: r.quote_id for r in preferred_quote(df, ["quote_id"]).collect()}
    assert got == {10: 5, 11: 8}


def test_latest_option_tie_break(spark):
    d = datetime(2024, 1, 1)
    rows = [(1, 10, None, d, "100.00", 1), (1, 11, d, None, "200.00", 1), (1, 12, d, None, None, None),
            (1, 13, None, d + timedelta(days=1), "1.00", 0), (2, 20, None, None, "5", 1)]
    df = spark.createDataFrame(rows, "quote_id int, product_id int, updated_dt timestamp, created_dt timestamp, "
                                     "sub_total_premium string, flg_active int")
    got = {r.quote_id: r.product_id for r in latest_option(df, ["product_id"]).collect()}
    # quote 1: product 13 is newest but inactive; 10/11/12 tie on time -> highest premium (11)
    assert got == {1: 11, 2: 20}


def _brute(anchors, events):
    out = {}
    for aid, k, t in anchors:
        c = [e for ek, e in events if ek == k and t is not None and e >= t]
        out[aid] = min(c) if c else None
    return out


def test_first_at_or_after_sweep_matches_brute_force_with_hot_key(spark):
    rnd = random.Random(7)
    base = datetime(2024, 1, 1)
    keys = ["hot"] * 6 + [f"k{i}" for i in range(12)]
    anchors = [(i, rnd.choice(keys), None if i % 17 == 0 else base + timedelta(minutes=rnd.randrange(0, 60 * 24 * 20)))
               for i in range(400)]
    events = [(rnd.choice(keys), base + timedelta(minutes=rnd.randrange(0, 60 * 24 * 20))) for _ in range(900)]
    events += [(k, t) for _, k, t in anchors[:40] if t is not None]  # events at exactly an anchor instant
    a = spark.createDataFrame(anchors, "aid int, k string, t timestamp")
    e = spark.createDataFrame(events, "k string, t timestamp")
    got = {r.aid: r.nxt for r in first_at_or_after(a, e, "k", "t", "t", "nxt").collect()}
    assert got == _brute(anchors, events)


def test_first_at_or_after_unique_anchor(spark):
    base = datetime(2024, 1, 1)
    anchors = [("a", base), ("b", base + timedelta(days=3)), ("c", None), ("d", base)]
    events = [("a", base - timedelta(days=1)), ("a", base + timedelta(hours=1)), ("a", base + timedelta(days=9)),
              ("b", base), ("d", base)]
    a = spark.createDataFrame(anchors, "k string, t timestamp")
    e = spark.createDataFrame(events, "k string, et timestamp")
    got = {r.k: r.nxt for r in first_at_or_after(a, e, "k", "t", "et", "nxt", unique_anchor=True).collect()}
    assert got == {"a": base + timedelta(hours=1), "d": base}


def test_distinct_flags_equals_count_distinct(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, "x", "y"]), rnd.choice([None, 1, 2, 3, 4]), rnd.random() < 0.4, rnd.randrange(5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, id int, p boolean, v int")
    got = {r.g: (r.n, r.s) for r in distinct_flags(df, ["g"], "id", {"n": F.col("p")}, {"s": F.col("v")}).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        ids = {r[1] for r in rows if r[0] == g and r[2] and r[1] is not None}
        want[g] = (len(ids), sum(r[3] for r in rows if r[0] == g))
    assert got == want


def test_merge_on_treats_null_keys_as_one_group(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "g string, a int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "g string, b int")
    got = sorted((r.g or "", r.a, r.b) for r in merge_on(a, b, "g").collect())
    assert got == [("", 1, 10), ("x", 2, None), ("y", None, 20)]


def test_semi_join_any_and_min_over_sources(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "b int, q int")
    s1 = spark.createDataFrame([(1, 1, "2024-01-05")], "b int, q int, ts string")
    s2 = spark.createDataFrame([(2, 1, "2024-01-02"), (1, 1, "2024-01-03"), (1, 1, "2024-01-03")], "b int, q int, ts string")
    assert sorted(tuple(r) for r in semi_join_any(df, [s1, s2], ["b", "q"]).collect()) == [(1, 1), (2, 1)]
    got = sorted(tuple(r) for r in min_over_sources([s1, s2], ["b", "q"], "ts", "m").collect())
    assert got == [(1, 1, "2024-01-03"), (2, 1, "2024-01-02")]


def test_first_row_per_key_takes_one_whole_row(spark):
    df = spark.createDataFrame([(1, "b", "x"), (1, "a", "z"), (2, "c", None)], "k int, code string, name string")
    assert sorted(tuple(r) for r in first_row_per_key(df, "k", ["code", "name"]).collect()) == [(1, "a", "z"), (2, "c", None)]


def test_left_join_hot_right_equals_left_join(spark):
    from uwlens.operators.joins import left_join_hot_right
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, "d"), (3, "e")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "n"), (4, "w")], "k int, r string")
    got = sorted(map(repr, left_join_hot_right(left, right, ["k"]).collect()))
    want = sorted(map(repr, left.join(right, ["k"], "left").select("k", "l", "r").collect()))
    assert got == want


def test_operators_on_empty_inputs(spark):
    from uwlens.operators.documents import first_documents, tracer_extremes
    opts = spark.createDataFrame([], "quote_id int, product_id int, updated_dt timestamp, created_dt timestamp, "
                                     "sub_total_premium string, flg_active int")
    assert latest_option(opts, ["product_id"]).count() == 0
    files = spark.createDataFrame([], "file_id int, submission_number string, flg_active int, purge_status int")
    docs = spark.createDataFrame([], "file_id int, created_dt date, document_name string, purge_status int")
    assert first_documents(files, docs, {"d": F.col("document_name").like("%X%")}).count() == 0
    tr = spark.createDataFrame([], "quote_id int, created_dt date, tracer_desc string")
    assert tracer_extremes(tr, None, mins={"m": F.lit(True)}).count() == 0
    a = spark.createDataFrame([], "k string, t timestamp")
    e = spark.createDataFrame([], "k string, t timestamp")
    assert first_at_or_after(a, e, "k", "t", "t", "n").count() == 0


def test_first_documents_respects_liveness_and_null_keys(spark):
    from datetime import date
    from uwlens.operators.documents import first_documents
    files = spark.createDataFrame([(1, "S1", 1, None), (2, "S1", 0, None), (3, None, None, 0), (4, "S2", None, 1)],
                                  "file_id int, submission_number string, flg_active int, purge_status int")
    docs = spark.createDataFrame([
        (1, date(2024, 1, 5), "X", None), (1, date(2024, 1, 3), "X", 1),   # purged doc ignored
        (2, date(2024, 1, 1), "X", 0),                                     # inactive file ignored
        (3, date(2024, 1, 2), "X", 0),                                     # NULL submission kept as its own key
        (4, date(2024, 1, 1), "X", 0)], "file_id int, created_dt date, document_name string, purge_status int")
    got = {r.submission_number: r.d for r in first_documents(files, docs, {"d": F.col("document_name") == "X"}).collect()}
    assert got == {"S1": date(2024, 1, 5), None: date(2024, 1, 2)}


def test_min_over_sources_keeps_every_source_row(spark):
    s1 = spark.createDataFrame([(1, 1, "2024-01-09"), (1, 1, "2024-01-04")], "b int, q int, ts string")
    s2 = spark.createDataFrame([(1, 1, "2024-01-04"), (None, 1, "2024-01-01")], "b int, q int, ts string")
    got = sorted((r.b or 0, r.q, r.m) for r in min_over_sources([s1, s2], ["b", "q"], "ts", "m").collect())
    assert got == [(0, 1, "2024-01-01"), (1, 1, "2024-01-04")]


def test_positions_of_sorted_rows(spark, capsys):
    from uwlens.operators.ordering import with_position
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(9)]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    got = with_position(df.orderBy(F.col("k").desc(), F.col("v")).select("v", "k"))
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -1), r[1]))
    assert got.columns == ["v", "k", "position"]
    assert sorted((r.position, r.k, r.v) for r in got.collect()) == [(n, *r) for n, r in enumerate(order, 1)]
    capsys.readouterr()
    got.explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and "SinglePartition" not in plan
    assert with_position(df.where("v < 0").orderBy("v")).count() == 0


def test_bitmap_distinct_counts_merge_up_the_roll_up(spark, capsys):
    from uwlens.operators.distinct import distinct_counts, id_bitmaps, merged_bitmaps
    rng = random.Random(2)
    groups = {1: "A", 2: "A", 3: "B", 4: "B", 5: None, 6: "C"}
    rows = [(rng.choice([1, 2, 3, 4, 5]), rng.choice([None, -3, 5, *range(90_000, 90_040)]), rng.randrange(200_000)) for _ in range(4000)]
    rows += [(1, 77, 1), (2, 77, 2), (6, None, 3)]  # one submission of two agencies; an agency without submissions
    df = spark.createDataFrame([(groups[a], a, s, q) for a, s, q in rows], "code string, agency int, s int, q long")
    ids = {"subs": "s", "quotes": "q"}
    maps = id_bitmaps(df, ["code", "agency"], ids)
    def brute(key):
        keys = {key(r) for r in rows}
        return {k: (len({r[1] for r in rows if key(r) == k and r[1] is not None}), len({r[2] for r in rows if key(r) == k})) for k in keys}
    fine = {r.agency: (r.subs, r.quotes) for r in distinct_counts(maps, ["agency"], list(ids)).collect()}
    assert fine == brute(lambda r: r[0]) and fine[6][0] == 0
    coarse = distinct_counts(merged_bitmaps(maps, ["code"]), ["code"], list(ids))
    assert {r.code: (r.subs, r.quotes) for r in coarse.collect()} == brute(lambda r: groups[r[0]])
    capsys.readouterr()
    coarse.explain()
    assert "Expand" not in capsys.readouterr().out
