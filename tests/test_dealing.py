"""Shuffle partitions follow the size of the input, so that a task's memory does not."""

import pytest

from uwlens import session
from uwlens.sources import fixtures

PARTITIONS = "spark.sql.shuffle.partitions"


@pytest.fixture
def restored(spark):
    before = {k: spark.conf.get(k, None) for k in (PARTITIONS, session.ADVISORY_SIZE)}
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_partitions_grow_with_the_input_and_never_shrink(restored):
    restored.conf.set(PARTITIONS, "8")
    restored.conf.unset(session.ADVISORY_SIZE)
    session.deal_by_size(restored, 1 << 20)
    assert restored.conf.get(PARTITIONS) == "8" and restored.conf.get(session.ADVISORY_SIZE) == "8m"
    session.deal_by_size(restored, 6 << 30)
    assert int(restored.conf.get(PARTITIONS)) == (6 << 30) // session.INPUT_BYTES_A_PARTITION
    restored.conf.set(session.ADVISORY_SIZE, "3m")
    session.deal_by_size(restored, 1 << 20)
    assert int(restored.conf.get(PARTITIONS)) == (6 << 30) // session.INPUT_BYTES_A_PARTITION
    assert restored.conf.get(session.ADVISORY_SIZE) == "3m"


def test_derived_tables_are_dealt_by_the_size_of_the_source_files(restored, monkeypatch):
    monkeypatch.setattr(session, "INPUT_BYTES_A_PARTITION", 1 << 12)
    restored.conf.set(PARTITIONS, "2")
    fixtures.derive_tables(restored, "/root/testdata/sf0.001")
    assert int(restored.conf.get(PARTITIONS)) > 2


def test_a_line_join_made_once_gives_the_same_tables(restored, tmp_path, capsys):
    shifted = tmp_path / "sf"
    for n in fixtures.SOURCE_TABLES:
        rows = restored.read.parquet(f"/root/testdata/sf0.001/{n}.parquet")
        (rows.unionByName(rows.limit(7)) if n in ("orders", "lineitem") else rows).write.parquet(f"{shifted}/{n}.parquet")
    each, once = (fixtures.derive_tables(restored, str(shifted), lines_once=x) for x in (False, True))
    for n in fixtures.TABLE_NAMES:
        a, b = getattr(each, n), getattr(once, n)
        assert a.schema == b.schema and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), n
    capsys.readouterr()
    once.bms_options_mst.explain()
    assert "Join" not in capsys.readouterr().out


@pytest.mark.parametrize("name", ["src_scan", "kpi1_backfill"])
def test_queries_over_many_tables_join_the_lines_once(restored, monkeypatch, name):
    import __spark_entry__ as E

    made = []
    real = fixtures._line_rows
    monkeypatch.setattr(fixtures, "_line_rows", lambda src: made.append(1) or real(src))
    E.queries()[name](restored, "/root/testdata/sf0.001")
    assert made == [1]
