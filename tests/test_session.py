"""Scratch tables: written once, dropped when their block ends."""

import os

from rollcall.session import forget, saved, scratch


def folder(df):
    return df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")


def test_scratch_tables_are_dropped_but_for_those_kept(spark):
    before = {t.name for t in spark.catalog.listTables()}
    with scratch(spark) as keep:
        plain, dealt = saved(spark.range(5), "plain"), saved(spark.range(50).repartition(2), "dealt", 4, "id")
        kept = keep(saved(dealt.selectExpr("id + 1 as id"), "kept"))
        gone = saved(spark.range(3), "gone")
        forget(gone)
        paths = [folder(plain), folder(dealt), folder(kept)]
        assert all(map(os.path.isdir, paths)) and len(spark.catalog.listTables()) == len(before) + 1
    assert [os.path.isdir(p) for p in paths] == [False, False, True]
    assert kept.count() == 50 and {t.name for t in spark.catalog.listTables()} == before
    forget(kept)
    assert not os.path.isdir(paths[2])
