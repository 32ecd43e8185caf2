"""Every registered query of the engine against its DuckDB SQL."""

import math

import duckdb
import pytest

from rollcall.operators import analytics, rounds, verdicts
from rollcall.plans import catalogue, people

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def same(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.12g}")
    return x


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    found = catalogue.queries()[name](spark, SF)
    rows = found.collect()
    if name not in catalogue.oracle_sql():
        assert rows
        return
    expected = duck.sql(catalogue.oracle_sql()[name])
    cols = sorted(found.columns)
    assert cols == sorted(expected.columns)
    at = [expected.columns.index(c) for c in cols]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    mine = sorted((tuple(same(r[c]) for c in cols) for r in rows), key=key)
    theirs = sorted((tuple(same(r[i]) for i in at) for r in expected.fetchall()), key=key)
    assert mine == theirs


def broadcasts(df):
    """The columns of each table that the plan of df sends through the driver."""
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "BroadcastExchange":
            found.append({c.split("#")[0] for c in node.output().mkString(" ").split()})
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


@pytest.mark.parametrize("name", ["drive_outcome", "evidence"])
def test_people_never_pass_whole_through_the_driver(spark, monkeypatch, name):
    sent = []
    for module in (analytics, rounds, verdicts, people):
        monkeypatch.setattr(module, "saved", lambda df, name, keep=module.saved: (sent.extend(broadcasts(df)), keep(df, name))[1], raising=False)
    sent += broadcasts(catalogue.queries()[name](spark, SF))
    people_of = [x for x in sent if x & {"subject_id", "value", "reg_no", "neo_id"} and "clear" not in x]  # a few for each kind of list
    assert sent and not people_of
