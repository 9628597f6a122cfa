"""Every query with SQL against DuckDB, and every query's plan for what must not be in it."""

import os
import re

import duckdb
import pytest

from sitewarden.operators import signals
from sitewarden.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(x):
    return "" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)


#: Queries that test_planner runs over the same tables against plain crawls.
ELSEWHERE = ("crawl_plan_rounds", "crawl_plan_summary", "nav_discovery")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in ELSEWHERE])
def test_query(spark, db, name):
    table = catalogue.QUERIES[name](spark, SF).toArrow()
    cols = sorted(table.column_names)
    mine = sorted(tuple(shown(r[c]) for c in cols) for r in table.to_pylist())
    if name not in catalogue.ORACLES:
        assert mine
        return
    rel = db.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert mine == sorted(tuple(shown(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_scan_is_pruned(spark):
    plan = catalogue.QUERIES["task_stuck_sweep"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_comment" not in plan and "o_totalprice" not in plan
    plan = catalogue.QUERIES["url_normalize"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_about_facts_whole_text(spark, db):
    """The registered query against Python's regular expressions over whole texts."""
    first = lambda patterns, text: next((m[1] for m in (re.search(p, text, re.ASCII) for p in patterns) if m), None)
    want, late = {}, 0
    for doc, text in db.sql(f"with {catalogue.cte('risk_pages')} select doc_id, page_text from risk_pages").fetchall():
        late += len(text) > 1200
        text += (" Our mission: to build tools for every shop in town.", " Services include repairs, cleaning and deliveries of all kinds.", "")[doc % 3] + " 12 High Street, Old Town 12345"
        address = re.search(signals.ADDRESS, text, re.ASCII)
        want[doc] = (text[:1000] + "..." if len(text) > 1000 else text if len(text) > 50 else None, first(signals.MISSION, text), first(signals.OFFERINGS, text), address and address[0])
    got = {r["doc_id"]: (r["summary"], r["mission"], r["offerings"], r["address"]) for r in catalogue.QUERIES["about_facts"](spark, SF).collect()}
    assert late > 100 and got == want
    assert {doc for doc in want if doc % 3 == 0} <= {doc for doc, r in got.items() if r[1]} and all(r[3] for r in got.values())
