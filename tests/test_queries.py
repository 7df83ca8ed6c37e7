"""Every registered query with SQL gives the rows of that SQL."""

import glob
import math
import os

import pytest

from quillgraph.plans import catalog, parser
from quillgraph.plans.star_queries import QUERIES

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    v = float(v)
    return "nan" if math.isnan(v) else round(v, 4)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DIR).count() > 0


def test_every_function_has_a_query():
    seen = set()
    for text, _ in QUERIES.values():
        for t in parser.lex(text):
            seen.add(t.text.lower())
    missing = (parser.SCALARS | parser.AGGREGATES) - seen
    assert missing <= {"ltrim", "rtrim"}
