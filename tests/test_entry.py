import re

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = frame.astype(object).where(frame.notna(), None).map(lambda v: "" if v is None else repr(float(v)) if isinstance(v, float) else str(v))
    return sorted(map(tuple, text.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if re.match(r"[a-z]_|flagship", n)))
def test_query_equals_its_twin(spark, db, name):
    got, want = entry.queries()[name](spark, DIR).toPandas(), db.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
