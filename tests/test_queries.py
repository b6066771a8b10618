"""Every registered query with SQL gives the same rows as DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from tracksmith.plans import QUERIES, SQL, track_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def once():
    """The tracks and walks that many queries start from are made once for all of them."""
    patch, made = pytest.MonkeyPatch(), {}
    for name in ("_tracks", "_walked"):
        make = getattr(track_queries, name)

        def keep(spark, d, name=name, make=make):
            if name not in made:
                made[name] = make(spark, d)
            return made[name]

        patch.setattr(track_queries, name, keep)
    yield
    patch.undo()


def canon(rows, cols):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    cur = db.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    want = [dict(zip(cols, r, strict=True)) for r in cur.fetchall()]
    assert sorted(cols) == sorted(got.columns)
    assert canon([r.asDict() for r in got.collect()], sorted(cols)) == canon(want, sorted(cols))


@pytest.mark.parametrize("name", ["f8_binomial_interval", "f15_cut_flow", "h14_fit_profile"])
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 40
    assert set(entry.oracle_sql()) <= set(entry.queries())
