"""Every registered query over the bridge relations against DuckDB on the smallest tables."""

import duckdb
import pytest

from matchmill.plans import forecast, models, reads, reviewing, shown, upkeep  # noqa: F401  (they register their queries)
from matchmill.plans.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(rows):
    one = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    out = QUERIES[name](spark, DIR)
    if name not in ORACLE:
        assert out.count() > 0
        return
    want = duck.execute(ORACLE[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(out.columns) == columns
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert plain(out.select(*columns).collect()) == plain([r[i] for i in order] for r in want.fetchall())
