"""Every query of the library against its SQL on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from docspark.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return c


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in SQL:
        rows = con.execute(SQL[name])
        names = [d[0] for d in rows.description]
        assert sorted(names) == columns
        want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in rows.fetchall())
        number = lambda rows: Counter({tuple(f"{float(v):.9g}" if isinstance(v, int) and not isinstance(v, bool) else v for v in r): n for r, n in rows.items()})
        assert number(got) == number(want)
