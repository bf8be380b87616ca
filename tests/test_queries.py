import os

import duckdb
import numpy as np
import pytest

from tensorframe import queries as core
from tensorframe.tensor import from_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


def rows(df, columns):
    values = df[columns].astype(object).where(df[columns].notna(), None).values.tolist()
    return sorted(repr([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in values)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, db, name):
    found = core.QUERIES[name](spark, SF).toPandas()
    if name in core.ORACLE:
        want = db.execute(core.ORACLE[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found, sorted(found.columns)) == rows(want, sorted(found.columns))
    else:
        assert len(found)


@pytest.mark.parametrize("most, kind", [(900, "bigint"), (40_000, "decimal(38,0)")])
def test_four_operands_beyond_64_bits(spark, monkeypatch, most, kind):
    cells = {(i, j): most - (7 * i + 3 * j) % 11 for i in range(25) for j in range(25)}
    monkeypatch.setattr(core, "nn", lambda *_: from_rows(spark, [(*c, v) for c, v in cells.items()], (25, 25)))
    found = core.QUERIES["e5_four_operands"](spark, SF)
    a = np.array([[cells[i, j] for j in range(25)] for i in range(25)], dtype=object)
    want = a @ a @ a @ a
    assert dict(found.dtypes)["v"] == kind
    assert {(r.i0, r.i1): int(r.v) for r in found.collect()} == {c: want[c] for c in cells}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 100
    assert e.oracle_sql().keys() <= e.queries().keys()
