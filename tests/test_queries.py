import pytest

import __spark_entry__ as entry
from compare import DATA, connect, rows
from gridloom import queries


@pytest.fixture(scope="module")
def duck():
    return connect("sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    assert len(got)
    assert rows(got) == rows(duck.sql(queries.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_blocks_of_a_file_hold_all_cells_once(spark):
    plan = queries.QUERIES["split_plan_calculated"](spark, f"{DATA}/sf0.001").toPandas()
    assert plan.n_cells.sum() == queries.embeddings(spark, f"{DATA}/sf0.001").df.count()
    assert (plan.n_cells <= 1024).all() and plan.block.is_unique  # a block has at most 1024 cells


def test_splits_hold_all_records_once(spark):
    splits = queries.QUERIES["netcdf_splits"](spark, f"{DATA}/sf0.001").toPandas()
    records = sorted(i for a, b in zip(splits.first0, splits.last0, strict=True) for i in range(a, b + 1))
    assert records == list(range(len(records))) and splits.n_cells.sum() * 4 == splits.n_bytes.sum()
