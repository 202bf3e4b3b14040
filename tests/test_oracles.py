"""Every query with SQL gives the rows of DuckDB, on the smallest tables; all run on empty and hostile tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from helpers import DATA, canonical
from intakeforge.plans import intake, reference

QUERIES = intake.registry.queries | reference.registry.queries
SQL = intake.registry.sql | reference.registry.sql


@pytest.fixture(scope="session")
def duck() -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):  # noqa: ANN001, ANN201
    assert canonical(QUERIES[name](spark, DATA).toPandas()) == canonical(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("p")))
def test_empty_tables(spark, empty_dir, name):  # noqa: ANN001, ANN201
    assert QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", ["p2_found", "p4_found", "p5_found"])
def test_null_rows_and_clashing_columns_change_nothing(spark, hostile_dir, name):  # noqa: ANN001, ANN201
    found, plain = canonical(QUERIES[name](spark, hostile_dir).toPandas()), canonical(QUERIES[name](spark, DATA).toPandas())
    assert found == plain


@pytest.mark.parametrize("name", ["p2_load", "p4_unified_rows", "p5_masks", "p5_profile"])
def test_hostile_tables_run(spark, hostile_dir, name):  # noqa: ANN001, ANN201
    assert QUERIES[name](spark, hostile_dir).count() > 0
