"""Every text query runs on the smallest tables, on empty ones and on hostile ones."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from helpers import DATA, canonical
from intakeforge.llm import queries as Q

QUERIES = Q.registry.queries
FOUND = {"p1_found": ["proposal_id", "target_field"], "p3_found": ["line_id", "column_name"], "p6_found": ["vendor_id_a", "vendor_id_b"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "text_class"]}


def test_columns_are_those_asked_for(spark) -> None:  # noqa: ANN001
    assert {n: QUERIES[n](spark, DATA).columns for n in FOUND} == FOUND


def test_sql(spark) -> None:  # noqa: ANN001
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    for name, sql in Q.registry.sql.items():
        assert canonical(QUERIES[name](spark, DATA).toPandas()) == canonical(c.execute(sql).df()), name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name) -> None:  # noqa: ANN001
    assert QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", ["p3_found", "p6_found", "p7_found"])
def test_null_rows_and_clashing_columns_change_nothing(spark, hostile_dir, name) -> None:  # noqa: ANN001
    assert canonical(QUERIES[name](spark, hostile_dir).toPandas()) == canonical(QUERIES[name](spark, DATA).toPandas())


@pytest.mark.parametrize("name", ["p1_found", "p7_cleaned", "p8_mix_shares", "p9_found"])
def test_hostile_tables_run(spark, hostile_dir, name) -> None:  # noqa: ANN001
    assert QUERIES[name](spark, hostile_dir).count() > 0
