"""Counts of words past the bound of the dictionaries."""

from __future__ import annotations

import pytest

from helpers import DATA, rows
from intakeforge.llm import mojibake


@pytest.mark.parametrize("limit", [0, 3])
def test_the_bound_of_the_dictionaries_leaves_counts_whole(spark, monkeypatch, limit) -> None:  # noqa: ANN001
    cells = spark.read.parquet(f"{DATA}/invoices_2026_08.parquet").select("line_id", "description", "vendor_name")
    words = [(10_000 + i, "głęboki żółty pręt", None) for i in range(9)] + [(20_000, "głęboki żółty pręt".encode("cp1250").decode("cp1252"), None)]
    cells = cells.unionByName(spark.createDataFrame(words, "line_id long, description string, vendor_name string"))
    texts = cells.selectExpr("stack(2, description, vendor_name) AS text").filter(mojibake.suspicious(mojibake.F.col("text"))).groupBy("text").count().withColumnRenamed("count", "n")
    fixed = mojibake.build_dictionaries(mojibake.word_counts(texts))
    monkeypatch.setattr(mojibake, "build_dictionaries", lambda counts: fixed)
    want = rows(mojibake.find_garbled(cells))
    assert any(r[0] == 20_000 and r[4] == "głęboki żółty pręt" for r in want)
    assert rows(mojibake.find_garbled(cells, max_words=limit)) == want
