"""Ids whose names consist of initials, trades, legal forms, fillers or another script."""

from __future__ import annotations

from helpers import rows
from intakeforge.llm import name_links


def test_ids_without_own_words_are_linked(spark) -> None:  # noqa: ANN001
    names = {
        "a1": ["K & G Trading Ltd"], "a2": ["K. & G. Trading"], "a3": ["K & H Trading Ltd"], "a4": ["K & G Plastics"],
        "b1": ["The Steel Company"], "b2": ["The Steel Company", "THE STEEL CO"], "b3": ["Printing Services Ltd"],
        "c1": ["ООО Ромашка"], "c2": ["ооо «Ромашка»"], "c3": ["ООО Лютик"], "d1": ["北京钢铁有限公司"], "d2": ["北京钢铁有限公司"], "d3": ["上海电子贸易"],
        "e1": ["The Company", "Zetomar Vukal Plastics"], "e2": ["Zetomar Vukal Plastics"], "f1": ["The Company"],
        "g1": ["&&&"], "g2": ["+++"], "h1": ["北 K 钢铁"], "h2": ["上 K 电子"], "n1": [None, "N/A"],
    }
    df = spark.createDataFrame([(i, n) for i, own in names.items() for n in own], "vendor_id string, vendor_name string")
    assert rows(name_links.linked_pairs(df)) == [("a1", "a2"), ("b1", "b2"), ("c1", "c2"), ("d1", "d2"), ("e1", "e2")]
