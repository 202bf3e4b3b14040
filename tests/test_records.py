"""Record tokenizer against brute force, chunk composition, and the reasons."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import rows
from intakeforge.operators import records as R


def brute(text: str, d: str) -> tuple[list[str], bool]:
    """One character at a time, written for plainness."""
    out, i = [], 0
    while True:
        if text[i : i + 1] == '"':
            i, cell = i + 1, ""
            while True:
                if i >= len(text):
                    return out, True
                if text[i] == '"':
                    if text[i + 1 : i + 2] == '"':
                        cell, i = cell + '"', i + 2
                        continue
                    break
                cell, i = cell + text[i], i + 1
            i += 1
            if i < len(text) and text[i] != d:
                return out, True
        else:
            j = text.find(d, i)
            j = len(text) if j < 0 else j
            cell, i = text[i:j], j
        out.append(cell)
        if i >= len(text):
            return out, False
        i += 1


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet='a";\n ', max_size=14))
def test_tokenize_equals_brute_force(text: str) -> None:
    cells, fault = R.tokenize(text, ";")
    want, bad = brute(text, ";")
    assert (fault >= 0) == bad
    if not bad:
        assert cells == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='a";\n', max_size=6), max_size=8))
def test_chunk_maps_compose(chunks: list[str]) -> None:
    maps = [R.text_transition(c, ";") for c in chunks]
    assert R.compose_all(maps) == R.text_transition("".join(chunks), ";")
    assert all(R.text_transition("".join(chunks[:k]), ";")[R.START] == e for k, e in enumerate(R.sequential_entry(chunks, ";")))


def test_entry_states_over_spark(spark) -> None:  # noqa: ANN001
    rnd = random.Random(3)
    texts = ["".join(rnd.choice('ab";\n') for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    df = spark.createDataFrame([(f, k, t) for f in (1, 2) for k, t in enumerate(texts[30 * f - 30 : 30 * f])], "file_id int, chunk_no long, text string")
    from pyspark.sql import functions as F

    got = R.entry_states(R.chunk_transitions(df, delimiter=F.lit(";")), span=4)
    want = [(f, k, e) for f in (1, 2) for k, e in enumerate(R.sequential_entry(texts[30 * f - 30 : 30 * f], ";"))]
    assert rows(got.select("file_id", "chunk_no", "entry")) == sorted(want, key=repr)


def test_records_end_outside_quotes_only() -> None:
    assert R.split_records('a;"b\nc"\nd\n', ";") == [8, 10]


def test_reasons_in_order() -> None:
    types = ["int", "string", "date:mdy/"]
    case = lambda text: R.read_record(text, ";", types)[:2]
    assert case("1;x;02/28/2026") == (None, -1)
    assert case("1;x�") == ("encoding", 3)
    assert case("1;\x1a;02/28/2026") == ("encoding", 2)
    assert case('1;"x;02/28/2026') == ("quoting", 2)
    assert case('1;"x" y;02/28/2026') == ("quoting", 5)
    assert case("1;x") == ("column_count", 2)
    assert case("1,5;x;02/28/2026") == ("bad_value", 0)
    assert case("1;x;02/30/2026") == ("bad_value", 2)
    assert case(' N/A ;3" pipe;-') == (None, -1)
    assert case('"1,500";"say ""hi""";2/1/2026') == (None, -1)


def test_very_long_record() -> None:
    text = ";".join(['"' + "x" * 100_000 + '"'] * 20)
    cells, fault = R.tokenize(text, ";")
    assert fault == -1 and len(cells) == 20


def test_unknown_object_and_blank(spark) -> None:  # noqa: ANN001
    raw = spark.createDataFrame([(1, 9, 1, "a;b"), (2, 7, 0, "h;h"), (3, 7, 1, "  "), (4, 7, 1, "1;x"), (4, 7, 1, "1;x"), (5, None, 1, "z"), (6, 7, 2, None)], "raw_id long, source_object_id long, row_idx int, raw_text string")
    obj = spark.createDataFrame([(7, None, ";", 0, '["a","b"]', "not json")], "source_object_id long, ingested_at timestamp, delimiter string, header_row int, columns_json string, profile_json string")
    got = rows(R.read_records(raw, obj).select("raw_id", "reason"))
    assert got == sorted([(1, "unknown_object"), (4, None), (4, None), (5, "unknown_object")], key=repr)
    assert R.failed_records(raw, obj).count() == 0
