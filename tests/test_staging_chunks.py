"""Files tokenized chunk by chunk, and what is rejected."""

from __future__ import annotations

import csv
import io
import random

import pytest

from helpers import rows
from intakeforge.sources import staging
from intakeforge.streaming.incremental import stage_arrivals


def lines(spark, path, chunk):  # noqa: ANN001, ANN201
    return staging.grids(spark.read.format("binaryFile").load(str(path)), chunk)


@pytest.mark.parametrize("chunk", [1, 3, 64, staging.CHUNK])
def test_chunks_of_any_size_give_the_records_of_csv(spark, tmp_path, chunk) -> None:  # noqa: ANN001
    rnd = random.Random(chunk)
    want = {}
    for f in ("a.csv", "b.csv"):
        table = [["id", "text"]] + [[str(i), "".join(rnd.choice('ab,"\n é') for _ in range(rnd.randint(0, 9)))] for i in range(12)]
        out = io.StringIO(newline="")
        csv.writer(out, quoting=csv.QUOTE_MINIMAL, lineterminator="\r\n" if f == "a.csv" else "\n").writerows(table)
        text = out.getvalue() + ("" if f == "a.csv" else "\n12,last")
        (tmp_path / f).write_bytes(text.encode())
        want |= {(f, i): r for i, r in enumerate(csv.reader(io.StringIO(text, newline="")))}
    got = lines(spark, tmp_path, chunk)
    assert got.filter("error IS NOT NULL").count() == 0
    assert {(r.source_file, r.row_idx): list(r.cells) for r in got.collect()} == want


def test_failed_records_keep_reason_place_and_text(spark, tmp_path) -> None:  # noqa: ANN001
    (tmp_path / "open.csv").write_text('k,v\n1,"x\n2,y\n3,z\n')
    (tmp_path / "part.csv").write_text('k,v\n1,"x" y\n2,\x01\n3,z\n')
    (tmp_path / "long.csv").write_text("k,v\n1," + "x" * 200_000 + "\n")
    (tmp_path / "bad.csv").write_bytes(b"a\0b")
    (tmp_path / "mac.csv").write_bytes(b"k,v\r1,x\r")
    for chunk in (4, staging.CHUNK):
        if chunk == 4:
            (tmp_path / "long.csv").rename(tmp_path / "long.keep")
        got = lines(spark, str(tmp_path / "*.csv"), chunk)
        bad = rows(staging.rejected(got).filter("row_number IS NOT NULL").select("source_file", "row_number", "reason", "at", "raw"))
        assert bad == [("open.csv", 2, "quoting", 2, '1,"x\n2,y\n3,z\n'), ("part.csv", 2, "quoting", 5, '1,"x" y\n'), ("part.csv", 3, "encoding", 2, "2,\x01\n")]
        assert rows(staging.rejected(got).filter("row_number IS NULL").select("source_file")) == [("bad.csv",)]
        good = {(r.source_file, r.row_number): dict(r.cells) for r in staging.stage(got, 0).collect()}
        assert good[("part.csv", 4)] == {"k": "3", "v": "z"} and good[("mac.csv", 2)] == {"k": "1", "v": "x"}
        if chunk == 4:
            (tmp_path / "long.keep").rename(tmp_path / "long.csv")
        else:
            assert len(good[("long.csv", 2)]["v"]) == 200_000


def test_stream_writes_rejects(spark, tmp_path) -> None:  # noqa: ANN001
    box, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    box.mkdir()
    (box / "a.csv").write_text('k,v\n1,x\n2,"y" z\n3,z\n')
    (box / "b.csv").write_bytes(b"a\0b")
    stage_arrivals(spark, str(box), out, cp).awaitTermination(120)
    (box / "again.csv").write_text('k,v\n1,x\n2,"y" z\n3,z\n')
    stage_arrivals(spark, str(box), out, cp).awaitTermination(120)
    assert rows(spark.read.parquet(out).select("source_file", "row_number")) == [("a.csv", 2), ("a.csv", 4)]
    assert rows(spark.read.parquet(f"{out}_rejected").select("source_file", "row_number", "reason", "at")) == [("a.csv", 3, "quoting", 5), ("b.csv", None, "ValueError: a NUL byte", None)]
