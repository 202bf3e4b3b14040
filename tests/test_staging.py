"""Files of several kinds staged in batch and as a stream."""

from __future__ import annotations

import zipfile

import pytest

from intakeforge.sources import staging
from intakeforge.streaming.incremental import stage_arrivals

CSV = "Report;;\n\nId;Größe;\n1; klein ;x\n2;N/A;\n;;\n3;\"a;b\"\n"


def book(path) -> None:  # noqa: ANN001
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Items" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><t>Day</t></si><si><t>Bolt</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>Qty</t></is></c></row><row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3" s="1"><v>46250</v></c><c r="C3"><v>7</v></c></row></sheetData></worksheet>')


@pytest.fixture
def inbox(tmp_path):  # noqa: ANN001, ANN201
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.csv").write_bytes(CSV.encode("cp1252"))
    (d / "b.tsv").write_bytes("x\ty\n1\t2\n".encode("utf-16"))
    (d / "broken.csv").write_bytes(b"a\0b")
    (d / "other.parquet").write_bytes(b"PAR1")
    book(d / "c.xlsx")
    return d


def test_decode_and_sniff() -> None:
    assert staging.decode("é;1".encode("cp1252")) == ("é;1", "cp1252")
    assert staging.decode(b"\xef\xbb\xbfa") == ("a", "utf-8-sig")
    assert staging.sniff_delimiter("a;b,c\n1;2\n3;4") == ";"
    assert staging.sniff_delimiter("one\ntwo") == ","


def test_stage(spark, inbox) -> None:  # noqa: ANN001
    lines = staging.read_files(spark, str(inbox))
    errors = {r.source_file: r.error for r in lines.filter("error IS NOT NULL").collect()}
    assert set(errors) == {"broken.csv", "other.parquet"}
    got = {(r.source_file, r.row_number): dict(r.cells) for r in staging.stage(lines).collect()}
    assert got[("a.csv", 4)] == {"Id": "1", "Größe": "klein", "column_3": "x"}
    assert got[("a.csv", 7)] == {"Id": "3", "Größe": "a;b", "column_3": ""}
    assert ("a.csv", 6) not in got
    assert got[("c.xlsx", 3)] == {"Name": "Bolt", "Day": "2026-08-16", "Qty": "7"}
    assert got[("b.tsv", 2)] == {"x": "1", "y": "2"}


def test_stream_stages_contents_once(spark, inbox, tmp_path) -> None:  # noqa: ANN001
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    stage_arrivals(spark, str(inbox), out, cp).awaitTermination(120)
    n = spark.read.parquet(out).count()
    (inbox / "again.csv").write_bytes(CSV.encode("cp1252"))
    (inbox / "new.csv").write_text("k,v\n1,2\n")
    stage_arrivals(spark, str(inbox), out, cp).awaitTermination(120)
    files = {r.source_file for r in spark.read.parquet(out).collect()}
    assert "new.csv" in files and "again.csv" not in files and spark.read.parquet(out).count() == n + 1
