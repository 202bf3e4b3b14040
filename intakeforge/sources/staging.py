"""Received files staged as text: decoding, delimiter, records, header row, lineage. Files are read by executors only."""

from __future__ import annotations

import datetime
import hashlib
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intakeforge.functions.values import is_null_like, strip
from intakeforge.operators import profiling, records
from intakeforge.operators.casting import LINEAGE
from intakeforge.operators.records import tokenize
from intakeforge.session import cut

TEXT_SUFFIXES, BOOK_SUFFIXES = (".csv", ".tsv", ".txt"), (".xlsx", ".xlsm")
# Encodings in the order in which they are tried, and delimiters in order of preference.
ENCODINGS = ["utf-8-sig", "utf-8", "cp1252", "latin-1"]
DELIMITERS = [",", ";", "\t", "|"]
#: Characters of a file that are tokenized at a time.
CHUNK = 1 << 20


def decode(data: bytes) -> tuple[str, str]:
    """(text, encoding). UTF-16 needs its mark; a NUL byte is no text."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16"), "utf-16"
    if b"\0" in data:
        raise ValueError("a NUL byte")
    for e in ENCODINGS:
        if e == "utf-8-sig" and not data.startswith(b"\xef\xbb\xbf"):
            continue
        try:
            return data.decode(e), e
        except UnicodeDecodeError:
            pass
    raise ValueError("no known encoding")


def sniff_delimiter(text: str, lines: int = 50) -> str:
    """The delimiter that splits most lines into one same number of cells, weighted by that number; comma where none does."""
    head = [x for x in text.splitlines() if x.strip()][:lines]

    def weight(d: str) -> int:
        counts = Counter(n for x in head if (n := len(tokenize(x, d)[0]) - 1) > 0)
        return max((k * n for n, k in counts.items()), default=0)

    best = max(DELIMITERS, key=weight)
    return best if weight(best) else ","


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_DATE_STYLE = re.compile(r"[ymdhs]", re.I)


def read_book(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet, rows of text) of a workbook, values only, without empty rows at the end."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")] if "xl/sharedStrings.xml" in names else []
        dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ET.fromstring(z.read("xl/styles.xml"))
            codes = {int(n.get("numFmtId", 0)): n.get("formatCode", "") for n in styles.iter(f"{_SHEET}numFmt")}
            xfs = styles.find(f"{_SHEET}cellXfs")
            for xf in xfs if xfs is not None else []:
                k = int(xf.get("numFmtId", 0))
                dates.append(14 <= k <= 22 or 45 <= k <= 47 or bool(_DATE_STYLE.search(re.sub(r'"[^"]*"|\[[^\]]*\]', "", codes.get(k, "")))))
        rels = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
            target = rels[s.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")].lstrip("/")
            rows: list[list[str]] = []
            for r in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_SHEET}row"):
                cells: list[str] = []
                for c in r.iter(f"{_SHEET}c"):
                    ref = re.match(r"[A-Z]+", c.get("r", ""))
                    at = sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(ref.group()))) - 1 if ref else len(cells)
                    cells += [""] * (at - len(cells))
                    cells.append(_book_cell(c, shared, dates))
                number = int(r.get("r", len(rows) + 1))
                rows += [[] for _ in range(number - 1 - len(rows))]
                rows.append(cells)
            while rows and not any(x.strip() for x in rows[-1]):
                rows.pop()
            out.append((s.get("name", ""), rows))
        return out


_EPOCH = datetime.datetime(1899, 12, 30)


def _number_text(number: float, is_date: bool) -> str:
    """Whole numbers have no decimals and days no time."""
    if not is_date:
        return f"{number:.0f}" if number == int(number) else repr(number)
    day = _EPOCH + datetime.timedelta(days=number)
    return day.isoformat(" ")[: 10 if number == int(number) else None]


#: The text of a workbook's cell by its kind, from its value, the shared texts, and whether its style is one of dates.
_RENDER = {
    "s": lambda v, shared, _: shared[int(v)],
    "b": lambda v, *_: "true" if v == "1" else "false",
    "n": lambda v, _, is_date: _number_text(float(v), is_date),
}


def _book_cell(c: ET.Element, shared: list[str], dates: list[bool]) -> str:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
    value, style = c.findtext(f"{_SHEET}v"), int(c.get("s", 0))
    if value is None:
        return ""
    return _RENDER.get(kind, lambda v, *_: v)(value, shared, style < len(dates) and dates[style])


_PART = pa.schema([("path", pa.string()), ("source_file", pa.string()), ("sheet", pa.string()), ("content_hash", pa.string()), ("encoding", pa.string()), ("delimiter", pa.string()), ("chunk_no", pa.int64()), ("text", pa.string()), ("row_idx", pa.int32()), ("cells", pa.list_(pa.string())), ("error", pa.string())])
_PIECE = pa.schema([("local", pa.int32()), ("whole", pa.bool_()), ("cells", pa.list_(pa.string())), ("error", pa.string()), ("at", pa.int32()), ("raw", pa.string())])
_FILE = ["path", "source_file", "content_hash", "encoding", "delimiter"]
PART = "path string, source_file string, sheet string, content_hash string, encoding string, delimiter string, chunk_no long, text string, row_idx int, cells array<string>, error string"
PIECE = "path string, source_file string, content_hash string, encoding string, delimiter string, chunk_no long, local int, whole boolean, cells array<string>, error string, at int, raw string"


def _parts(path: str, data: bytes, size: int) -> Iterator[tuple]:
    """A text as chunks, a workbook as lines of cells, anything else as one row with its error."""
    name = path.rsplit("/", 1)[-1]
    digest = hashlib.sha256(data).hexdigest()
    try:
        if name.lower().endswith(BOOK_SUFFIXES):
            yield from [(path, name, sheet, digest, None, None, None, None, i, row, None) for sheet, rows in read_book(data) for i, row in enumerate(rows)]
            return
        if not name.lower().endswith(TEXT_SUFFIXES):
            yield path, name, None, digest, None, None, None, None, -1, [], "no known kind of file"
            return
        text, encoding = decode(data)
        if "\n" not in text:
            text = text.replace("\r", "\n")  # files of the kind that end lines by carriage returns alone
        d = sniff_delimiter(text)
        if not text:
            yield path, name, None, digest, encoding, d, None, None, -1, [], "no rows"
        for k in range(0, len(text), size):
            yield path, name, None, digest, encoding, d, k // size, text[k : k + size], None, None, None
    except (ValueError, KeyError, zipfile.BadZipFile, ET.ParseError) as e:
        yield path, name, None, digest, None, None, None, None, -1, [], f"{type(e).__name__}: {e}"[:200]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each chunk; chunks one by one, so that a task never holds the cells of more than one."""
    for b in batches:
        for k, (text, delimiter, entry) in enumerate(zip(b.column("text").to_pylist(), b.column("delimiter").to_pylist(), b.column("entry").to_pylist())):
            found = records.split_chunk_records(text, delimiter, entry)
            own = [pa.array([b.column(c)[k].as_py()] * len(found), b.column(c).type) for c in (*_FILE, "chunk_no")]
            columns = zip(*[(i, whole, cells, reason, at, None if whole and reason is None else piece) for i, (whole, piece, reason, at, cells) in enumerate(found)])
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, f.type) for c, f in zip(columns, _PIECE)]], names=[*_FILE, "chunk_no", *_PIECE.names])


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of the records that lie in several chunks, from their whole text."""
    for b in batches:
        raw = b.column("raw").to_pylist()
        found = [records.record_cells(t, d) for t, d in zip(raw, b.column("delimiter").to_pylist())]
        kept = [None if r[0] is None else t for t, r in zip(raw, found)]
        columns = [pa.array([r[2] for r in found], pa.list_(pa.string())), pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.int32()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("source_file", "content_hash", "encoding", "delimiter", "row_idx")], *columns], names=["source_file", "content_hash", "encoding", "delimiter", "row_idx", "cells", "error", "at", "raw"])


def grids(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Lines of cells of every file of a ``binaryFile`` frame; what cannot be read gives a row with its error and no cells.

    A file is decoded by one task, and handed on in chunks. Their entry states are composed from their state maps, and every
    chunk is tokenized from its own; pieces of a record at the borders of chunks have one row number and are put together.
    A record that fails has the reason, the offset in it (``at``) and its text (``raw``): an open quote takes the rest of the
    file into one such record. A file that fails has row_idx -1.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                part: list[tuple] = []
                for row in _parts(path, data, chunk):
                    part.append(row)
                    if row[7] is not None or len(part) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _PART)], schema=_PART)
                        part = []
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _PART)], schema=_PART)

    parts = cut(files.select("path", "content").mapInArrow(read, PART))
    out = ["source_file", "sheet", "content_hash", "encoding", "delimiter", "row_idx", "cells", "error", "at", "raw"]
    direct = parts.filter("chunk_no IS NULL").withColumn("at", F.lit(None).cast("int")).withColumn("raw", F.lit(None).cast("string")).select(out)
    texts = parts.filter("chunk_no IS NOT NULL")
    entry = records.entry_states(records.chunk_transitions(texts, delimiter=F.col("delimiter")), "path", "chunk_no")
    pieces = cut(texts.select(*_FILE, "chunk_no", "text").join(entry, ["path", "chunk_no"]).select(*_FILE, "chunk_no", "text", "entry").mapInArrow(_split, PIECE))
    before = Window.partitionBy("path").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    base = pieces.groupBy("path", "chunk_no").agg(F.max("local").alias("ends")).select("path", "chunk_no", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("base"))
    placed = pieces.join(base, ["path", "chunk_no"]).withColumn("row_idx", (F.col("base") + F.col("local")).cast("int")).withColumn("sheet", F.lit(None).cast("string"))
    edge = placed.filter("NOT whole").groupBy(*_FILE, "row_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "local", "raw"))), lambda x: x["raw"]), "").alias("raw"))
    joined = edge.filter("raw <> ''").mapInArrow(_tokenize, "source_file string, content_hash string, encoding string, delimiter string, row_idx int, cells array<string>, error string, at int, raw string")
    return direct.unionByName(placed.filter("whole").select(out)).unionByName(joined.withColumn("sheet", F.lit(None).cast("string")).select(out))


def rejected(lines: DataFrame) -> DataFrame:
    """Records and files that could not be read: file, row number (NULL for a whole file), reason, offset and the record's text."""
    bad = lines.filter("error IS NOT NULL")
    return bad.select("source_file", "sheet", "content_hash", F.when(F.col("row_idx") >= 0, F.col("row_idx") + 1).alias("row_number"), F.col("error").alias("reason"), F.when(F.col("at") >= 0, F.col("at")).alias("at"), "raw")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return grids(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path))


def unique_names(names: Column, reserved: list[str] | None = None) -> Column:
    """The names of an array made unique in their order, ignoring case and clear of ``reserved``: ``a``, ``a_2``, ``a_3``."""
    start = F.struct(F.lit([r.lower() for r in reserved or []]).cast("array<string>").alias("taken"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, name: Column) -> Column:
        ways = F.transform(F.sequence(F.lit(1), F.size(acc["taken"]) + 1), lambda k: F.when(k == 1, name).otherwise(F.concat(name, F.lit("_"), k.cast("string"))))
        free = F.get(F.filter(ways, lambda w: ~F.array_contains(acc["taken"], F.lower(w))), F.lit(0))
        return F.struct(F.array_append(acc["taken"], F.lower(free)).alias("taken"), F.array_append(acc["out"], free).alias("out"))

    return F.aggregate(names, start, add, lambda acc: acc["out"])


def unique_headers(raw: Column) -> Column:
    """Headers with single spaces, blanks named ``column_<position>``, unique and clear of the lineage columns."""
    named = F.transform(raw, lambda h, i: F.coalesce(F.nullif(strip(F.regexp_replace(h, r"\s+", " ")), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string"))))
    return unique_names(named, LINEAGE)


def stage(lines: DataFrame, header_row: int | None = None) -> DataFrame:
    """One row per record: source_file, sheet, row_number (from 1), content_hash and a map from header to trimmed cell.

    The header row is the best-scored one unless it is given. Columns without header and without any value, and records
    without any value, are left out; short records are filled up. What could not be read is in `rejected`. A frame of maps holds files of any layout at once.
    """
    good = lines.filter("error IS NULL").drop("at", "raw").withColumn("file", F.struct("source_file", "sheet"))
    if header_row is None:
        heads = profiling.detect_headers(profiling.header_scores(good, "file"), "file")
    else:
        heads = good.select("file", F.lit(header_row).alias("header_row")).distinct()
    heads = heads.withColumnRenamed("file", "hf")
    j = good.join(heads, F.col("file").eqNullSafe(F.col("hf"))).drop("hf")
    body = j.filter("row_idx > header_row").withColumn("cells", F.transform("cells", strip)).filter(F.exists("cells", lambda c: ~is_null_like(c)))
    used = body.groupBy("file").agg(F.max(F.size("cells")).alias("width"))
    filled = body.select("file", F.posexplode("cells").alias("j", "c")).filter(~is_null_like(F.col("c"))).groupBy("file").agg(F.collect_set("j").alias("filled"))
    names = j.filter("row_idx = header_row").select("file", F.col("cells").alias("raw")).join(used, "file").join(filled, "file")
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.col("width"), F.size("raw")) - 1), lambda i: (F.trim(F.coalesce(F.get("raw", i), F.lit(""))) != "") | F.array_contains("filled", i))
    names = names.withColumn("at", at).withColumn("headers", unique_headers(F.transform(F.sequence(F.lit(0), F.greatest(F.col("width"), F.size("raw")) - 1), lambda i: F.coalesce(F.get("raw", i), F.lit("")))))
    names = names.select("file", "at", F.transform("at", lambda i: F.get("headers", i)).alias("headers"))
    out = body.join(names, "file")
    return out.select("source_file", "sheet", (F.col("row_idx") + 1).alias("row_number"), "content_hash", F.map_from_arrays("headers", F.transform("at", lambda i: F.coalesce(F.get("cells", i), F.lit("")))).alias("cells"))
