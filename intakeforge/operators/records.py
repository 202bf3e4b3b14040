"""Raw delimited records: a quote-aware finite-state tokenizer with composable chunk transitions, typed rows and reasons.

The automaton has five states. A chunk of text maps every entry state to an exit state; such maps compose associatively, so
chunks of one file can be summarised independently (`chunk_transitions`), the maps composed in chunk order
(`entry_states`), and every chunk then tokenized from its true entry state (`split_chunk_records`). `tokenize` runs the
same automaton over one whole record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeforge.functions import cells as C
from intakeforge.functions import values as V

START, PLAIN, QUOTED, CLOSED, BROKEN = range(5)
QUOTE, DELIMITER, NEWLINE, OTHER = range(4)
IDENTITY = (START, PLAIN, QUOTED, CLOSED, BROKEN)
#: TRANSITIONS[class][state]; at file level a newline outside quotes ends the record, so a broken record recovers there.
TRANSITIONS = (
    (QUOTED, PLAIN, CLOSED, QUOTED, BROKEN),
    (START, START, QUOTED, START, BROKEN),
    (START, START, QUOTED, START, START),
    (PLAIN, PLAIN, QUOTED, BROKEN, BROKEN),
)
#: U+FFFD, or a control character other than tab, line feed and carriage return.
UNDECODED = re.compile("[�\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")


def compose(first: tuple[int, ...], second: tuple[int, ...]) -> tuple[int, ...]:
    """The map of two adjacent pieces: first, then second."""
    return tuple(second[s] for s in first)


@lru_cache(maxsize=64)
def _events(delimiter: str) -> re.Pattern[str]:
    return re.compile(f'["\\n{re.escape(delimiter)}]')


def text_transition(text: str, delimiter: str) -> tuple[int, ...]:
    """The state map of a piece of text; only quotes, delimiters and newlines are visited one by one."""
    state, at = IDENTITY, 0
    for m in _events(delimiter).finditer(text):
        if m.start() > at:
            state = compose(state, TRANSITIONS[OTHER])
        ch = m.group()
        state = compose(state, TRANSITIONS[QUOTE if ch == '"' else NEWLINE if ch == "\n" else DELIMITER])
        at = m.end()
    return compose(state, TRANSITIONS[OTHER]) if at < len(text) else state


def tokenize(text: str, delimiter: str) -> tuple[list[str], int]:
    """Cells of one record, and the offset of a quoting fault or -1.

    A cell that begins with a quote sign must have a closing one with nothing after it; a doubled quote inside stands for
    one; a quote sign inside an unquoted cell, and a newline inside a record, are plain text.
    """
    if '"' not in text:
        return text.split(delimiter), -1
    found, state, begin, at, opened, doubled = [], START, 0, 0, 0, False
    n = len(text)
    for m in _events(delimiter).finditer(text):
        i, ch = m.start(), m.group()
        if i > at:
            if state == CLOSED:
                return found, at
            if state == START:
                state = PLAIN
        if ch == "\n":
            if state == CLOSED:
                return found, i
            if state == START:
                state = PLAIN
        elif ch == '"':
            if state == START:
                state, opened, doubled = QUOTED, i, False
            elif state == QUOTED:
                state = CLOSED
            elif state == CLOSED:
                state, doubled = QUOTED, True
        elif state != QUOTED:
            cell = text[begin:i] if state != CLOSED else text[opened + 1 : i - 1]
            found.append(cell.replace('""', '"') if state == CLOSED and doubled else cell)
            state, begin = START, i + 1
        at = m.end()
    if state == QUOTED:
        return found, opened
    if state == CLOSED:
        if at < n:
            return found, at
        cell = text[opened + 1 : n - 1]
        found.append(cell.replace('""', '"') if doubled else cell)
    else:
        found.append(text[begin:])
    return found, -1


def read_record(text: str, delimiter: str, types: list[str]) -> tuple[str | None, int, list[str] | None]:
    """(reason, offset or cell number, cells): the first reason that applies, or none with the cells."""
    if m := UNDECODED.search(text):
        return "encoding", m.start(), None
    found, fault = tokenize(text, delimiter)
    if fault >= 0:
        return "quoting", fault, None
    if len(found) != len(types):
        return "column_count", len(found), found
    for k, (cell, kind) in enumerate(zip(found, types)):
        if kind != "string" and kind != "empty" and not C.null_like(cell):
            name, _, token = kind.partition(":")
            if not C.fits(cell, name, token):
                return "bad_value", k, found
    return None, -1, found


@F.pandas_udf(T.ArrayType(T.StringType()))
def record_tokens(text: pd.Series, delimiter: pd.Series) -> pd.Series:
    """The cells of each record as `tokenize` gives them, of a record with a quoting fault those before it; NULL for NULL."""
    return pd.Series([None if t is None else tokenize(t, d)[0] for t, d in zip(text, delimiter)], dtype=object)


def layouts(objects: DataFrame) -> DataFrame:
    """One row per source object: delimiter, header_row and ``types``, the inferred type of each header as ``date:mdy/``.

    Columns of profile_json are put in place by their position; a header without profile accepts anything. Where an id
    occurs twice the latest row counts.
    """
    prof = T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), T.StructField("inferred_type", T.StringType()), T.StructField("date_format", T.StringType())]))
    names = F.from_json("columns_json", T.ArrayType(T.StringType()))
    one = (
        objects.filter(F.col("source_object_id").isNotNull())
        .select("source_object_id", F.struct("ingested_at", "delimiter", "header_row", "columns_json", "profile_json").alias("r"))
        .groupBy("source_object_id")
        .agg(F.max("r").alias("r"))
        .select("source_object_id", "r.*")
    )
    parsed = one.select("source_object_id", F.coalesce("delimiter", F.lit(",")).alias("delimiter"), F.coalesce("header_row", F.lit(0)).alias("header_row"), F.coalesce(names, F.array().cast("array<string>")).alias("names"), F.coalesce(F.from_json("profile_json", prof), F.array().cast(prof)).alias("p"))
    code = F.map_from_entries(
        F.array_distinct(F.transform("p", lambda p: F.struct(F.coalesce(p["position"], F.lit(-1)).alias("k"), F.concat(F.coalesce(p["inferred_type"], F.lit("string")), F.lit(":"), F.coalesce(p["date_format"], F.lit(""))).alias("v"))))
    )
    kind = lambda i: F.when(F.element_at("code", i).startswith("date:"), F.element_at("code", i)).otherwise(F.substring_index(F.coalesce(F.element_at("code", i), F.lit("string:")), ":", 1))
    return (
        parsed.withColumn("p", F.array_compact(F.transform(F.sequence(F.lit(0), F.greatest(F.size("names"), F.lit(1)) - 1), lambda i: F.get(F.filter("p", lambda p: p["position"] == i), F.lit(0)))))
        .withColumn("code", code)
        .select("source_object_id", "delimiter", "header_row", F.when(F.size("names") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size("names"), F.lit(1)) - 1), kind)).otherwise(F.array().cast("array<string>")).alias("types"))
    )


OUT = "raw_id long, source_object_id long, row_idx int, reason string, at int, cells array<string>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("raw_id", pa.int64()), ("source_object_id", pa.int64()), ("row_idx", pa.int32()), ("reason", pa.string()), ("at", pa.int32()), ("cells", pa.list_(pa.string()))])
    for b in batches:
        reason, at, cells = [], [], []
        # Layouts repeat from row to row: each distinct one is unpacked once per batch.
        known: dict[str, list[str]] = {}
        for text, delimiter, types in zip(b.column("raw_text").to_pylist(), b.column("delimiter").to_pylist(), b.column("types").to_pylist()):
            if types is None:
                r = ("unknown_object", -1, None)
            else:
                kinds = known.get(types)
                if kinds is None:
                    kinds = known[types] = types.split("\x1f") if types else []
                r = read_record(text, delimiter, kinds)
            reason.append(r[0])
            at.append(r[1])
            cells.append(r[2])
        yield pa.RecordBatch.from_arrays([b.column("raw_id"), b.column("source_object_id"), b.column("row_idx"), pa.array(reason, pa.string()), pa.array(at, pa.int32()), pa.array(cells, pa.list_(pa.string()))], schema=schema)


def read_records(raw: DataFrame, objects: DataFrame) -> DataFrame:
    """Every data record of ``raw`` as cells, or with the first reason why it cannot be read and where.

    Input: raw_id, source_object_id, row_idx, raw_text; the objects' delimiter, header_row, columns_json, profile_json.
    Output: raw_id, source_object_id, row_idx, reason (NULL for a good record), at (character offset for ``encoding`` and
    ``quoting``, number of cells found for ``column_count``, cell index for ``bad_value``), cells.

    Blank or NULL records and records up to the header row are no data. A record whose object is unknown or NULL gets the
    reason ``unknown_object``. Repeated rows each give a row. One narrow join by object, whose layout is a short text;
    a hot object is split by the adaptive skew join. No other shuffle: records of any length are read in place.
    """
    # A layout travels as one text, so that workers can recognise a repeated one cheaply.
    lay = layouts(objects).select("source_object_id", "delimiter", F.coalesce("header_row", F.lit(0)).alias("header_row"), F.array_join("types", "\x1f").alias("types"))
    rows = raw.select("raw_id", "source_object_id", F.col("row_idx").cast("int").alias("row_idx"), "raw_text").filter(F.col("raw_text").rlike(r"[^\s\u0085 \u001c-\u001f]"))
    j = rows.join(lay, "source_object_id", "left").filter(F.col("header_row").isNull() | (F.col("row_idx") > F.col("header_row")))
    return j.select("raw_id", "source_object_id", "row_idx", "raw_text", F.coalesce("delimiter", F.lit(",")).alias("delimiter"), "types").mapInArrow(_read, OUT)


def failed_records(raw: DataFrame, objects: DataFrame) -> DataFrame:
    """(raw_id, reason) of every data record that fails for one of the four reasons."""
    return read_records(raw, objects).filter(F.col("reason").isin("encoding", "quoting", "column_count", "bad_value")).select("raw_id", "reason")


def typed_rows(read: DataFrame, objects: DataFrame) -> DataFrame:
    """(raw_id, source_object_id, row_idx, reason, at, numbers, days, flags, texts): good records as typed values by header.

    Objects have columns of their own, so that a row holds its values in one map per type: numbers (int, float, currency and percent,
    the latter in percent units, brackets negate), days, flags (bool) and texts. Null-like cells are in none. A record that fails
    has no maps. Headers that occur twice in an object count from the first.
    """
    lay = layouts(objects).select("source_object_id", "types")
    names = objects.filter("source_object_id IS NOT NULL").groupBy("source_object_id").agg(F.max(F.struct("ingested_at", "columns_json")).alias("r")).select("source_object_id", F.from_json("r.columns_json", "array<string>").alias("names"))
    j = read.join(lay.join(names, "source_object_id"), "source_object_id", "left")
    cell = F.transform("cells", lambda c, i: F.struct(F.get("names", i).alias("k"), V.present(c).alias("v"), F.get("types", i).alias("t")))
    good = F.when(F.col("reason").isNull(), F.filter(cell, lambda x: x["v"].isNotNull() & x["k"].isNotNull()))
    j = j.withColumn("good", F.filter(good, lambda x, i: F.array_position(F.transform(good, lambda y: y["k"]), x["k"]) == i + 1))
    kind = lambda x: F.substring_index(x["t"], ":", 1)

    def day(x: Column) -> Column:
        token = F.substring_index(x["t"], ":", -1)
        out = F.when(F.lit(False), F.lit(None).cast("date"))
        for t in V.CELL_DATE_TOKENS:
            out = out.when(token == t, V.parse_date_as(x["v"], t))
        return F.coalesce(out, V.cell_date(x["v"]))

    def of(kinds: list[str], value) -> Column:  # noqa: ANN001
        own = F.filter("good", lambda x: kind(x).isin(kinds))
        return F.map_from_entries(F.transform(own, lambda x: F.struct(x["k"], value(x))))

    typed = ["int", "float", "currency", "percent", "date", "bool"]
    texts = F.filter("good", lambda x: ~F.coalesce(kind(x), F.lit("string")).isin(typed))
    return j.select(
        "raw_id", "source_object_id", "row_idx", "reason", "at",
        of(["int", "float", "currency", "percent"], lambda x: V.cell_number(x["v"])).alias("numbers"), of(["date"], day).alias("days"),
        of(["bool"], lambda x: F.lower(x["v"]).isin(V.TRUE_TOKENS)).alias("flags"), F.map_from_entries(F.transform(texts, lambda x: F.struct(x["k"], x["v"]))).alias("texts"),
    )


# --- whole files in chunks --------------------------------------------------------------------------------------------


def chunk_transitions(chunks: DataFrame, text: str = "text", delimiter: Column | None = None) -> DataFrame:
    """Adds ``step``, the state map of each chunk, without looking at any other chunk."""

    @F.pandas_udf(T.ArrayType(T.ByteType()))
    def step(t, d):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([list(text_transition(x or "", y)) for x, y in zip(t, d)])

    return chunks.withColumn("step", step(F.col(text), delimiter if delimiter is not None else F.lit(",")))


def entry_states(steps: DataFrame, file: str = "file_id", chunk: str = "chunk_no", span: int = 4096) -> DataFrame:
    """The entry state of every chunk: maps of ``span`` neighbouring chunks are composed first, then those of the file.

    So no task holds more than ``span`` maps, or one map per ``span`` chunks, however large a file is.
    """
    from pyspark.sql import Window

    s = steps.select(file, chunk, "step", F.floor(F.col(chunk) / span).alias("block"))
    ident = F.array(*[F.lit(i).cast("byte") for i in range(5)])
    fold = lambda maps: F.aggregate(maps, ident, lambda acc, m: F.transform(acc, lambda x: F.element_at(m, (x + 1).cast("int"))))
    inner = Window.partitionBy(file, "block").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    whole = s.groupBy(file, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct(chunk, "step"))), lambda x: x["step"]).alias("maps")).select(file, "block", fold(F.col("maps")).alias("whole"))
    outer = Window.partitionBy(file).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(file, "block", fold(F.collect_list("whole").over(outer)).alias("before"))
    return (
        s.withColumn("local", fold(F.collect_list("step").over(inner)))
        .join(before, [file, "block"])
        .select(file, chunk, F.element_at("local", F.element_at("before", 1).cast("int") + 1).cast("int").alias("entry"))
    )


def split_records(text: str, delimiter: str, entry: int = START) -> list[int]:
    """Offsets just after every newline that ends a record, given the entry state of the text."""
    ends, state, at = [], entry, 0
    for m in _events(delimiter).finditer(text):
        if m.start() > at:
            state = TRANSITIONS[OTHER][state]
        ch = m.group()
        if ch == "\n" and state != QUOTED:
            ends.append(m.end())
        state = TRANSITIONS[QUOTE if ch == '"' else NEWLINE if ch == "\n" else DELIMITER][state]
        at = m.end()
    return ends


def record_cells(record: str, delimiter: str) -> tuple[str | None, int, list[str] | None]:
    """(reason, offset, cells) of one record of a file with its line end: ``encoding`` or ``quoting``, or none with the cells.

    A blank line has no cells. The line end is a newline or a carriage return and a newline.
    """
    text = record.removesuffix("\n").removesuffix("\r")
    if m := UNDECODED.search(text):
        return "encoding", m.start(), None
    found, fault = tokenize(text, delimiter)
    if fault >= 0:
        return "quoting", fault, None
    return None, -1, found if text else []


def split_chunk_records(text: str, delimiter: str, entry: int = START) -> list[tuple[bool, str, str | None, int, list[str] | None]]:
    """(whole, text, reason, offset, cells) of every piece of a chunk, which is tokenized from its entry state.

    The first piece may have begun in an earlier chunk and the last one, perhaps empty, may go on in a later one: these two are not
    whole, and have no cells yet. Pieces keep their line ends.
    """
    ends = split_records(text, delimiter, entry)
    pieces = [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]
    return [(True, p, *record_cells(p, delimiter)) if 0 < k < len(pieces) - 1 else (False, p, None, -1, None) for k, p in enumerate(pieces)]


def sequential_entry(texts: list[str], delimiter: str) -> list[int]:
    """Entry states found one after the other; the brute force that `entry_states` is tested against."""
    out, state = [], START
    for t in texts:
        out.append(state)
        state = text_transition(t, delimiter)[state]
    return out


def compose_all(maps: list[tuple[int, ...]]) -> tuple[int, ...]:
    return reduce(compose, maps, IDENTITY)
