"""Staged tables and typed target tables on shared storage: gated plan, rejects, latest rows, upsert, atomic swap, counters.

A table is a folder of versions, each complete, and a file that names the one in force. A load writes a new version beside the
old one and then replaces the name, so that readers see the table before or after it and a failed load leaves no trace but an
unnamed folder.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from intakeforge.operators.casting import SPARK_TYPES, ColumnPlan, conform, quoted
from intakeforge.operators.materialize import latest_per_key, reject_null_keys, upsert
from intakeforge.session import cut


class PlanError(ValueError):
    """A plan that must not run: what it lacks is in the message."""


@dataclass
class LoadPlan:
    """What is loaded from which staged column, under which key, and what is doubtful about it."""

    columns: list[ColumnPlan]
    key: list[str]
    warnings: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class LoadResult:
    """Rows that were staged, written (one per key) and rejected for lack of a key, and the version that holds them."""

    rows_staged: int
    rows_written: int
    rows_rejected: int
    version: str


def build_plan(mapping: dict[str, str], fields: list[dict], present: list[str], key: list[str], formats: dict[str, str] | None = None, open_breaking: int = 0) -> LoadPlan:
    """The plan of a mapping (staged column -> field or ``ext_`` name), or `PlanError` where it must not run.

    ``fields``: field_name, field_type, is_required; ``present``: the staged columns; ``formats``: date layouts of staged columns.
    It must not run with breaking drift open, with mapped columns that are not there, or with a key that is not mapped. Schema
    fields without a column become typed NULLs; of ``ext_`` columns that are not there the same is told as a warning.
    """
    by_field = {t: c for c, t in mapping.items()}
    missing = sorted(c for c, t in mapping.items() if c not in present and not t.startswith("ext_"))
    lacking = [k for k in key if k not in by_field]
    problems = [f"{open_breaking} breaking drift events are open"] * (open_breaking > 0) + [f"mapped columns are not there: {', '.join(missing)}"] * bool(missing) + [f"key columns are not mapped: {', '.join(lacking)}"] * bool(lacking) + ["a table needs a key"] * (not key)
    if problems:
        raise PlanError("; ".join(problems))
    columns, warnings = [], []
    for f in fields:
        source = by_field.get(f["field_name"])
        if source is None and f.get("is_required"):
            warnings.append(f"required field {f['field_name']} has no column")
        columns.append(ColumnPlan(f["field_name"], f["field_type"], source, (formats or {}).get(source or "", "ymd-")))
    for c, t in sorted(mapping.items()):
        if t.startswith("ext_"):
            if c not in present:
                warnings.append(f"column {c} of {t} is not there")
            columns.append(ColumnPlan(t, "string", c if c in present else None))
    return LoadPlan(columns, key, warnings)


def staged_rows(staged: DataFrame, plan: LoadPlan, order: list[Column], counters: Observation | None = None) -> DataFrame:
    """The typed rows of a plan, one per key: the last one by ``order``. Rows without a whole key are counted and left out."""
    names = [f"_order_{i}" for i in range(len(order))]
    typed = conform(staged.withColumns(dict(zip(names, order))), plan.columns, names)
    return latest_per_key(reject_null_keys(typed, plan.key, counters), plan.key, [quoted(n) for n in names]).drop(*names)


def empty_like(spark: SparkSession, plan: LoadPlan) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"`{c.output}` {SPARK_TYPES[c.kind].simpleString()}" for c in plan.columns))


# --- tables on shared storage -----------------------------------------------------------------------------------------


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder that holds the table now, None before the first load."""
    fs, P = _file_system(spark, path)
    if not fs.exists(P(f"{path}/current")):
        return None
    return f"{path}/{spark.read.text(f'{path}/current').first()[0]}"


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    folder = current_version(spark, path)
    return spark.read.parquet(folder) if folder else None


def swap(spark: SparkSession, path: str, version: str) -> None:
    """Names ``version`` as the one in force. The name is written beside and moved over the old one, which is kept as the one
    before; where two loads race, the later one fails instead of hiding the first."""
    fs, P = _file_system(spark, path)
    stream = fs.create(P(f"{path}/next-{version}"), False)
    stream.write(bytearray(f"{version}\n".encode()))
    stream.close()
    fs.delete(P(f"{path}/before"), False)
    if fs.exists(P(f"{path}/current")) and not fs.rename(P(f"{path}/current"), P(f"{path}/before")):
        raise OSError(f"another load changes {path}")
    if not fs.rename(P(f"{path}/next-{version}"), P(f"{path}/current")):
        raise OSError(f"another load changed {path}")


def load(staged: DataFrame, plan: LoadPlan, path: str, order: list[Column]) -> LoadResult:
    """Upserts the staged rows into the table at ``path`` and swaps its version.

    One pass casts, counts, rejects and keeps the last row of each key; the second merges with the version in force. Matched rows
    take all planned columns, NULLs included; columns that only the table has stay, new ones are added.
    """
    spark = staged.sparkSession
    counters = Observation()
    fresh = cut(staged_rows(staged, plan, order, counters))
    seen = counters.get
    written = fresh.count()
    old = read_table(spark, path)
    target = old if old is not None else empty_like(spark, plan)
    version = f"v-{uuid.uuid4().hex}"
    upsert(target, fresh, plan.key, [c.output for c in plan.columns if c.output not in plan.key]).write.parquet(f"{path}/{version}")
    swap(spark, path, version)
    return LoadResult(seen["rows_staged"], written, seen["rows_rejected"], version)


def assert_unique(table: DataFrame, key: list[str]) -> None:
    """Raises where a key occurs twice."""
    twice = table.groupBy(*[quoted(k) for k in key]).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key occurs {twice[0]['count']} times: {twice[0]}")


# --- staged text ------------------------------------------------------------------------------------------------------


def stage_object(rows: DataFrame, root: str, feed: str, object_id: int) -> str:
    """Writes an object's text rows as a table of its own, replacing what a broken run left, and returns its folder."""
    folder = f"{root}/{raw_table_name(feed, object_id)}"
    text = [c for c, t in rows.dtypes if t != "string"]
    rows.withColumns({c: quoted(c).cast("string") for c in text}).write.mode("overwrite").parquet(folder)
    return folder


def raw_table_name(feed: str, object_id: int) -> str:
    """The feed in lower case with every run of other signs as one underscore, and the object's number."""
    kept = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in feed.lower())
    return f"raw_{'_'.join(kept.split())}_{object_id}"


def raw_table_column(feed: Column, object_id: Column) -> Column:
    """`raw_table_name` of columns."""
    name = F.btrim(F.regexp_replace(F.lower(feed), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.concat(F.lit("raw_"), name, F.lit("_"), object_id.cast("string"))


def read_staged(spark: SparkSession, folder: str) -> DataFrame:
    """Staged rows as they were written, NULL cells as empty text."""
    df = spark.read.parquet(folder)
    return df.select(*[F.coalesce(quoted(c), F.lit("")).alias(c) if t == "string" else quoted(c) for c, t in df.dtypes])


def unfinished(objects: DataFrame, staged: DataFrame) -> DataFrame:
    """Objects that were received but have no staged rows: they are staged again. ``staged``: source_object_id of any staged row."""
    return objects.join(staged.select("source_object_id").filter("source_object_id IS NOT NULL").distinct(), "source_object_id", "left_anti")
