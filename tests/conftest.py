"""One session for all tests, tables of the smallest size, and hostile variants of them."""

from __future__ import annotations

import glob
import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]
from helpers import DATA  # noqa: E402


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    from intakeforge.session import ensure_checkpoint_dir, ship

    ship(s)
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def empty_dir(spark: SparkSession, tmp_path_factory: pytest.TempPathFactory) -> str:
    """All tables without rows."""
    out = tmp_path_factory.mktemp("empty")
    for p in glob.glob(f"{DATA}/*.parquet"):
        spark.read.parquet(p).limit(0).write.parquet(str(out / os.path.basename(p)))
    return str(out)


@pytest.fixture(scope="session")
def hostile_dir(spark: SparkSession, tmp_path_factory: pytest.TempPathFactory) -> str:
    """All tables with an all-NULL row, every text column once very long, and extra columns under names used inside."""
    out = tmp_path_factory.mktemp("hostile")
    for p in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(p)
        df = spark.read.parquet(p)
        if name.split(".")[0] not in ("lineitem", "orders", "events", "customer", "part", "supplier", "nation", "region", "embeddings"):
            nulls = spark.createDataFrame([tuple([None] * len(df.columns))], df.schema)
            df = df.unionByName(nulls)
            if name == "documents.parquet":
                df = df.unionByName(df.limit(1).withColumn("text", F.expr("repeat('long word, ', 60000)"))).unionByName(df.limit(1).withColumn("text", F.lit("")))
            for extra in ("value", "n", "key", "types", "prev_object_id", "text_class", "tokens", "cells", "mask"):
                if extra not in df.columns:
                    df = df.withColumn(extra, F.lit("clash"))
        df.write.parquet(str(out / name))
    return str(out)
