"""Files staged as they arrive: a file stream whose batches are staged once per content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from intakeforge.session import cut, ship
from intakeforge.sources.staging import grids, rejected, stage


def stage_arrivals(spark: SparkSession, inbox: str, out: str, checkpoint: str, trigger: dict | None = None, rejects: str | None = None) -> StreamingQuery:
    """Stage every file that appears in ``inbox`` into the table ``out``; contents staged before are skipped.

    The stream's own checkpoint keeps each file to one batch; ``out`` is partitioned by batch, and a batch that is run again
    after a failure overwrites only itself. Records and files that cannot be read go to the table ``rejects`` (by default beside
    ``out``, with ``_rejected`` after its name), partitioned alike; a file that fails as a whole is told each time it is sent.
    """
    ship(spark)
    out, rejects = out.rstrip("/"), (rejects or f"{out.rstrip('/')}_rejected").rstrip("/")
    schema = spark.read.format("binaryFile").load(inbox).schema if _any(spark, inbox) else "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*").load(inbox)

    def batch(df: DataFrame, epoch: int) -> None:
        lines = cut(grids(df))
        for path, some in ((out, "true"), (rejects, "row_number IS NOT NULL")):
            if _any(spark, path):
                known = spark.read.parquet(path).filter((F.col("batch") != epoch) & F.expr(some)).select("content_hash").distinct()
                lines = lines.join(known, "content_hash", "left_anti").select(lines.columns)
        staged = stage(lines).withColumn("cells", F.map_entries("cells"))
        rejected(lines).write.mode("overwrite").parquet(f"{rejects}/batch={epoch}")
        staged.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _any(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0
