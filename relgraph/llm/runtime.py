"""Session settings and scratch tables shared by the operators."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.sources.scratch import delete, discard, materialise, release, scratch_path, shared_dir, spread  # noqa: F401

#: Rows of text handed to a Python worker at a time; bounds its memory.
BATCH_ROWS = 1024
#: Python workers are kept and used again; these settings make them give back what a stage has freed.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "4194304", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of text operators; let Python workers find this package.

    On a cluster the package is installed or sent with --py-files; its path on the
    driver's machine only helps workers that see the same path.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (env.get("PYTHONPATH"), root)))
    env.update(WORKER_MEMORY)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # partitions of the advisory size instead of many small ones: fewer, larger scratch files
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents of a few MB, which a scan would leave to one task, are dealt to all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def crc_mod(col, n: int):
    """crc32 of a key's decimal text, modulo n (null key: of the empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n
