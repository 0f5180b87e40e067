"""Tables that a plan writes on its way, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir.

    Where it is unset, one machine that runs everything, as in tests, gets a folder of its own;
    a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        found = "file://" + tempfile.mkdtemp(prefix="relgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def size_of(df: DataFrame) -> int:
    """Spark's estimate of df's bytes, which for a file's columns is their share of its size; huge where it knows none."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is so small that a scan would not deal it to them (spark.sql.files.openCostInBytes a core).

    One file of one row group is one task, whatever its rows cost. Larger tables are not moved.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = size_of(df)
    cost = int(str(spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()))
    return df.repartition(cores) if size <= cores * cost else df


#: Rows of a few short columns that may go to every task.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A table of short rows, marked for broadcast if it has no more than BROADCAST_ROWS."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/relgraph/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts lineage as a checkpoint does: a lost executor costs no more than
    the tasks it held. ``discard`` removes the table, ``release`` all of them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in tables:
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            delete(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that read them have to be written before."""
    delete(spark, f"{shared_dir(spark)}/relgraph/{spark.sparkContext.applicationId}")
