"""Counts that are kept up to date over a stream of files (AG1, AG3 as an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from relgraph.operators import cooccur
from relgraph.sources.scratch import delete


def read_stream(spark: SparkSession, folder: str, name: str = "events.parquet", per_trigger: int = 4) -> DataFrame:
    """The table ``name`` under folder, a file or a folder of files, as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    # a pattern, since a stream's path may not be a single file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def _by_clock(events: DataFrame) -> DataFrame:
    """events with ts as the clock shows it, as if in UTC."""
    zone = events.sparkSession.conf.get("spark.sql.session.timeZone")
    return events.withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone))


def _by_window(rows: DataFrame, width: str) -> DataFrame:
    zone = rows.sparkSession.conf.get("spark.sql.session.timeZone")
    day = F.to_utc_timestamp("w.start", zone).cast("timestamp_ntz").alias("day")
    rows = rows.groupBy(F.window("ts", width).alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(day, "event_type", "n", "total")


def windowed_counts(events: DataFrame, *, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(day, event_type, n, total): event-time windows, closed when the watermark has passed.

    Days are those of the clock that ts shows, with or without a time zone; day is a timestamp without one.
    """
    return _by_window(_by_clock(events).withWatermark("ts", late), width)


def window_parts(events: DataFrame, *, width: str = "1 day") -> DataFrame:
    """``windowed_counts`` of a micro-batch: partial counts of all its windows, open ones too, for a ``CountTable``. No row is late."""
    return _by_window(_by_clock(events), width)


def pattern_counts(events: DataFrame) -> DataFrame:
    """(pattern, cnt): partial counts merge by sum, so any micro-batches give the same table."""
    return events.groupBy(F.col("event_type").alias("pattern")).agg(F.count("*").alias("cnt"))


def run(stream: DataFrame, sink, checkpoint: str) -> None:
    """Process all there is; sink adds to a writer of the stream where its rows go. What a checkpoint knows is not read again."""
    sink(stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)).start().awaitTermination()


class CountTable:
    """Counts by key in a folder, kept up to date by micro-batches (AG1, AG3, AG5 over streams).

    A micro-batch writes its own partial counts under its number, over what an earlier attempt at
    it may have left, so a restart counts nothing twice and needs nothing that was in memory. Partial counts merge by sum when
    they are read. ``fold`` sums what there is into a base; readers take the newest whole base and the batches after it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, value: str | tuple[str, ...] = "cnt"):
        self.spark, self.path, self.values = spark, path, (value,) if isinstance(value, str) else value
        self.schema = StructType.fromDDL(schema)
        self.keys = [f.name for f in self.schema if f.name not in self.values]

    def follow(self, stream: DataFrame, partial: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
        """Add all new rows of a stream; partial makes rows (keys, values) of a micro-batch."""

        def put(batch: DataFrame, number: int) -> None:
            partial(batch).select([f.name for f in self.schema]).write.mode("overwrite").parquet(f"{self.path}/batch-{number}")

        run(stream, lambda w: w.foreachBatch(put), checkpoint)

    def _found(self, kind: str) -> list[int]:
        """Numbers of the whole folders of a kind."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        whole = lambda name: fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS"))
        return sorted(int(n.rsplit("-", 1)[1]) for n in names if n.startswith(f"{kind}-") and whole(n))

    def _parts(self) -> list[str]:
        bases = self._found("base")
        since = bases[-1] if bases else -1
        return [f"{self.path}/base-{since}"] * bool(bases) + [f"{self.path}/batch-{n}" for n in self._found("batch") if n > since]

    def read(self) -> DataFrame:
        """(keys, values) of all batches so far."""
        parts = self._parts()
        rows = self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)
        return rows.groupBy(*self.keys).agg(*[F.sum(v).cast(self.schema[v].dataType).alias(v) for v in self.values])

    def fold(self) -> None:
        """Sum the batches so far into a base, and delete what it holds."""
        last = max(self._found("batch"), default=-1)
        if last < 0 or last in self._found("base"):
            return
        self.read().write.mode("overwrite").parquet(f"{self.path}/base-{last}")
        for kind in ("batch", "base"):
            for n in self._found(kind):
                if n < last or kind == "batch" and n == last:
                    delete(self.spark, f"{self.path}/{kind}-{n}")


def pair_counts(lists: DataFrame) -> DataFrame:
    """(a, b, cnt): pairs of entities of the lists (note, ents) of a micro-batch, each list whole (JN6, AG5)."""
    return cooccur.pairs(lists).groupBy("a", "b").agg(F.count("*").alias("cnt"))


def occurrence_counts(lists: DataFrame) -> DataFrame:
    """(ent, note, cnt): the occurrence index of a micro-batch in long form (AG3)."""
    return cooccur.occurrences(lists).withColumn("cnt", F.lit(1).cast("long"))


def follow_windows(events: DataFrame, path: str, checkpoint: str, *, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Windows of ``windowed_counts`` that the watermark has closed, added to a Parquet table at path, and the table.

    Each window is written once; rows that come after it has closed are dropped.
    """
    closed = windowed_counts(events, late=late, width=width)
    run(closed, lambda w: w.outputMode("append").format("parquet").option("path", path), checkpoint)
    return events.sparkSession.read.schema(closed.schema).parquet(path)
