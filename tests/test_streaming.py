"""Counts over streams: micro-batches, late rows, restarts and folds give what a batch gives."""

import datetime

from pyspark.sql import functions as F

from relgraph.operators import cooccur
from relgraph.plans import queries
from relgraph.streaming import counts

DAY = datetime.datetime(2024, 1, 1, 12)
SCHEMA = "event_type string, ts timestamp_ntz, value double"


def rows(*days):
    return [(kind, DAY + datetime.timedelta(days=d), 1.5) for d in days for kind in ("x", "y")]


def put(spark, folder, number, data, schema):
    """One more file in the folder that the stream reads."""
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def test_counts_survive_restarts_and_folds(spark, tmp_path):
    table = counts.CountTable(spark, str(tmp_path / "t"), "pattern string, cnt long")
    assert table.read().collect() == []
    follow = lambda: table.follow(counts.read_stream(spark, str(tmp_path), per_trigger=1), counts.pattern_counts, str(tmp_path / "c"))
    said = []
    for k, data in enumerate([rows(0, 1), rows(5) + [("z", None, 0.0)], rows(0)]):  # the last is late: counts take it
        put(spark, tmp_path, k, data, SCHEMA)
        follow()  # a new query each time, from the checkpoint
        follow()
        said += data
        want = {kind: sum(r[0] == kind for r in said) for kind in {r[0] for r in said}}
        assert {r.pattern: r.cnt for r in table.read().collect()} == want
        if k == 1:
            table.fold()
            table.fold()
            assert table._found("batch") == [] and len(table._parts()) == 1
            assert {r.pattern: r.cnt for r in table.read().collect()} == want
    assert len(table._parts()) == 2
    # an attempt that had written and died before its commit is written over
    spark.createDataFrame([("x", 1000)], "pattern string, cnt long").write.parquet(str(tmp_path / "t" / f"batch-{max(table._found('batch')) + 1}"))
    put(spark, tmp_path, 4, rows(9), SCHEMA)
    follow()
    said += rows(9)
    assert {r.pattern: r.cnt for r in table.read().collect()} == {kind: sum(r[0] == kind for r in said) for kind in "xyz"}


def test_windows_close_once_and_drop_late_rows(spark, tmp_path):
    out = []
    for k, data in enumerate([rows(0, 0, 1), rows(4), rows(0, 3) + rows(6), rows(9)]):
        put(spark, tmp_path, k, data, SCHEMA)
        found = counts.follow_windows(counts.read_stream(spark, str(tmp_path), per_trigger=1), str(tmp_path / "w"), str(tmp_path / "c"))
        out.append({(r.day.day, r.event_type): r.n for r in found.collect()})
    # days 1 and 2 are closed by day 5; of the third file the row of day 1 is late, that of day 4 is not
    assert out[0] == {} and out[1] == {(1, "x"): 2, (1, "y"): 2, (2, "x"): 1, (2, "y"): 1}
    assert out[2] == out[1] | {(d, k): 1 for d in (4, 5) for k in "xy"} and out[3] == out[2] | {(7, k): 1 for k in "xy"}


def test_pairs_and_occurrences_equal_a_batch(spark, tmp_path):
    lists = [(k, sorted({f"e{(k * j) % 7}" for j in range(1, 5)})) for k in range(30)] + [(99, []), (98, ["e1"])]
    schema = "note long, ents array<string>"
    pairs = counts.CountTable(spark, str(tmp_path / "p"), "a string, b string, cnt long")
    index = counts.CountTable(spark, str(tmp_path / "o"), "ent string, note long, cnt long")
    for k in range(3):
        put(spark, tmp_path, k, lists[k::3], schema)
        for table, partial in ((pairs, counts.pair_counts), (index, counts.occurrence_counts)):
            table.follow(counts.read_stream(spark, str(tmp_path), per_trigger=1), partial, table.path + "-c")
    whole = spark.createDataFrame(lists, schema)
    key = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert key(pairs.read(), "a", "b", "cnt") == key(cooccur.counts(whole)[0].select("a", "b", F.col("c").alias("cnt")), "a", "b", "cnt")
    assert key(index.read(), "ent", "note") == key(cooccur.occurrences(whole), "ent", "note")


def test_windows_of_all_days_and_late_rows(spark, tmp_path):
    said = []
    table = counts.CountTable(spark, str(tmp_path / "t"), "day timestamp_ntz, event_type string, n long, total double", ("n", "total"))
    for k, data in enumerate([rows(0, 5), rows(0, 9), rows(1)]):
        put(spark, tmp_path, k, data, SCHEMA)
        table.follow(counts.read_stream(spark, str(tmp_path), per_trigger=1), counts.window_parts, str(tmp_path / "c"))
        said += data
    key = lambda ts: ts.replace(hour=0)
    want = {(key(ts), kind): (sum(key(t) == key(ts) and x == kind for x, t, _ in said), sum(v for x, t, v in said if key(t) == key(ts) and x == kind)) for kind, ts, _ in said}
    assert {(r.day, r.event_type): (r.n, r.total) for r in table.read().collect()} == want


def test_window_query_has_every_event(spark, tmp_path):
    for k, data in enumerate([rows(0, 9), rows(0), rows(1), rows(2), rows(0), rows(9)]):  # more files than a micro-batch reads
        put(spark, tmp_path, k, data, SCHEMA)
    assert sum(r.n for r in queries.stream_windows(spark, str(tmp_path)).collect()) == 14
