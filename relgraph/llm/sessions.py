"""Sessions of users whose events arrive late, as every batch saw them, with retractions.

After each batch, ascending, a user's events so far form sessions: neighbours at most
``gap`` apart share one. A session that holds an event of the batch is a new version and
retracts the earlier standing sessions that it contains. Each task replays batches over a
list of disjoint sessions, sorted by start: bisection finds those within reach of an event,
which are spliced into one, and what is spliced away is logged.

A user's replay is cut into parts of so many batches that no event is later than a part is
long, so one user is dealt to many tasks. All events before a part's first second had come
before its first batch; what they leave is one standing session at most within reach, the
carry. It is known from the events alone: the run that ends there, and the last batch in it.
Runs over several parts are put together by doubling, in as many rounds as the logarithm of
the longest. Sessions still standing at the end of a part meet their retractions by a join.

Defined cases: rows with a null user, batch or time take no part, a null h counts 0; equal
rows are events each; times and batches may be negative; a version with a batch and a start
is the only one of its user; other columns are not read; without events there are no versions.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relgraph.llm.runtime import materialise

GAP, WIDTH = 240, 1800
#: Batches of a part, at least.
BATCHES = 16


class Session:
    """A standing session; ``took`` holds what its newest version retracts."""

    __slots__ = ("start", "end", "n", "h", "batch", "new", "took", "gone", "by")

    def __init__(self, start, end, n, h, batch, new=0):
        self.start, self.end, self.n, self.h, self.batch, self.new = start, end, n, h, batch, new
        self.took, self.gone, self.by = [], False, None


def replay(rows: list[tuple], first: int, gap: int) -> tuple[list[Session], list[Session]]:
    """Versions of batches from ``first`` on, and standing sessions of before that they retract.

    rows: (batch, start, end, n, h), sums of events or of a run, sorted.
    """
    starts, ends, stand, versions, ended = [], [], [], [], []
    for batch, a, b, n, h in sorted((r for r in rows if r[0] < first), key=itemgetter(1)):
        if stand and a - ends[-1] <= gap:
            s = stand[-1]
            s.end = ends[-1] = max(ends[-1], b)
            s.n, s.h, s.batch = s.n + n, s.h + h, max(s.batch, batch)
        else:
            starts.append(a)
            ends.append(b)
            stand.append(Session(a, b, n, h, batch))
    for batch, arrived in groupby((r for r in rows if r[0] >= first), key=itemgetter(0)):
        made = []
        for _, a, b, n, h in arrived:
            i, j = bisect_left(ends, a - gap), bisect_right(starts, b + gap)
            own = Session(a, b, n, h, batch, n)
            for s in stand[i:j]:
                own.start, own.end, own.n, own.h = min(own.start, s.start), max(own.end, s.end), own.n + s.n, own.h + s.h
                if s.batch == batch:  # of this batch itself: not yet a version
                    own.new, s.gone = own.new + s.new, True
                    own.took += s.took
                else:
                    own.took.append(s)
            starts[i:j], ends[i:j], stand[i:j] = [own.start], [own.end], [own]
            made.append(own)
        for own in made:
            if not own.gone:
                versions.append(own)
                for s in own.took:
                    s.by = (batch, own.start)
                    if s.batch < first:
                        ended.append(s)
    return versions, ended


def _cells(events: DataFrame) -> DataFrame:
    """(user, batch, at, n, h): events of a user, batch and second in one row."""
    rows = events.where("user is not null and batch is not null and at is not null")
    return rows.groupBy("user", F.col("batch").cast("long").alias("batch"), F.col("at").cast("long").alias("at")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).cast("long").alias("h"))


def _carries(cells: DataFrame, gap: int) -> DataFrame:
    """(user, part, start, last, n, h, batch): the run that ends with the last event of each part's seconds."""
    part = Window.partitionBy("user", "part")
    runs = cells.withColumn("new", F.coalesce(F.col("at") - F.lag("at").over(part.orderBy("at")) > gap, F.lit(True)))
    runs = runs.withColumn("start", F.max(F.when(F.col("new"), F.col("at"))).over(part))
    tail = lambda c: F.when(F.col("at") >= F.col("start"), F.col(c))
    blocks = runs.groupBy("user", "part").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.max("start").alias("start"), F.sum(tail("n")).alias("n"), F.sum(tail("h")).alias("h"), F.max(tail("batch")).alias("batch")
    )
    blocks = materialise(blocks, "session-blocks")
    before = blocks.select("user", (F.col("part") + 1).alias("part"), F.col("last").alias("before"))
    goes_on = (F.col("start") == F.col("first")) & (F.col("first") - F.col("before") <= gap)
    now = blocks.join(before, ["user", "part"], "left").select("user", "part", "start", "last", "n", "h", "batch", F.when(goes_on, F.col("part") - 1).alias("ref"))
    now = materialise(now, "session-runs")
    while not (open_ := now.where("ref is not null")).isEmpty():
        of = now.select("user", F.col("part").alias("ref"), *[F.col(c).alias(f"_{c}") for c in ("start", "n", "h", "batch", "ref")])
        longer = open_.join(of, ["user", "ref"]).select("user", "part", F.col("_start").alias("start"), "last", (F.col("n") + F.col("_n")).alias("n"), (F.col("h") + F.col("_h")).alias("h"), F.greatest("batch", "_batch").alias("batch"), F.col("_ref").alias("ref"))
        now = materialise(now.where("ref is null").unionByName(longer), "session-runs")
    return now.drop("ref")


def versions(events: DataFrame, *, gap: int = GAP, width: int = WIDTH, batches: int = BATCHES) -> DataFrame:
    """(user, batch, start_s, end_s, n_events, n_new, n_retracted, h_sum, retracted_batch, retracted_start_s) of every version.

    events: (user, batch, at, h). A batch is expected to bring seconds of about its own
    ``width``; how late and how early events really are is found first, and parts are made as long.
    """
    user = events.schema["user"].dataType.simpleString()
    cells = materialise(_cells(events), "session-cells")
    slot = F.expr(f"cast((at - pmod(at, {width})) / {width} as long)")
    early, late = cells.agg(F.min(F.col("batch") - slot), F.max(F.col("batch") - slot)).first()
    early, late = (0, 0) if early is None else (early, late)
    per = max(batches, late - early + 1, gap // width + 2)
    floor = lambda c: F.expr(f"cast(({c} - pmod({c}, {per})) / {per} as long)")
    cells = cells.withColumn("slot", slot + late).withColumn("part", floor("slot")).drop("slot")
    begins = lambda part: (part * per - late) * width  # noqa: E731  all events of earlier seconds come before the part's batches

    carried = _carries(cells, gap).where(F.col("last") >= begins(F.col("part") + 1) - gap)
    carried = carried.select("user", (F.col("part") + 1).alias("part"), "batch", F.col("start").alias("a"), F.col("last").alias("b"), "n", "h")
    both = F.when(F.col("batch") < F.col("part") * per, F.array(F.col("part") - 1, F.col("part"))).otherwise(F.array("part"))
    rows = cells.select("user", F.explode(both).alias("part"), "batch", F.col("at").alias("a"), F.col("at").alias("b"), "n", "h").unionByName(carried)

    def run(stream):
        held, key = [], None
        out: list[list] = [[] for _ in range(12)]

        def close():
            made, ended = replay(held, key[1] * per, gap)
            edge = begins(key[1] + 1) - gap
            for s in made:
                by = s.by or (None, None)
                for c, x in zip(out, (key[0], s.batch, s.start, s.end, s.n, s.new, len(s.took), s.h, *by, 0, s.by is None and s.end >= edge), strict=True):
                    c.append(x)
            for s in ended:
                for c, x in zip(out, (key[0], s.batch, s.start, 0, 0, 0, 0, 0, *s.by, 1, False), strict=True):
                    c.append(x)

        def say():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (kind, *[pa.int64()] * 9, pa.int32(), pa.bool_()), strict=True)], names=NAMES)
            for c in out:
                c.clear()
            return batch

        for b in stream:
            kind = b.schema.field(0).type
            users, parts = b.column(0).to_pylist(), b.column(1).to_pylist()
            cut = [i for i in range(len(users)) if not i or users[i] != users[i - 1] or parts[i] != parts[i - 1]]
            rows_ = list(zip(*(np.asarray(b.column(i)).tolist() for i in range(2, 7)), strict=True))
            for i, j in zip(cut, [*cut[1:], len(users)], strict=True):
                if (users[i], parts[i]) != key:
                    if held:
                        close()
                    held, key = [], (users[i], parts[i])
                held.extend(rows_[i:j])
            if len(out[0]) >= 1 << 16:
                yield say()
        if held:
            close()
        if out[0]:
            yield say()

    schema = f"user {user}, batch long, start_s long, end_s long, n_events long, n_new long, n_retracted long, h_sum long, retracted_batch long, retracted_start_s long, kind int, open boolean"
    order = ["user", "part", "batch", "a"]
    found = materialise(rows.repartition("user", "part").sortWithinPartitions(*order).mapInArrow(run, schema), "session-versions")
    shown = NAMES[:10]
    done = found.where("kind = 0 and not open").select(shown)
    later = found.where("kind = 1").select(*NAMES[:3], F.col("retracted_batch").alias("_batch"), F.col("retracted_start_s").alias("_start"))
    ends = found.where("open").join(later, NAMES[:3], "left").withColumns({"retracted_batch": F.col("_batch"), "retracted_start_s": F.col("_start")})
    return done.unionByName(ends.select(shown))


NAMES = ["user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s", "kind", "open"]


def of_conversations(chats: DataFrame) -> DataFrame:
    """(user, batch, at, h): turns (conv_id, turn) as events, their times and delays drawn from checksums; rows without either are none."""
    crc = lambda c: F.crc32(c.cast("string").cast("binary"))
    rows = chats.where("turn is not null and conv_id is not null").select("conv_id", "turn", crc(F.col("conv_id")).alias("c"), crc(F.concat_ws(":", "conv_id", "turn")).alias("h"))
    rows = rows.withColumn("g", F.expr("h div 600")).withColumn("at", F.expr("(c div 2) % 7200 + 300 * turn + h % 600").cast("long"))
    user = F.expr("2 * ((conv_id - pmod(conv_id, 8)) div 8) + c % 2")
    batch = F.expr("(at - pmod(at, 1800)) div 1800 + if(g % 3 = 0, g % 4, 0)")
    return rows.select(user.cast("long").alias("user"), batch.cast("long").alias("batch"), "at", "h")
