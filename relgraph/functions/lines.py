"""Operations on lines as table functions, for use in SQL over PARTITION BY."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import functions as F


def line_function(start: Callable[[], Any], step: Callable[[Any, Any], Iterable[tuple]], schema: str):
    """A Python table function that passes the rows of a partition by in order (the plug points of line and list drivers, TX21).

    start makes the state of a partition; step(state, row) may change it and gives rows of the schema. Register it with
    ``spark.udtf.register(name, ...)`` and call it as ``SELECT * FROM name(TABLE(t) PARTITION BY key ORDER BY place)``: a
    task holds the state of one partition at a time.
    """

    class Lines:
        def __init__(self):
            self.state = start()

        def eval(self, row):
            yield from step(self.state, row)

    return F.udtf(Lines, returnType=schema)


def process_pairs(processor: Callable[[str, list[dict]], Iterable[tuple]], schema: str):
    """A table function that calls processor(sentence, pairs) for each row (sent, pairs), pairs as dictionaries; rows without pairs are passed over (TX21, FI11)."""
    return line_function(lambda: None, lambda _, row: processor(row["sent"], [p.asDict(True) for p in row["pairs"]]) if row["pairs"] else (), schema)
