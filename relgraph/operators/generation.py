"""Where a text generator of one's own is put in: prompts go in, outputs come back as a table."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def generate(rows: DataFrame, load: Callable[[], Callable[[list[str], list[list[str]]], list[str]]], batch: int = 8) -> DataFrame:
    """(question, output, target) for rows (question, contexts, target) (ML2, ML7).

    load makes the model once in each Python worker; the model takes questions and their lists of
    contexts, at most ``batch`` at a time, and gives one output for each.
    """

    def run(batches):
        model = load()
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                out = model(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), part.column(2)], names=["question", "output", "target"])

    return rows.select("question", "contexts", "target").mapInArrow(run, "question string, output string, target string")
