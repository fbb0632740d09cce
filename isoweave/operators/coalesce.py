"""Greedy coalescing of byte ranges: order decides, so sorted ranges are streamed through Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

GROUPS = "file long, start_ long, end_ long, members long"


def coalesce_greedy(ranges: DataFrame, gap: int, span: int) -> DataFrame:
    """Groups of the ranges (file, off, len) of each file: sorted by offset, a range joins the open group if the gap
    before it and the group's span stay within bounds. Only the open group is held, so memory is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[int] | None = None
        for batch in batches:
            done = []
            for file, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "off", "len"))):
                if open_ and open_[0] == file and max(0, at - open_[2]) <= gap and max(open_[2], at + n) - open_[1] <= span:
                    open_[2], open_[3] = max(open_[2], at + n), open_[3] + 1
                else:
                    done += [open_] if open_ else []
                    open_ = [file, at, at + n, 1]
            yield rows(done)
        if open_:
            yield rows([open_])

    def rows(groups: list[list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([g[i] for g in groups], pa.int64()) for i in range(4)], names=["file", "start_", "end_", "members"])

    return ranges.repartition("file").sortWithinPartitions("file", "off", "len").mapInArrow(run, GROUPS)
