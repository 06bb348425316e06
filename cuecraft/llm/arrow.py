"""Arrow batches in and out of Python operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch; one batch at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def int_lists(lists: list, kind: pa.DataType = pa.int32()) -> pa.ListArray:
    """A list array of lists of numbers, built from one flat buffer."""
    import itertools

    import numpy as np

    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter(itertools.chain.from_iterable(lists), dtype=kind.to_pandas_dtype(), count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))
