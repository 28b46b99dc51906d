"""Arrow kernels: a function over the columns of a row gives the rows that come of it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


def rows(df: DataFrame, kernel: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """kernel(*columns of one row) for all rows of df; only its columns travel, and nothing is shuffled."""
    names = df.columns
    types = df.sparkSession.createDataFrame([], schema).schema
    out = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for values in zip(*[batch.column(n).to_pylist() for n in names]):
                found.extend(kernel(*values))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), out)], schema=out)

    return df.mapInArrow(run, types)
