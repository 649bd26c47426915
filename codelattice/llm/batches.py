"""Running plain Python over Arrow batches of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from codelattice.session import ship, spread


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Apply a per-batch function to ``df``.

    ``make`` is called once per task and returns a function from the batch's columns, as lists,
    to the output columns, as lists. Nothing is shuffled unless the input is a handful of splits.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            cols = f(*[b.column(n).to_pylist() for n in names])
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, out)], schema=out)

    ship(df.sparkSession)
    return spread(df).mapInArrow(run, schema)
