"""One pass over each group's rows in order, for what is sequential inside a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that are held as Python values at a time, beside those of the group that is open.
STEP = 1024


def in_order(rows: DataFrame, key: str, order: str, run: Callable[[object, list[dict]], list[dict]], schema: str) -> DataFrame:
    """What ``run(key, rows)`` returns for the rows of every ``key``, by ``order``.

    Spark deals rows out by key and sorts them; a task reads its groups one behind the other from batches of many groups, so that a small group
    costs a call and not a batch, a frame and a sort of its own.
    """
    out_schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(out_schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, out = [], []
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                for row in batch.slice(k, STEP).to_pylist():
                    if group and row[key] != group[0][key]:
                        out += run(group[0][key], group)
                        group = []
                    group.append(row)
                if len(out) >= STEP:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if group:
            out += run(group[0][key], group)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(over, out_schema)
