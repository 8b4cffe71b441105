"""Folds over ordered rows of a key: the operators whose result depends on row order.

Rows are hash-partitioned by key and sorted within partitions by Spark, which spills; Python reads them as a stream
of Arrow batches and holds the state of one key at a time, never a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable, schema, partitions: int | None = None) -> DataFrame:
    """For each key ``start()`` gives ``(push, finish)``: ``push(row)`` for its rows in order, then ``finish()``.

    Both return output rows as tuples, without the key, which is put in front of them. ``schema`` has the keys first.
    ``partitions`` are not merged by their size, for rows that take long for their bytes.
    """
    names = list(rows.columns)
    at = [names.index(k) for k in keys]
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, push, finish = None, None, None
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                own = tuple(row[i] for i in at)
                if push is None or own != key:
                    if finish is not None:
                        out += [key + r for r in finish()]
                    key = own
                    push, finish = start()
                out += [key + r for r in push(row)]
            if len(out) >= 5000:
                yield _batch(out, target)
                out = []
        if finish is not None:
            out += [key + r for r in finish()]
        if out:
            yield _batch(out, target)

    dealt = rows.repartition(partitions, *keys) if partitions else rows.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
