"""Sequential folds over many small groups, without a call to the engine for each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shipping import ship


def fold_groups(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """fold(key, rows in order) -> output rows, for each group of `keys`.

    Groups are brought together by one shuffle and sorted in their partition (which spills); a task reads them as one stream
    and holds one group at a time.
    """
    ship(rows.sparkSession)
    out = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        now: tuple | None = None
        made: list[tuple] = []

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in made], schema=arrow)

        for batch in batches:
            names = batch.schema.names
            for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                row = dict(zip(names, values, strict=True))
                key = tuple(row[k] for k in keys)
                if key != now:
                    if held:
                        made.extend(fold(now, held))
                    held, now = [], key
                held.append(row)
            if len(made) >= 10_000:
                yield pack()
                made.clear()
        if held:
            made.extend(fold(now, held))
        yield pack()

    # By a hash of the keys: a partitioning by the keys themselves, inherited from below, is not taken on trust.
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, out)
