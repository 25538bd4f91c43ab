"""Row-by-row work in Python, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Rows that a worker has as Python objects at once.
AT_ONCE = 100


def plain(a: pa.Array) -> list:
    """The array's values, as ``to_pylist`` gives them; nested ones are put together from whole columns, which is some times as fast."""
    if not len(a):
        return []  # without even the one offset that lists have else
    if pa.types.is_list(a.type):
        ends = a.offsets.to_numpy().tolist()
        inside, first = plain(a.values.slice(ends[0], ends[-1] - ends[0])), ends[0]
        got = [inside[x - first : y - first] for x, y in pairwise(ends)]
    elif pa.types.is_struct(a.type) and a.type.num_fields:
        names = [x.name for x in a.type]
        got = [dict(zip(names, v, strict=True)) for v in zip(*[plain(a.field(i)) for i in range(len(names))], strict=True)]
    elif a.null_count == 0 and (pa.types.is_integer(a.type) or pa.types.is_floating(a.type)):
        return a.to_numpy().tolist()
    else:
        return a.to_pylist()
    return got if a.null_count == 0 else [v if there else None for v, there in zip(got, a.is_valid().to_pylist(), strict=True)]


def map_rows(df: DataFrame, f: Callable[[dict], dict], spec: str) -> DataFrame:
    """``f`` of each row (a dict of plain Python values) as a table of schema ``spec``; no shuffle.

    A batch is made into Python objects AT_ONCE rows at a time, so nested rows
    take as little memory in a batch of any length.
    """
    kind = _parse_datatype_string(spec)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.system_memory_pool()  # gets back at once what a batch took
        if pa.default_memory_pool().backend_name != pool.backend_name:
            pa.set_memory_pool(pool)
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                some = b.slice(at, AT_ONCE)
                columns = [plain(c) for c in some.columns]
                yield pa.RecordBatch.from_pylist([f(dict(zip(b.schema.names, r, strict=True))) for r in zip(*columns, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to a few tasks for each core, for work that is long for the bytes of its rows: a small file is one task else."""
    return df.repartition(4 * max(df.sparkSession.sparkContext.defaultParallelism, 1))
