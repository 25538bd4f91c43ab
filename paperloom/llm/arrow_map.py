"""Row-by-row work in Arrow batches of bounded bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of one Arrow batch sent to Python.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let the session cut Arrow batches by bytes as well as by rows.

    Very long texts then can't make a batch larger than a worker's memory.
    Workers are told where this package is, should they start elsewhere.
    """
    root, env = str(Path(__file__).parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), root]))
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", 4096)):
        if (spark.conf.get(key, None) or "") != str(value):
            spark.conf.set(key, str(value))


def lean() -> None:
    """In a worker: Arrow's buffers come from the system, which gets them back at once; pools would keep the most that ever was."""
    pool = pa.system_memory_pool()
    if pa.default_memory_pool().backend_name != pool.backend_name:
        pa.set_memory_pool(pool)


def schema_of(spec: str | StructType) -> tuple[StructType, pa.Schema]:
    kind = _parse_datatype_string(spec) if isinstance(spec, str) else spec
    return kind, to_arrow_schema(kind)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], spec: str | StructType) -> DataFrame:
    """``mapInArrow`` with state per task: ``make()`` runs once in each task and
    returns the function from a batch to columns (a dict of lists or arrays)."""
    bounded_batches(df.sparkSession)
    kind, arrow = schema_of(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        f = make()
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield pa.RecordBatch.from_arrays([c if isinstance(c := out[x.name], pa.Array) and c.type == x.type else pa.array(c, x.type) for x in arrow], schema=arrow)

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, kind)  # any names will do
