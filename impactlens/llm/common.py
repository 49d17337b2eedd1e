"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` to the shared folder and reads it back, so
    that neither a lost executor nor a second use computes it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def slices(sizes, limit: int):
    """(start, end) runs of consecutive rows whose sizes sum to ``limit`` at
    most (or hold a single row)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def texts_of(column: pa.Array) -> list:
    """Python strings of an Arrow text column; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def byte_sizes(column: pa.Array) -> list:
    """Bytes of each text; 0 for null."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()
