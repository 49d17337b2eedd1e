"""Comparison of the rows of a bucket with one another, in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_blocks(rows: DataFrame, sizes: DataFrame, key: str, row_id: str, block: int) -> DataFrame:
    """``rows`` with columns lo, hi, part. ``sizes``: (key, n) of the buckets. A
    bucket of up to ``block`` rows is one group (key, 0, 0); a larger one is
    dealt to ceil(n / block) parts by a hash of the row, and every two parts
    (and each alone) form a group, so that any two rows meet in exactly one
    group, which holds about two blocks at most. Only the few large buckets
    are joined to the rows."""
    large = sizes.where(F.col("n") > block).select(F.col(key).alias("_key"), F.ceil(F.col("n") / F.lit(block)).cast("int").alias("_parts"))
    dealt = (rows.join(large, F.col(key) == F.col("_key"), "left")
             .withColumn("_parts", F.coalesce("_parts", F.lit(1)))
             .withColumn("part", F.pmod(F.xxhash64(row_id), F.col("_parts")).cast("int"))
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))))
    return (dealt.withColumn("lo", F.least("part", "_other")).withColumn("hi", F.greatest("part", "_other"))
            .drop("_key", "_parts", "_other"))


def map_groups(rows: DataFrame, keys: list[str], order: str, work: Callable[[pa.Table, list], Iterator[pa.RecordBatch]],
               schema: str) -> DataFrame:
    """Runs ``work(table, starts)`` over whole groups: rows are dealt by
    ``keys`` and sorted, each call gets some complete groups, at ``starts``.
    Holds one group and one Arrow batch at a time."""

    def split(table: pa.Table) -> list:
        import numpy as np

        cols = [table.column(k).to_numpy() for k in keys]
        new = np.zeros(len(table), bool)
        new[:1] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new).tolist()

    def run(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            starts = split(held)
            if len(starts) > 1:
                yield from work(held.slice(0, starts[-1]), starts[:-1])
                held = held.slice(starts[-1])
        if held is not None and len(held):
            yield from work(held, [0])

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)
