"""Magnetic-field anomalies against a running baseline, with keyed state.

:func:`impactlens.operators.reconcile.magnetic_anomalies` compares messages
with the mean of a vehicle's whole history and needs it first. Here every
message is compared with the mean of those before it, as it arrives: the state
of a vehicle is the exact sum of its field magnitudes (in units of 1e-9) and
their number, 25 bytes or so, however long its history is.

Messages are taken in order of event time, then message id, within a
micro-batch, and micro-batch after micro-batch. A vehicle's first message has
nothing to be compared with. Magnitudes that no fixed-point number can hold
(NaN) are neither judged nor counted. Messages without a vin share the state of
one unknown vehicle. A task holds one vehicle's rows of one micro-batch, which
the source's limit bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.enrich import heading
from ..sources.ingest import prepare
from .jobs import TRIGGER_INTERVAL, _source, _trigger

UNIT = 10**9
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANOMALY = "message_id long, vin string, mag_magnitude double, baseline_magnitude double, deviation double"


class RunningBaseline(StatefulProcessor):
    """Per vehicle: (sum of magnitudes in 1e-9, number of messages)."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def init(self, handle) -> None:
        self.state = handle.getValueState("baseline", "total decimal(38,0), messages long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        from decimal import Decimal

        import numpy as np
        import pandas as pd

        own = pd.concat(list(rows), ignore_index=True).sort_values(["t", "message_id", "units"], kind="stable", ignore_index=True)
        total, messages = map(int, self.state.get()) if self.state.exists() else (0, 0)
        # Python integers: sums are exact whatever the history.
        sums = np.cumsum(np.concatenate([[total], own["units"].to_numpy()]).astype(object))
        counts = messages + np.arange(len(own))
        before = np.array([s / UNIT / n if n else np.nan for s, n in zip(sums[:-1], counts.tolist())])
        deviation = np.abs(own["mag_magnitude"].to_numpy() - before)
        found = deviation > self.threshold
        self.state.update((Decimal(int(sums[-1])), messages + len(own)))
        yield pd.DataFrame({"message_id": own["message_id"][found], "vin": key[0], "mag_magnitude": own["mag_magnitude"][found],
                            "baseline_magnitude": before[found], "deviation": deviation[found]})


def running_anomalies(df: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Anomalies of a streaming frame of prepared telemetry."""
    units = (F.col("mag_magnitude").try_cast("decimal(28,9)") * UNIT).cast("long")
    rows = (heading(df).filter(F.col("has_magnetometer"))
            .select("vin", F.unix_micros("event_time").alias("t"), "message_id", "mag_magnitude", units.alias("units"))
            .filter(F.col("units").isNotNull()))
    return rows.groupBy("vin").transformWithStateInPandas(
        statefulProcessor=RunningBaseline(threshold), outputStructType=ANOMALY, outputMode="Append", timeMode="None")


def start_running_anomalies(spark: SparkSession, source: str | DataFrame, out: str, checkpoint: str,
                            available_now: bool = False, threshold: float = 50.0,
                            interval: str = TRIGGER_INTERVAL, max_files_per_trigger: int | None = None,
                            max_messages_per_trigger: int | None = None) -> StreamingQuery:
    """Writes the anomalies of each micro-batch under its batch id."""
    good, _ = prepare(_source(spark, source, checkpoint, available_now, max_files_per_trigger, max_messages_per_trigger))

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    w = running_anomalies(good, threshold).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    # Keyed state of this kind needs this store; a query keeps the one it began with.
    held = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return _trigger(w, available_now, interval).queryName("impactlens_running_anomalies").start()
    finally:
        spark.conf.set(_PROVIDER, held) if held else spark.conf.unset(_PROVIDER)
