"""The SQL analysis and the column operators are one rule: NaN readings and
tuned thresholds give the same answer on every path."""

import math

from pyspark.sql import functions as F

from impactlens.config import Thresholds
from impactlens.operators import detect as det
from impactlens.operators.enrich import enrich
from impactlens.operators.stats import (batch_summary, crash_events, crash_patterns, driving_stats,
                                        normal_events, preview)

from helpers import frame, message
from impactlens.sources.ingest import parse_telemetry, prepare


def _good(spark, docs):
    return prepare(parse_telemetry(frame(spark, docs)))[0]


def test_nan_gyroscope(spark):
    good = _good(spark, [message(1, ax=32.0), message(2, ax=32.0)])
    broken = F.struct(F.lit(math.nan).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    good = good.withColumn("sensors", F.col("sensors").withField("gyroscope", broken))
    sql = crash_patterns(spark, good).collect()
    col = det.risk_category(enrich(good)).collect()
    assert {r["risk_category"] for r in sql} == {r["risk_category"] for r in col} == {"SIDE_IMPACT_RISK"}
    assert {r["crash_type"] for r in sql} == {"SIDE_IMPACT"}


def test_tuned_thresholds_agree(spark):
    good = _good(spark, [message(1, az=25.0), message(2, ax=15.0), message(3), message(4, ax=32.0)])
    for thr in (Thresholds(), Thresholds(lateral=1.0, vertical=1.0), Thresholds(g_force=2.0)):
        sql = {r["message_id"]: (r["crash_type"], r["risk_category"]) for r in crash_patterns(spark, good, thr).collect()}
        df = enrich(good, thr)
        col = {r["message_id"]: (r["crash_type"], r["risk_category"])
               for r in det.risk_category(det.classify(crash_events(df, "batch", thr), "batch", thr), thr).collect()}
        assert sql == col
        normal = {r["message_id"] for r in normal_events(df, "batch", thr).collect()}
        assert normal == {1, 2, 3, 4} - set(col)
        stats = driving_stats(df, thr).collect()
        assert sum(r["message_count"] for r in stats) == len(normal)
        tagged = det.detect(df.withColumn("reason", F.lit(None).cast("string")), "message", thr)
        summary = batch_summary(tagged, thr).collect()[0]
        assert summary["batch_crashes"] == summary["risk_events"] == len(col)


def test_preview_size_is_a_parameter(spark):
    df = spark.range(20)
    assert preview(df, "patterns").count() == 5 and preview(df, "patterns", 12).count() == 12


def test_means_do_not_depend_on_order(spark):
    from impactlens.functions.columns import exact_avg

    df = spark.range(20000).select((F.lit(0.1) * (F.col("id") % 7) + F.lit(0.05)).alias("x"))
    got = {df.repartition(n).agg(exact_avg(F.col("x")).alias("m")).collect()[0]["m"] for n in (1, 3, 8)}
    assert len(got) == 1
    odd = spark.createDataFrame([(1.0,), (math.nan,), (None,)], "x double")
    assert math.isnan(odd.agg(exact_avg(F.col("x"))).collect()[0][0])
    assert odd.limit(0).agg(exact_avg(F.col("x"))).collect()[0][0] is None


def test_table_function_with_thresholds_as_arguments(spark):
    """Two threshold sets in one statement; the defaults are those registered."""
    from impactlens.functions.sqlfuncs import crash_patterns_sql, register_table_function

    docs = [message(1, az=9.81), message(2, ax=25.0), message(3, az=35.0), message(4, az=60.0),
            message(5, sensors__gyroscope__y=3.5), message(6, speed_mph=1.0, ax=18.0)]
    register_table_function(spark, _good(spark, docs))
    usual = {r.message_id: r.crash_type for r in spark.sql("SELECT * FROM crashPatterns()").collect()}
    assert usual == {r.message_id: r.crash_type for r in spark.sql(crash_patterns_sql()).collect()} and usual
    both = spark.sql("""SELECT a.message_id, a.crash_type AS one, b.crash_type AS other
        FROM crashPatterns(lateralLimit => 2.0D, gLimit => 1D) a LEFT JOIN crashPatterns(rolloverLimit => 9.9D) b USING (message_id)""")
    got = {r.message_id: (r.one, r.other) for r in both.collect()}
    assert got[2] == ("SIDE_IMPACT", None) and got[5] == ("ROLLOVER", None) and got[1] == ("HIGH_G_FORCE", None)
    assert got[4][1] == usual[4]
