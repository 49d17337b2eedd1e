"""Reuse of built column expressions.

Building a rule expression from Python costs one Py4J round trip per
function call, thousands per query. Columns are unresolved expressions that
can be reused by any DataFrame, so rule builders are memoised per running
SparkContext and argument tuple (thresholds are frozen, hashable
dataclasses).
"""

from __future__ import annotations

import functools

from pyspark import SparkContext


def session_cached(builder):
    cache: dict = {}

    @functools.wraps(builder)
    def get(*args):
        sc = SparkContext._active_spark_context
        key = (sc.applicationId if sc else None, args)
        hit = cache.get(key)
        if hit is None:
            if len(cache) > 64:
                cache.clear()
            hit = cache[key] = builder(*args)
        return hit

    get.cache = cache
    return get
