"""Running baselines against plain sums: order, restarts, a hot vehicle, NaN."""

import json
import os
import random

from helpers import message

from impactlens.streaming.baseline import start_running_anomalies


def _anomalies(messages, threshold=50.0):
    """(message, baseline) in order of arrival, with exact integer sums."""
    state, found = {}, {}
    for m in messages:
        x, y, z = (m["sensors"]["magnetometer"][a] for a in "xyz")
        size = (x * x + y * y + z * z) ** 0.5
        units, n = state.get(m["vin"], (0, 0))
        if n and abs(size - units / 10**9 / n) > threshold:
            found[m["message_id"]] = round(units / 10**9 / n, 9)
        state[m["vin"]] = (units + round(size * 10**9), n + 1)
    return found


def test_running_baseline(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    os.makedirs(src)
    r, batches, mid = random.Random(3), [], 0
    for day in range(3):
        own = []
        for k in range(120):
            mid += 1
            vin = "HOT" if k % 3 == 0 else r.choice(["A", "B", None])
            own.append(message(mid, vin=vin, timestamp=f"2024-07-2{day}T10:{k // 2:02d}:00Z",
                               sensors__magnetometer__z=r.choice([45.0, 46.5, 200.0 if k % 7 == 0 else 44.25])))
        batches.append(own)
    for i, own in enumerate(batches):  # each a run of its own: state outlives the query
        lines = [json.dumps(m) for m in own]
        r.shuffle(lines)
        with open(f"{src}/{i}.json", "w") as f:
            f.write("\n".join(lines))
        start_running_anomalies(spark, src, out, ckpt, available_now=True).awaitTermination()
    got = {x.message_id: x for x in spark.read.parquet(out).collect()}
    want = _anomalies([m for own in batches for m in own])
    assert {k: round(x.baseline_magnitude, 9) for k, x in got.items()} == want and len(want) >= 20
    assert {got[k].vin for k in got} >= {"HOT", None}
    states = {x.vin: x for x in spark.read.format("statestore").option("stateVarName", "baseline").load(ckpt)
              .selectExpr("key.vin AS vin", "value.messages AS messages").collect()}
    assert states["HOT"].messages == 120 and sum(s.messages for s in states.values()) == 360
