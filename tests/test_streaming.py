import numpy as np
import pytest

from shapelake.operators.points import mean_shape
from shapelake.streaming import arrivals


def test_running_mean_equals_the_mean_of_all(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(s, s % 2, p, *map(float, rng.normal(size=3))) for s in range(6) for p in range(4)]
    for s in range(6):
        part = [r for r in rows if r[0] == s]
        spark.createDataFrame(part, arrivals.LANDMARKS).write.mode("append").parquet(str(tmp_path / "in"))
    stream = arrivals.running_mean_shape(arrivals.watch(spark, str(tmp_path / "in"), 2), "population")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: {(r.population, r.pidx): (r.x, r.y, r.z) for r in df.collect()}
    got, want = key(spark.table("running")), key(mean_shape(spark.createDataFrame(rows, arrivals.LANDMARKS), "population"))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
