from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.streaming import changes


def test_diagnose_files_as_they_arrive(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    Path(src).mkdir()
    for k in range(2):
        (Path(src) / f"m{k}.bsl").write_text(f"Procedure P{k}()\n    Unknown{k}(1);\nEndProcedure\n")
        changes.diagnose(changes.module_stream(spark, src), out, state).awaitTermination(60)
    assert sorted(r.message for r in spark.read.json(out).collect()) == ["Unknown0 is not declared here", "Unknown1 is not declared here"]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no generated tables here")
def test_windowed_counts(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(path)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = changes.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {(str(r.start), r.event_type): r.n for r in spark.table("counts").collect()}
    want = {(str(r.s), r.event_type): r.n for r in events.groupBy(F.date_trunc("hour", "ts").alias("s"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want
