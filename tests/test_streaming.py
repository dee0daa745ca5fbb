from __future__ import annotations

from sample_logs import whole

from plumbline.streaming import live


def test_counts(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text(whole([100] * 4).text + "\nstray line\n")
    query = live.counts(live.lines(spark, str(folder))).writeStream.outputMode("update").format("memory").queryName("live_counts").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        found = {r["event_type"]: r["n"] for r in spark.sql("SELECT event_type, sum(n) AS n FROM live_counts GROUP BY 1").collect()}
    finally:
        query.stop()
    assert found["task_start"] == 4 and found["task_finish"] == 4 and found["job_start"] == 1 and "stray" not in found
