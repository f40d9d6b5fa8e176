from __future__ import annotations

from waymark.streaming.weekly import weekly_stream


def test_weeks_of_a_stream(spark, tmp_path):
    rows = [(1, "M", "P", "2024-01-03 10:00:00", 2), (1, "M", "P", "2024-01-07 23:59:59", 3), (1, "M", "P", "2024-01-08 00:00:00", 5), (1, "M", "P", "2024-03-01 00:00:00", 1)]
    df = spark.createDataFrame(rows, "id_student long, code_module string, code_presentation string, t string, sum_click int").selectExpr("id_student", "code_module", "code_presentation", "cast(t AS timestamp) AS ts", "sum_click")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = weekly_stream(stream, "2024-01-01").writeStream.format("memory").queryName("weeks").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["week_index"], r["clicks_total"]) for r in spark.sql("SELECT * FROM weeks").collect())
    assert got == [(1, 5), (2, 5)]
