"""Tables that come as folders of files."""

import __spark_entry__ as contract


def _documents(spark, n):
    return spark.range(n).selectExpr(
        "id AS doc_id", "concat('Pressure line ', id, ' near the valve. Café smoke seen') AS text",
        "CASE WHEN id % 2 = 0 THEN 'en' ELSE 'de' END AS lang", "'s' AS source", "60 + id AS n_chars")


def test_streams_read_a_table_of_several_files(spark, tmp_path):
    queries = contract.queries()
    _documents(spark, 300).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    for stream, batch in (("stream_monthly_trend", "monthly_trend"), ("stream_alerts", "alert_generation")):
        got, want = queries[stream](spark, str(tmp_path)), queries[batch](spark, str(tmp_path))
        rows = sorted(map(tuple, got.select(*want.columns).collect()), key=str)
        assert rows and rows == sorted(map(tuple, want.collect()), key=str)
