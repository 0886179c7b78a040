"""Streams over files and events, and the image text plug-in."""

import pytest
from pyspark.sql import functions as F

from lexigrain.operators import ocr
from lexigrain.streaming import arrivals

SF = "/root/testdata/sf0.001"


def drained(df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return df.sparkSession.table(name)


def parquet_stream(spark, table):
    static = spark.read.parquet(f"{SF}/{table}.parquet")
    return static, spark.readStream.schema(static.schema).parquet(f"{SF}/{table}*.parquet")


def test_search_on_a_stream(spark):
    static, stream = parquet_stream(spark, "conversations")
    got = drained(arrivals.search_stream(stream, "the"), "found")
    assert got.count() == static.where(F.instr("text", "the") > 0).count() > 0


def test_counts_by_window(spark):
    static, stream = parquet_stream(spark, "events")
    timed = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    got = drained(arrivals.counts_by_window(timed(stream), "ts", ["event_type"], "1 day"), "counted", "complete")
    want = timed(static).groupBy(F.window("ts", "1 day"), "event_type").count()
    assert got.count() == want.count() and got.agg(F.sum("n")).first()[0] == static.count()


def test_sessions(spark):
    static, stream = parquet_stream(spark, "events")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    got = drained(arrivals.sessions(stream, "ts", "user_id"), "sessions_seen", "complete")
    assert got.agg(F.sum("n")).first()[0] == static.count()


def test_arriving_files(spark, tmp_path):
    from tests.test_office import writing

    (tmp_path / "a.docx").write_bytes(writing())
    got = drained(arrivals.office_stream(spark, str(tmp_path), "docx_blocks"), "blocks")
    assert got.where("type = 'table'").count() == 1 and got.count() == 9


def reader():
    def read(data):
        if data == b"bad":
            raise ValueError("can't read it")
        return ocr.OcrResult("ok", data.decode(), (("ab", 1.0), ("abcdef", 0.5), ("x", 7.0)))

    return read


def test_images_once_each(spark):
    rows = [(1, b"one"), (2, b"two"), (3, b"one"), (4, b"bad"), (5, None)]
    out = {r["id"]: r for r in ocr.recognise(spark.createDataFrame(rows, "id long, content binary"), reader).collect()}
    assert [out[k]["ocr_text"] for k in (1, 2, 3)] == ["one", "two", "one"] and out[4]["ocr_status"] == "error" and out[5]["ocr_status"] is None
    assert out[1]["ocr_confidence"] == pytest.approx((2 * 1 + 6 * 0.5) / 8)


def test_suffixes():
    assert ocr.image_suffix(b"\x89PNG\r\n\x1a\nxx") == "png" and ocr.image_suffix(b"\xff\xd8\xffx") == "jpg" and ocr.image_suffix(b"what") is None
