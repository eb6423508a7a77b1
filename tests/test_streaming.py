from datetime import datetime

from lectern.streaming import pages


def test_stream(spark, tmp_path):
    good = "1. What is it?\n1. A\n" + "words of a page " * 40
    rows = [(1, 1, good, None, None, datetime(2024, 1, 1, 0, 1)), (1, 2, "x", None, None, datetime(2024, 1, 1, 0, 2)), (2, 1, good, None, None, datetime(2024, 1, 1, 1, 0))]
    spark.createDataFrame(rows, "doc_id long, page_number int, native_text string, ocr_text string, ocr_word_conf double, ts timestamp").write.parquet(str(tmp_path / "in"))
    q = pages.quality_by_window(pages.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("pages_by_window").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.pages, r.native_pages) for r in spark.table("pages_by_window").collect()) == [(1, 1), (2, 1)]
