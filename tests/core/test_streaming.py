from quillspark.streaming.uploads import watch

from .test_changes import pdf


def test_each_file_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    for batch in (["a.pdf", "b.txt"], ["c.pdf"]):
        for name in batch:
            (folder / name).write_bytes(pdf(f"({name}) Tj".encode()))
        watch(spark, str(folder), out, state).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.extracted_text, r.extraction_status, r.page_count) for r in rows) == [("a.pdf", "completed", 1), ("c.pdf", "completed", 1)]
