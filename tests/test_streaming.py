from cuecraft.operators.chunking import chunk_cues
from cuecraft.streaming.ingest import current, start

CUES = "lecture_id string, seq bigint, start_us bigint, end_us bigint, content string"


def test_a_lecture_over_two_batches_is_cut_as_a_whole(spark, tmp_path):
    rows = [("l", k, k * 10, k * 10 + 9, f"Sentence {k} goes" if k % 2 else "on and ends.") for k in range(6)] + [("m", 0, 0, 5, "Other.")]
    for n, part in enumerate((rows[:3] + rows[6:], rows[3:6])):
        spark.createDataFrame(part, CUES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(CUES).parquet(str(tmp_path / "in"))
        start(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 10, 100, False).awaitTermination()
    whole = chunk_cues(spark.createDataFrame(rows, CUES), 10, 100, False)
    columns = ["lecture_id", "chunk_no", "piece_no", "start_us", "end_us", "text"]
    assert sorted(map(tuple, current(spark, str(tmp_path / "out")).select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
