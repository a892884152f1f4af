from tidemill.operators import text
from tidemill.streaming import metrics


def test_word_count_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("The ship\nthe sea\n")
    (folder / "b.txt").write_text("ship\n")
    counts = metrics.word_count_stream(metrics.line_stream(spark, str(folder), 1))
    metrics.to_table(counts, "stream_counts", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination(60)
    rows = {tuple(r) for r in spark.table("stream_counts").collect()}
    assert rows == {tuple(r) for r in text.word_count(spark.read.text(str(folder))).collect()} == {("the", 2), ("ship", 2), ("sea", 1)}
