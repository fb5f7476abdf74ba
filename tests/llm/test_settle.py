"""Tasks of the pipeline's first stages give back what they freed."""

from tidemark.llm import similar, stages


def test_tasks_settle_when_they_end(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string")
    marks = spark.sparkContext.accumulator(0)
    for module in (similar, stages):
        monkeypatch.setattr(module, "settle", lambda: marks.add(1))
    assert similar.keep_first(docs).count() >= 1
    assert marks.value >= 2  # profiles and sets


def test_settle_returns():
    from tidemark.llm.common import settle
    assert settle() is None
