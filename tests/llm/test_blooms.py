"""Bloom filters: nothing listed is lost, and the size is bounded."""

from textlab.llm import blooms


def test_filters_lose_nothing(spark):
    listed = spark.range(0, 4000, 4).withColumnRenamed("id", "doc")
    blocks = blooms.bloom(listed, "doc")
    assert blocks.count() <= blooms.BLOCKS
    rows = spark.range(4000).withColumnRenamed("id", "doc")
    passed = {r.doc for r in blooms.might_contain(rows, listed, "doc").collect()}
    assert set(range(0, 4000, 4)) <= passed and len(passed) < 1100
