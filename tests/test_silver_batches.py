"""What a batch of streaming Silver holds while it is written."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import feed
from tidemark.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def test_only_rejected_rows_keep_their_text(spark):
    bronze = feed.bronze(spark, SMALL)
    rows = jobs._judged(bronze, feed.WATERMARK, 2)
    assert rows.filter("reason IS NULL AND raw IS NOT NULL").isEmpty()
    texts = bronze.select("source_key", F.col("raw").alias("given"))
    bad = rows.filter("reason IS NOT NULL").join(texts, "source_key")
    assert not bad.isEmpty()
    assert bad.filter(~F.col("raw").eqNullSafe(F.col("given"))).isEmpty()
