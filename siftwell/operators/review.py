"""Human review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators import filters as fl
from siftwell.operators import ordered as od

# Review settings.
THRESHOLD, SAMPLE_RATE, READ = 0.35, 0.1, 100


def hitl_queue(answers: DataFrame, threshold: float = THRESHOLD, rate: float = SAMPLE_RATE, key: str = "qid") -> DataFrame:
    """All answers to review: low confidence, or a stable sample by key."""
    low = F.col("confidence") < threshold
    return answers.filter(low | fl.in_sample(rate, key)).withColumn("review_reason", F.when(low, "low_conf").otherwise("sample"))


def review_page(queue: DataFrame, limit: int = READ, key: str = "qid") -> DataFrame:
    return od.keep_latest(queue, limit, [F.col("ts").desc(), F.col(key).desc()])
