"""Requests as a stream: sentences with exact matches as they come, and counts by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import norm, simple_sentences


def read_requests(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the request files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sentences(requests: DataFrame) -> DataFrame:
    """(req_id, received_at, sid, src, c0, c1): no state is kept."""
    s = requests.select("req_id", "received_at", F.explode(simple_sentences("src")).alias("s"))
    return s.select("req_id", "received_at", "s.sid", "s.src", "s.c0", "s.c1")


def first_deliveries(requests: DataFrame, delay: str = "2 days") -> DataFrame:
    """Each request once; a copy that comes later than the watermark counts anew."""
    return requests.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["req_id"])


def matched(mentions: DataFrame, text: str, lexicon: DataFrame) -> DataFrame:
    """A stream joined with the static lexicon."""
    return mentions.withColumn("term", norm(text)).join(lexicon, "term")


def volume(requests: DataFrame, window: str = "1 hour", delay: str = "2 days") -> DataFrame:
    """(start, client, requests, chars): complete windows once the watermark has passed them; later rows are dropped."""
    w = requests.withWatermark("received_at", delay).groupBy(F.window("received_at", window), "client")
    return w.agg(F.count("*").alias("requests"), F.sum(F.length("src")).alias("chars")).select(F.col("window.start").alias("start"), "client", "requests", "chars")
