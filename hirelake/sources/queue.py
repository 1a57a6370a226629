"""URL queue of the extraction step (S8, O6) and the page-derived queue (V5)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_url_queue(spark: SparkSession, path: str) -> DataFrame:
    """``{"urls": [{position, url, title, company}, ...]}`` files -> one row per url."""
    doc = spark.read.option("multiLine", True).json(path)
    return doc.select(F.explode("urls").alias("u")).select(
        F.col("u.position").cast("int").alias("position"), F.col("u.url").alias("url"),
        F.col("u.title").alias("title"), F.col("u.company").alias("company"))


def queue_from_pages(pages: DataFrame) -> DataFrame:
    """V5: a url queue derived from stored pages (position = page id, title from <title>,
    company = host)."""
    return pages.select(F.col("page_id").cast("int").alias("position"), "url",
                        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
                        F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1).alias("company"))


def first_n(queue: DataFrame, n: int) -> DataFrame:
    """The first ``n`` entries by position (a TakeOrderedAndProject)."""
    return queue.orderBy("position").limit(n)


def failed_urls(queue: DataFrame, errors: DataFrame, failed_at: datetime) -> DataFrame:
    """The queue entries that ``errors`` (``url, error``) names, as ``position, url, title, company, error, failed_at``; of several errors of a
    url the first in order."""
    first = errors.where(F.col("url").isNotNull()).groupBy("url").agg(F.min("error").alias("error"))
    return queue.join(first, "url").select("position", "url", "title", "company", "error", F.lit(failed_at).cast("timestamp").alias("failed_at"))
