"""Company-research tables of the personalisation guide, re-aimed at data.

Research rows: ``(company, mission, values ARRAY, products ARRAY, tech_stack ARRAY,
recent_news ARRAY, hooks INT)``. Definitions are ours where the guide gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions.text import normalize_company, normalize_text

# Ours: research-quality levels by the number of news items plus hooks
# (the guide's bands are >= 6 / 3-4 / 1-2; 5 is undefined there and is medium here).
HIGH, MEDIUM = 6, 3


def research_quality(research: DataFrame) -> DataFrame:
    """Q8: ``research_quality`` high / medium / low / none."""
    n = F.coalesce(F.size("recent_news"), F.lit(0)) + F.coalesce(F.col("hooks"), F.lit(0))
    level = F.when(n >= HIGH, "high").when(n >= MEDIUM, "medium").when(n >= 1, "low").otherwise("none")
    return research.withColumn("research_quality", level)


def tech_stack_overlap(postings: DataFrame, research: DataFrame) -> DataFrame:
    """Q7: per posting, the research tech-stack items named in its text
    (joined on the normalised company; an equi-join, no pair expansion)."""
    r = research.select(normalize_company(F.col("company")).alias("_cn"), "tech_stack")
    text = F.concat(F.lit(" "), normalize_text(F.concat_ws(" ", F.coalesce(F.array_join("requirements", " "), F.lit("")),
                                                          F.coalesce("description", F.lit("")))), F.lit(" "))
    p = postings.withColumn("_cn", normalize_company(F.col("company_name"))).withColumn("_text", text)
    j = p.join(r, "_cn")
    hits = F.filter(F.col("tech_stack"), lambda s: F.col("_text").contains(F.concat(F.lit(" "), normalize_text(s),
                                                                                    F.lit(" "))))
    return (j.withColumn("stack_overlap", hits).withColumn("overlap_count", F.size("stack_overlap"))
            .drop("_cn", "_text", "tech_stack"))


def top_overlaps(overlaps: DataFrame, n: int = 10) -> DataFrame:
    """Q7 ranking: the ``n`` postings with most stack overlap (a top-k report)."""
    return overlaps.orderBy(F.col("overlap_count").desc(), F.col("seq").asc()).limit(n)


def progress_summary(state: DataFrame, research: DataFrame | None = None) -> DataFrame:
    """Success / fail shares of the tracker state, plus research-quality level
    counts and shares when research rows are given; tall ``(metric, value, share_pct)``."""
    total = F.count(F.lit(1))
    s = state.agg(total.alias("n"), F.count_if(F.col("status") == "completed").alias("ok"),
                  F.count_if(F.col("status") == "failed").alias("failed"))
    out = s.select(F.explode(F.array(
        F.struct(F.lit("successful").alias("metric"), F.col("ok").alias("value"),
                 F.when(F.col("n") > 0, F.round(F.col("ok") / F.col("n") * 100, 2)).alias("share_pct")),
        F.struct(F.lit("failed").alias("metric"), F.col("failed").alias("value"),
                 F.when(F.col("n") > 0, F.round(F.col("failed") / F.col("n") * 100, 2)).alias("share_pct")))).alias("m"))
    out = out.select("m.*")
    if research is not None:
        q = research_quality(research).groupBy("research_quality").agg(F.count(F.lit(1)).alias("value"))
        t = research.count()   # one number
        q = q.select(F.concat(F.lit("research_"), F.col("research_quality")).alias("metric"), "value",
                     F.round(F.col("value") / F.lit(float(max(t, 1))) * 100, 2).alias("share_pct"))
        out = out.unionByName(q)
    return out


def failed_with_reasons(state: DataFrame) -> DataFrame:
    """A18 failed list: failed entries with their ``reason`` extra."""
    return state.where(F.col("status") == "failed").select("session", "job_id", "company", "title",
                                                            F.col("extra")["reason"].alias("reason"))
