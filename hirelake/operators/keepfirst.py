"""Keep-first deduplication over two keys (W1) with its statistics.

Sequential rule: walking postings in ``seq`` order, a posting is a duplicate if
its url equals the url of an earlier *kept* posting (reason ``exact_url``,
tested first), else if its fuzzy key (P12) does (``fuzzy_match``); keys of
dropped postings are never remembered.

Distributed form (a greedy maximal independent set, decided in rounds): over
the undecided rows, a row is kept when it has the lowest seq of its url group
*and* of its key group; then every undecided row sharing a url or a key with a
row kept in this round is a duplicate. The lowest undecided row is always kept,
so every round makes progress; chains of alternating url/key links need one
round per link. Per round: two partial aggregates (min seq by url, by key),
joins on the unique ``seq``, and two semi-joins against at most one kept row per
key, so a hot url or key (a third of all rows) is combined map-side and handled
by AQE's skew-join split instead of landing in one task. Each round's frontier
is checkpointed into the shared checkpoint folder.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions.text import fuzzy_key, nullif_empty
from hirelake.plans import left_join_nonnull
from hirelake.session import cut_lineage, reuse

log = logging.getLogger(__name__)

UNIQUE, DUPLICATE = "unique", "duplicate"
EXACT_URL, FUZZY_MATCH = "exact_url", "fuzzy_match"


def with_keys(postings: DataFrame) -> DataFrame:
    """Adds ``url_key`` (truthy url) and ``fuzzy_key`` (P12 over company, title, location)."""
    return (postings.withColumn("url_key", nullif_empty(F.col("url")))
            .withColumn("fuzzy_key", fuzzy_key(F.col("company"), F.col("title"), F.col("location"))))


def _decide_round(u: DataFrame) -> DataFrame:
    """One round over undecided rows ``(seq, url_key, fuzzy_key)``; adds ``state``."""
    min_u = (u.where(F.col("url_key").isNotNull()).groupBy("url_key")
             .agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("_min_u")))
    min_k = (u.where(F.col("fuzzy_key").isNotNull()).groupBy("fuzzy_key")
             .agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("_min_k")))
    flagged = u.join(min_u, "seq", "left").join(min_k, "seq", "left")
    kept_now = ((F.col("url_key").isNull() | F.col("_min_u").isNotNull())
                & (F.col("fuzzy_key").isNull() | F.col("_min_k").isNotNull()))
    flagged = flagged.withColumn("_kept", kept_now).drop("_min_u", "_min_k")
    kept = flagged.where("_kept")
    kept_u = kept.where(F.col("url_key").isNotNull()).select("url_key", F.lit(True).alias("_hit_u"))
    kept_k = kept.where(F.col("fuzzy_key").isNotNull()).select("fuzzy_key", F.lit(True).alias("_hit_k"))
    out = left_join_nonnull(left_join_nonnull(flagged, kept_u, "url_key"), kept_k, "fuzzy_key")
    state = (F.when(F.col("_kept"), F.lit(UNIQUE))
             .when(F.col("_hit_u").isNotNull() | F.col("_hit_k").isNotNull(), F.lit(DUPLICATE)))
    return out.select("seq", "url_key", "fuzzy_key", state.alias("state"))


def keep_first_status(keys: DataFrame) -> tuple[DataFrame, int]:
    """Decides every row of ``(seq, url_key, fuzzy_key)``; returns the decided rows
    ``(seq, url_key, fuzzy_key, state)`` and the number of rounds used.

    The rounds end as each decides at least its lowest row. A row that repeats an earlier (url, key) needs no step of its own: it is decided with
    the earlier one, by the same kept row."""
    keys = reuse(keys.select("seq", "url_key", "fuzzy_key"))
    keyless = F.col("url_key").isNull() & F.col("fuzzy_key").isNull()
    undecided = keys.where(~keyless)
    out = keys.where(keyless).withColumn("state", F.lit(UNIQUE))
    rounds, left = 0, undecided.limit(1).count()
    while left:
        rounds += 1
        step = cut_lineage(_decide_round(undecided))
        out = out.unionByName(step.where(F.col("state").isNotNull()))
        undecided = step.where(F.col("state").isNull()).select("seq", "url_key", "fuzzy_key")
        left = undecided.count()
        log.info("keep-first round %d: %d undecided", rounds, left)
    return out, rounds


def keep_first(postings: DataFrame) -> DataFrame:
    """Every posting with ``status`` (unique / duplicate), ``duplicate_reason``
    and ``fuzzy_key``.

    Reason: ``exact_url`` when a kept posting with a lower seq has the same url,
    else ``fuzzy_match``. A url has at most one kept posting, so this is an
    equi-join against one row per url.
    """
    keyed = with_keys(postings)
    status, _ = keep_first_status(keyed.select("seq", "url_key", "fuzzy_key"))
    kept_url = (status.where((F.col("state") == UNIQUE) & F.col("url_key").isNotNull())
                .select("url_key", F.col("seq").alias("_kept_seq")))
    reasoned = (left_join_nonnull(status, kept_url, "url_key")
                .select("seq", "state",
                        F.when(F.col("state") == UNIQUE, F.lit(None).cast("string"))
                        .when(F.col("_kept_seq") < F.col("seq"), F.lit(EXACT_URL))
                        .otherwise(F.lit(FUZZY_MATCH)).alias("duplicate_reason")))
    return (keyed.drop("url_key").join(reasoned, "seq")
            .withColumnRenamed("state", "status"))


def consolidation_stats(decided: DataFrame) -> DataFrame:
    """A2: total, unique, duplicates and duplicate rate (round 2, half-even)."""
    one = decided.agg(F.count(F.lit(1)).alias("total_jobs"),
                      F.count_if(F.col("status") == UNIQUE).alias("unique_jobs"),
                      F.count_if(F.col("status") == DUPLICATE).alias("duplicates"))
    rate = F.when(F.col("total_jobs") > 0,
                  F.bround(F.col("duplicates") / F.col("total_jobs") * 100.0, 2)).otherwise(F.lit(0.0))
    return one.select("*", rate.alias("duplicate_rate"))


def duplicates_by_reason(decided: DataFrame) -> DataFrame:
    """Duplicate count per reason."""
    return (decided.where(F.col("status") == DUPLICATE).groupBy("duplicate_reason")
            .agg(F.count(F.lit(1)).alias("duplicates")))


def session_counts(postings: DataFrame, structure_type: DataFrame | None = None) -> DataFrame:
    """A1: postings loaded per session (with the session's structure type when given)."""
    counts = postings.groupBy("session").agg(F.count(F.lit(1)).alias("jobs_count"))
    if structure_type is not None:
        counts = structure_type.join(counts, "session", "left").fillna(0, ["jobs_count"])
    return counts
