"""Three-stage entity resolution with merge.

Stages, each over what the earlier ones left:

1. exact url (J1): url groups of two or more; all members are marked.
2. composite key (J2): P10 company | P9 title | P11 location; each non-canonical
   member forms its own group with the canonical, confidence 85 + 10 x Jaccard of
   the descriptions; only the duplicates are marked.
3. fuzzy (J3, optional): blocked similarity join in ``hirelake.operators.simjoin``.

The canonical of a group is the member with the highest completeness (P14),
lowest ``seq`` on ties (W2). Groups are numbered ``dup_%03d`` in the order the
sequential algorithm emits them (W4), with the two-phase rank.

Duplicate groups are kept *tall*: one row per (group, duplicate) edge. A hot url
holding a third of all rows is then a long run of edge rows, aggregated map-side,
never an array in one task. The urls, sessions and original ids of a merged group are
tall as well (``merge_values``), with their counts in the merged posting, which also lists its urls and sessions.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.functions.text import (composite_key, normalize_company, normalize_location,
                                     normalize_text, nullif_empty, text_words, truthy_str)
from hirelake.plans.ranks import rank_within
from hirelake.plans.sequence import assign_sequence
from hirelake.session import cut_lineage, reuse

# ---------------------------------------------------------------------------
# Fixed values of the reference
# ---------------------------------------------------------------------------
EXACT_URL, COMPOSITE, FUZZY = "exact_url", "normalized_composite", "fuzzy_match"
EXACT_URL_CONFIDENCE = 99
COMPOSITE_BASE, COMPOSITE_SPAN = 85, 10
MERGE_THRESHOLD = 85
REVIEW_FLOOR = 60
FILL_FIELDS = ["salary", "contact_email", "benefits", "requirements"]
COVERAGE_FIELDS = ["salary", "contactEmail", "benefits", "requirements"]
COMPLETENESS_FIELDS = 8
MATCHED_FIELDS = {EXACT_URL: ["url"], COMPOSITE: ["company", "title", "location"], FUZZY: ["company", "title"]}
REVIEW_REASON, MEDIUM_FROM = "low_confidence_match", 70
LOW_CONFIDENCE, LOW_REASON, OTHER_REASON = 75, "Low confidence match (60-75%)", "Other"
# Duplicates that meet one copy of their canonical's word set (ours):
OVERLAP_BLOCK = 256
# ---------------------------------------------------------------------------


def filled_flags(df: DataFrame) -> dict[str, Column]:
    """Whether each text field is filled (non-empty string or object), as the flattened record says (``*_filled``), else as
    the typed columns show."""
    shown = {"title": truthy_str(df["title"]), "company": truthy_str(df["company"]),
             "location": F.coalesce(df["location_present"], F.lit(False)) | truthy_str(df["location"]),
             "description": truthy_str(df["description"])}
    return {f: df[f"{f}_filled"] if f"{f}_filled" in df.columns else c for f, c in shown.items()}


def with_filled(postings: DataFrame) -> DataFrame:
    """The postings with their ``*_filled`` flags: what measures completeness then reads and moves a flag, never a text."""
    return postings.withColumns({f"{f}_filled": c for f, c in filled_flags(postings).items()})


def completeness(df: DataFrame) -> Column:
    """Share x100 of the 8 fields that are filled (non-empty string, object or list)."""
    filled = [
        *filled_flags(df).values(), F.coalesce(F.size(df["requirements"]) > 0, F.lit(False)),
        F.coalesce(df["salary_present"], F.lit(False)), truthy_str(df["contact_email"]),
        F.coalesce(F.size(df["benefits"]) > 0, F.lit(False)),
    ]
    n = sum((f.cast("int") for f in filled[1:]), filled[0].cast("int"))
    return n / F.lit(float(COMPLETENESS_FIELDS)) * F.lit(100.0)


def _salary_struct(df: DataFrame) -> Column:
    return F.when(F.coalesce(df["salary_present"], F.lit(False)),
                  F.struct(df["salary_min"].alias("min"), df["salary_max"].alias("max"),
                           df["salary_currency"].alias("currency"), df["salary_period"].alias("period")))


def url_key(p: DataFrame) -> Column:
    """The first of the url fields, where the record was ingested."""
    own = nullif_empty(p["url"])
    return F.coalesce(nullif_empty(p["any_url"]), own) if "any_url" in p.columns else own


def prepare(postings: DataFrame) -> DataFrame:
    """Per-posting columns used by every stage, computed once (never inside a pair loop)."""
    p = postings
    loc = normalize_location(p["location_city"], p["location_country"],
                             F.coalesce(p["location_is_object"], F.lit(False)),
                             F.coalesce(p["location_text"], p["location"]))
    return p.select(
        "seq", "master_id", "original_id", "session", url_key(p).alias("url_key"),
        completeness(p).alias("completeness"),
        normalize_company(p["company_name"]).alias("company_norm"),
        normalize_text(p["title"]).alias("title_norm"),
        truthy_str(p["title"]).alias("title_truthy"),
        loc.alias("location_norm"),
        _salary_struct(p).alias("own_salary"),
        F.when(truthy_str(p["contact_email"]), p["contact_email"]).alias("own_contact_email"),
        F.when(F.size(p["benefits"]) > 0, p["benefits"]).alias("own_benefits"),
        F.when(F.size(p["requirements"]) > 0, p["requirements"]).alias("own_requirements"),
    )


def _canon(df: DataFrame) -> Column:
    """W2 as an aggregate: highest completeness, then lowest seq."""
    return F.min(F.struct((-F.col("completeness")).alias("neg_c"), F.col("seq").alias("seq"),
                          F.col("master_id").alias("master_id"))).alias("canon")


def _edge(df: DataFrame, strategy: str, order1: Column, order2: Column, confidence: Column,
          canonical_seq: Column, canonical_id: Column, desc_sim: Column | None = None,
          sims: tuple[Column, Column, Column] | None = None) -> DataFrame:
    null_d = F.lit(None).cast("double")
    return df.select(
        F.lit(strategy).alias("strategy"), order1.cast("bigint").alias("order1"),
        order2.cast("bigint").alias("order2"), confidence.cast("int").alias("confidence"),
        canonical_seq.alias("canonical_seq"), canonical_id.alias("canonical_id"),
        F.col("seq").alias("dup_seq"), F.col("master_id").alias("dup_id"),
        F.col("session").alias("dup_session"),
        (desc_sim if desc_sim is not None else null_d).alias("description_similarity"),
        *[(s if sims is not None else null_d).alias(n)
          for s, n in zip(sims or (None, None, None), ["sim_company", "sim_title", "sim_location"])],
    )


def exact_url_edges(prep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, marked seqs). Every member of a multi-posting url group is marked."""
    u = prep.where(F.col("url_key").isNotNull())
    groups = (u.groupBy("url_key").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), _canon(u))
              .where(F.col("n") > 1).drop("n"))
    members = u.join(groups, "url_key")
    edges = _edge(members.where(F.col("master_id") != F.col("canon.master_id")), EXACT_URL,
                  F.col("first_seq"), F.lit(0), F.lit(EXACT_URL_CONFIDENCE),
                  F.col("canon.seq"), F.col("canon.master_id"))
    return edges, members.select("seq")


def word_overlap(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(seq, canon_seq, similarity)``: Jaccard similarity of the word sets of two descriptions, 0 where either has no words.

    Only the texts of ``pairs`` are cut into words, each in the row of its posting, never a row per word. They meet by
    canonical and block: a canonical stands there once for each ``OVERLAP_BLOCK`` of its duplicates, so that those of a hot one are
    not one task. The texts are dealt out, which are shorter than their lists of words; the words are cut where they meet, and
    only counts are stored. The join with texts is merged: the size that a plan expects of a text column is too small, and it would be broadcast."""
    blocks = pairs.groupBy("canon_seq").agg(F.ceil(F.count(F.lit(1)) / F.lit(OVERLAP_BLOCK)).cast("int").alias("blocks"))
    dups = (pairs.groupBy("seq", "canon_seq").agg(F.count(F.lit(1)).alias("times")).join(blocks, "canon_seq")
            .select("seq", "canon_seq", F.pmod(F.xxhash64("seq"), F.col("blocks")).cast("int").alias("block"), "times"))
    canons = blocks.select(F.col("canon_seq").alias("seq"), "canon_seq",
                           F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).cast("bigint").alias("times"))
    told = (texts.where(truthy_str(F.col("description"))).hint("merge").join(dups.unionByName(canons), "seq")
            .repartition("canon_seq", "block").select("seq", "canon_seq", "block", "times", text_words(F.col("description")).alias("words")))
    block = Window.partitionBy("canon_seq", "block")
    met = told.withColumn("canon_sets", F.collect_list(F.when(F.col("times") == 0, F.col("words"))).over(block))
    shared = F.aggregate("canon_sets", F.lit(0), lambda n, words: n + F.size(F.array_intersect(F.col("words"), words)))
    sets = cut_lineage(met.select("seq", "canon_seq", "block", "times", F.size("words").alias("n"),
                                  F.when((F.col("times") > 0) & (F.size("canon_sets") > 0), shared * F.col("times")).alias("common")))
    own, canon = sets.where("times > 0"), sets.where("times = 0")
    common = own.groupBy("seq").agg(F.sum("common").alias("common"))
    counted = (pairs.select("seq", "canon_seq").join(common, "seq", "left")
               .join(own.groupBy("seq", "canon_seq").agg(F.sum("n").alias("n")), ["seq", "canon_seq"], "left")
               .join(canon.where("block = 0").groupBy("canon_seq").agg(F.sum("n").alias("canon_n")), "canon_seq", "left"))
    both = F.coalesce("common", F.lit(0))
    return counted.select("seq", "canon_seq", F.when(both > 0, both / (F.col("n") + F.col("canon_n") - both)).otherwise(F.lit(0.0)).alias("similarity"))


def composite_edges(residual: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One edge per non-canonical member of a composite-key group; marks the duplicates. Groups are found on
    narrow rows; ``texts`` (``seq, description``) is read for their members only."""
    ckey = composite_key(F.col("company_norm"), F.col("title_norm"), F.col("location_norm"))
    r = residual.select("seq", "master_id", "session", "completeness", ckey.alias("ckey")).where(F.col("ckey").isNotNull())
    groups = (r.groupBy("ckey").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), _canon(r))
              .where(F.col("n") > 1).drop("n"))
    others = reuse(r.join(groups, "ckey").withColumn("canon_seq", F.col("canon.seq")).where(F.col("seq") != F.col("canon_seq")))
    similar = word_overlap(texts, others.select("seq", "canon_seq")).drop("canon_seq")
    sim = F.col("similarity")
    edges = _edge(others.join(similar, "seq"), COMPOSITE, F.col("first_seq"), F.col("seq"),
                  F.floor(F.lit(float(COMPOSITE_BASE)) + sim * F.lit(float(COMPOSITE_SPAN))),
                  F.col("canon.seq"), F.col("canon.master_id"),
                  desc_sim=F.bround(sim * F.lit(100.0), 1))
    return edges, others.select("seq")


def detect_duplicates(postings: DataFrame, fuzzy: bool = False, **fuzzy_opts) -> DataFrame:
    """Duplicate edges of all stages (one row per group and duplicate), numbered with
    ``group_seq`` / ``group_id`` in the order the sequential algorithm emits groups."""
    prep = prepare(postings)
    narrow = reuse(prep.select(*[c for c in prep.columns if not c.startswith("own_")]))
    e1, marked1 = exact_url_edges(narrow)
    r1 = narrow.join(marked1, "seq", "left_anti")
    e2, marked2 = composite_edges(r1, postings.select("seq", "description"))
    edges = e1.unionByName(e2)
    if fuzzy:
        from hirelake.operators.simjoin import fuzzy_edges
        r2 = r1.join(marked2, "seq", "left_anti")
        edges = edges.unionByName(fuzzy_edges(r2, **fuzzy_opts))
    edges = cut_lineage(edges)
    narrow.unpersist(blocking=False)
    rank = F.when(F.col("strategy") == EXACT_URL, 1).when(F.col("strategy") == COMPOSITE, 2).otherwise(3)
    groups = edges.select("strategy", "order1", "order2").distinct().withColumn("srank", rank)
    groups = assign_sequence(groups, ["srank", "order1", "order2"], name="group_seq").drop("srank")
    groups = groups.withColumn("group_id", F.format_string("dup_%03d", F.col("group_seq")))
    return cut_lineage(edges.join(groups, ["strategy", "order1", "order2"]))   # read by several reports


def matched_fields(strategy: Column) -> Column:
    """The fields that a strategy compares."""
    out = F.array().cast("array<string>")
    for name, fields in MATCHED_FIELDS.items():
        out = F.when(strategy == name, F.array(*[F.lit(f) for f in fields])).otherwise(out)
    return out


def group_table(edges: DataFrame) -> DataFrame:
    """One row per group (duplicate count instead of the nested duplicates list)."""
    return (edges.groupBy("group_seq", "group_id", "strategy", "confidence", "canonical_seq", "canonical_id")
            .agg(F.count(F.lit(1)).alias("duplicate_count")))


# ------------------------------------------------------------------ merge

def fold_fills(edges: DataFrame, own: DataFrame) -> DataFrame:
    """Value of each fill field at the time of each merge edge (section 4.5).

    ``val(e=(c, d, g))`` = d's own value, else the value of d's earliest out-edge
    (as a canonical) that is filled and earlier than g. An edge waits only for earlier out-edges of d, so
    each round settles those that wait for none and carries on with the others: every edge is settled once,
    in the round of its depth, and rounds shrink along the chains. The per-canonical step is an
    aggregate (combined map-side), never a pair expansion.
    Returns, per canonical, its first filled out-edge per field (value + source).
    """
    e = edges.select(F.col("canonical_seq").alias("c"), F.col("dup_seq").alias("d"),
                     F.col("group_seq").alias("g"), F.col("dup_session"))
    waiting = cut_lineage(e.join(own.withColumnRenamed("seq", "d"), "d", "left"))

    def firsts(settled: DataFrame) -> DataFrame:
        aggs = [F.min(F.when(F.col(f"v_{f}").isNotNull(),
                             F.struct(F.col("g"), F.col("d"), F.col(f"v_{f}").alias("v"),
                                      F.col("dup_session").alias("src")))).alias(f"first_{f}")
                for f in FILL_FIELDS]
        return settled.groupBy("c").agg(*aggs)

    settled, seen = None, False   # seen: a first filled edge so far, per waiting edge, stands in ``seen_*``
    while True:   # the earliest waiting edge is always settled
        ahead = waiting.groupBy(F.col("c").alias("d")).agg(F.min("g").alias("ahead"))
        reach = {f: F.when(F.col(f"seen_{f}.g") < F.col("g"), F.col(f"seen_{f}.v")) if seen else F.lit(None) for f in FILL_FIELDS}
        step = cut_lineage(waiting.join(ahead, "d", "left").withColumn("ready", ~F.coalesce(F.col("ahead") < F.col("g"), F.lit(False)))
                           .drop("ahead").withColumns({f"v_{f}": F.coalesce(F.col(f"own_{f}"), reach[f]) for f in FILL_FIELDS}))
        ready = step.where("ready").select("c", "d", "g", "dup_session", *[f"v_{f}" for f in FILL_FIELDS])
        settled = ready if settled is None else settled.unionByName(ready)
        waiting = step.where(~F.col("ready")).drop("ready", *[f"v_{f}" for f in FILL_FIELDS])
        if waiting.limit(1).count() == 0:
            return firsts(settled)
        found = firsts(ready).withColumnRenamed("c", "d")
        earlier = {f"seen_{f}": F.least(f"seen_{f}", f"first_{f}") if seen else F.col(f"first_{f}") for f in FILL_FIELDS}
        waiting = waiting.join(found, "d", "left").withColumns(earlier).drop(*[f"first_{f}" for f in FILL_FIELDS])
        seen = True


def merge_values(postings: DataFrame, last_edges: DataFrame) -> DataFrame:
    """What a merged posting collects, tall: ``(seq, kind, position, value)`` with the distinct urls, sessions and original ids of its
    group in the order they are first seen, the canonical's own first (also if NULL; a duplicate's missing url is not collected)."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in ("url", "session", "original_id")])).alias("v")
    own = postings.select(F.col("seq").alias("member"), url_key(postings).alias("url"), "session", "original_id")
    dups = last_edges.select(F.col("canonical_seq").alias("seq"), F.col("dup_seq").alias("member"), F.col("dup_seq").alias("at"), F.lit(False).alias("first"))
    canon = (last_edges.select(F.col("canonical_seq").alias("seq")).distinct()
             .select("seq", F.col("seq").alias("member"), F.lit(-1).cast("bigint").alias("at"), F.lit(True).alias("first")))
    # the members first, then their values: a posting outside the groups is never three rows
    tall = dups.unionByName(canon).join(own, "member").select("seq", "at", "first", kinds).select("seq", "at", "first", "v.kind", "v.value")
    first = (tall.where(F.col("first") | (F.col("kind") != "url") | F.col("value").isNotNull())
             .groupBy("seq", "kind", "value").agg(F.min("at").alias("at")))
    return rank_within(cut_lineage(first), ["seq", "kind"], "at", "position", tie=["value"]).select("seq", "kind", "position", "value")


def merge_duplicates(postings: DataFrame, edges: DataFrame, threshold: int = MERGE_THRESHOLD,
                     parity_before: bool = False, as_of: datetime | None = None) -> dict[str, DataFrame]:
    """F15 + W6 + W7 + J7.

    Returns ``unique`` (kept postings, canonicals with filled fields and
    ``duplicate_metadata`` of their last merge group, ``merge_date`` being ``as_of``), ``values`` (the urls, sessions and original
    ids that those collect, tall: see :func:`merge_values`), ``review`` (P20 queue),
    ``groups`` (one row per group), ``removed`` (seqs) and ``before``, the postings that the quality
    report compares with: the originals, or with ``parity_before`` every posting with fills applied (the
    reference measures these, as its merge mutates the original rows). ``after`` is ``unique`` with the ``*_filled`` flags
    that the quality report measures; ``before`` has them too.
    """
    merge_edges = edges.where(F.col("confidence") >= threshold)
    own = prepare(postings).select("seq", *[F.col(f"own_{f}") for f in FILL_FIELDS])
    first = fold_fills(merge_edges, own)
    filled_cols = []
    for f in FILL_FIELDS:
        filled_cols += [F.col(f"first_{f}.v").alias(f"fill_{f}"), F.col(f"first_{f}.src").alias(f"fill_{f}_src")]
    fills = first.select(F.col("c").alias("seq"), *filled_cols)

    # Metadata of the last merge group per canonical
    groups = cut_lineage(group_table(edges))
    last = (groups.where(F.col("confidence") >= threshold)
            .groupBy("canonical_seq").agg(F.max("group_seq").alias("group_seq")))
    last_edges = merge_edges.join(last, ["canonical_seq", "group_seq"])
    values = cut_lineage(merge_values(postings, last_edges))
    numbers = values.groupBy("seq").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in ("url", "session", "original_id")])
    def listed(kind: str) -> Column:   # a group has one url or two postings, and no more sessions than there are
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("position", "value")))), lambda v: v["value"])
    lists = values.where(F.col("kind") != "original_id").groupBy("seq").agg(listed("url").alias("duplicate_urls"), listed("session").alias("session_sources"))
    meta = (groups.join(last, ["canonical_seq", "group_seq"]).join(numbers.withColumnRenamed("seq", "canonical_seq"), "canonical_seq")
            .join(lists.withColumnRenamed("seq", "canonical_seq"), "canonical_seq"))
    meta = meta.select(
        F.col("canonical_seq").alias("seq"),
        F.struct(
            F.lit(True).alias("is_canonical"),
            "duplicate_count", "duplicate_urls", "session_sources", "n_urls", "n_sessions", "n_original_ids",
            F.lit(as_of).cast("timestamp").alias("merge_date"),
            F.col("strategy").alias("merge_strategy"),
            F.col("confidence").alias("merge_confidence"),
            F.col("group_id").alias("merge_group_id"),
        ).alias("duplicate_metadata"))

    removed = merge_edges.select(F.col("dup_seq").alias("seq")).distinct()
    flagged = with_filled(postings)   # before the joins: what is only measured takes no text through them
    filled = flagged.join(fills, "seq", "left")
    own_filled = {
        "salary": F.coalesce(F.col("salary_present"), F.lit(False)),
        "contact_email": truthy_str(F.col("contact_email")),
        "benefits": F.coalesce(F.size("benefits") > 0, F.lit(False)),
        "requirements": F.coalesce(F.size("requirements") > 0, F.lit(False)),
    }
    sal = F.col("fill_salary")
    filled = filled.select(
        *[c for c in flagged.columns if c not in ("salary_present", "salary_min", "salary_max", "salary_currency",
                                                   "salary_period", "contact_email", "benefits", "requirements")],
        (F.coalesce(F.col("salary_present"), F.lit(False)) | sal.isNotNull()).alias("salary_present"),
        *[F.when(F.coalesce(F.col("salary_present"), F.lit(False)), F.col(f"salary_{k}")).otherwise(sal[k])
          .alias(f"salary_{k}") for k in ("min", "max", "currency", "period")],
        F.coalesce(nullif_empty(F.col("contact_email")), F.col("fill_contact_email")).alias("contact_email"),
        F.when(F.size("benefits") > 0, F.col("benefits")).otherwise(F.col("fill_benefits")).alias("benefits"),
        F.when(F.size("requirements") > 0, F.col("requirements")).otherwise(F.col("fill_requirements"))
        .alias("requirements"),
        *[F.when(~own_filled[f], F.col(f"fill_{f}_src")).alias(f"{f}_source") for f in FILL_FIELDS],
    )
    after = filled.join(removed, "seq", "left_anti").join(meta, "seq", "left")
    added = [c for c in flagged.columns if c not in postings.columns]
    review = review_queue(groups, threshold, edges)
    return {"unique": after.drop(*added), "values": values, "review": review, "groups": groups, "removed": removed,
            "before": filled if parity_before else flagged, "after": after}


def review_queue(groups: DataFrame, threshold: int = MERGE_THRESHOLD, edges: DataFrame | None = None) -> DataFrame:
    """P20 + W5: ``review_%03d`` in group order for 60 <= confidence < threshold.
    Review groups come from J3 only and hold one duplicate each; with ``edges`` given its
    id is in ``duplicate_ids``."""
    rv = groups.where((F.col("confidence") >= REVIEW_FLOOR) & (F.col("confidence") < threshold))
    rv = assign_sequence(rv, ["group_seq"], name="review_seq")
    ids = []
    if edges is not None:
        per = edges.select("group_seq", F.array("dup_id").alias("duplicate_ids"))
        rv, ids = rv.join(per, "group_seq", "left"), ["duplicate_ids"]
    return rv.select(
        F.format_string("review_%03d", F.col("review_seq")).alias("review_id"),
        F.when(F.col("confidence") >= MEDIUM_FROM, "medium").otherwise("high").alias("priority"),
        "group_id", F.lit(REVIEW_REASON).alias("reason"), "confidence",
        F.col("canonical_id").alias("canonical_job_id"), "strategy", "group_seq", *ids)


# ------------------------------------------------------------------ reports

def _counts(**frames: DataFrame) -> DataFrame:
    """One row with the row count of each frame (a tall union folded by one aggregate)."""
    tall = None
    for name, df in frames.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("k"), "n")
        tall = part if tall is None else tall.unionByName(part)
    return tall.agg(*[F.max(F.when(F.col("k") == name, F.col("n"))).alias(name) for name in frames])


def dedup_summary(postings: DataFrame, merged: dict[str, DataFrame]) -> DataFrame:
    """Total, unique, duplicates, duplicate rate, groups, flagged for review."""
    one = _counts(total_jobs=postings, unique_jobs=merged["unique"], duplicate_groups=merged["groups"],
                  flagged_for_review=merged["review"])
    dup = F.col("total_jobs") - F.col("unique_jobs")
    return one.select("total_jobs", "unique_jobs", dup.alias("duplicates"),
                      F.when(F.col("total_jobs") > 0, F.bround(dup / F.col("total_jobs") * 100.0, 1))
                      .otherwise(F.lit(0.0)).alias("duplicate_rate"),
                      "duplicate_groups", "flagged_for_review")


def strategy_stats(postings: DataFrame, merged: dict[str, DataFrame]) -> DataFrame:
    """Duplicates matched, mean group confidence and share of removed postings per strategy."""
    c = _counts(t=postings, u=merged["unique"]).first()     # two numbers
    removed = c["t"] - c["u"]
    per = merged["groups"].groupBy("strategy").agg(F.sum("duplicate_count").alias("matches"),
                                                   F.avg("confidence").alias("avg_conf"))
    pct = F.round(F.col("matches") / F.lit(float(removed)) * 100.0, 4) if removed > 0 else F.lit(0.0)
    return per.select("strategy", F.col("matches").cast("bigint").alias("matches"),
                      F.round(F.col("avg_conf"), 4).alias("avg_confidence"), pct.alias("pct_of_duplicates"))


def _coverage_cols(df: DataFrame) -> list[Column]:
    filled = {
        "salary": F.coalesce(df["salary_present"], F.lit(False)),
        "contactEmail": truthy_str(df["contact_email"]),
        "benefits": F.coalesce(F.size(df["benefits"]) > 0, F.lit(False)),
        "requirements": F.coalesce(F.size(df["requirements"]) > 0, F.lit(False)),
    }
    return [F.avg(F.when(filled[f], 100.0).otherwise(0.0)).alias(f) for f in COVERAGE_FIELDS]


def quality_improvement(merged: dict[str, DataFrame]) -> DataFrame:
    """A10 + A11 + A13: completeness and field coverage before / after, round 1.
    ``improvement_target`` marks fields whose coverage after the merge is below 60."""
    before_df, after_df = merged["before"], merged["after"]
    b = before_df.agg(F.avg(completeness(before_df)).alias("completeness"), *_coverage_cols(before_df))
    a = after_df.agg(F.avg(completeness(after_df)).alias("completeness"), *_coverage_cols(after_df))
    names = ["completeness"] + COVERAGE_FIELDS
    stack = ", ".join(f"'{n}', `{n}`" for n in names)
    tb = b.selectExpr(f"stack({len(names)}, {stack}) AS (metric, before_raw)")
    ta = a.selectExpr(f"stack({len(names)}, {stack}) AS (metric, after_raw)")
    j = tb.join(ta, "metric")
    return j.select("metric", F.bround("before_raw", 1).alias("before"), F.bround("after_raw", 1).alias("after"),
                    F.bround(F.col("after_raw") - F.col("before_raw"), 1).alias("improvement"),
                    ((F.col("metric") != "completeness") & (F.bround("after_raw", 1) < 60)).alias("improvement_target"))


def review_reasons(review: DataFrame) -> DataFrame:
    """Review items per reason (confidence < 75 is "low confidence", else "other")."""
    reason = F.when(F.col("confidence") < LOW_CONFIDENCE, LOW_REASON).otherwise(OTHER_REASON)
    return review.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("items"))
