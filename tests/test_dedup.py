"""Entity resolution against the sequential semantics on small fixtures."""

from conftest import SF0001

from hirelake.operators import dedup
from hirelake.operators.simjoin import similar_string_pairs
from hirelake.sources.views import postings_v1, text_postings_v3


def _posting_rows(spark, rows):
    """(seq, url, company, title, city, description, email) -> postings."""
    from hirelake.sources.schema import conform
    return conform(spark.createDataFrame(
        [(s, f"m{s}", f"s{s % 2}", u, co, ti, ci is not None, ci is not None, ci, de, em) for s, u, co, ti, ci, de, em in rows],
        "seq bigint, master_id string, session string, url string, company_name string, title string, location_is_object boolean, "
        "location_present boolean, location_city string, description string, contact_email string"))


def _edges(spark, rows, fuzzy=False):
    out = dedup.detect_duplicates(_posting_rows(spark, rows), fuzzy=fuzzy).orderBy("group_seq", "dup_seq").collect()
    return [(e["group_id"], e["strategy"], e["canonical_id"], e["dup_id"], e["confidence"]) for e in out]


def test_url_groups_take_the_most_complete_then_the_lowest(spark):
    rows = [(1, "u1", "A", "t", None, None, None), (2, "u1", "A", "t", None, "text", "a@x.at"),
            (3, "u1", "A", "t", None, "text", "b@x.at"), (4, None, "B", "v", None, None, None)]
    assert _edges(spark, rows) == [("dup_001", "exact_url", "m2", "m1", 99), ("dup_001", "exact_url", "m2", "m3", 99)]


def test_composite_confidence_follows_the_descriptions(spark):
    rows = [(1, None, "Acme GmbH", "Dev!", "Wien", "one two three four", None), (2, "x", "acme", "dev", "wien", "one two three four", None),
            (3, None, "ACME", "Dev", "Wien", "one two", None), (4, None, "Acme", "Dev", "Wien", None, None)]
    # words in common: 4 of 4, 2 of 4, none (85 + 10 x share); m1 and m2 are equally complete
    assert _edges(spark, rows) == [("dup_001", "normalized_composite", "m1", "m2", 95), ("dup_002", "normalized_composite", "m1", "m3", 90),
                                   ("dup_003", "normalized_composite", "m1", "m4", 85)]


def test_resolution_invariants(spark):
    """On the text fixture: what must hold of any result, whatever its order of work."""
    postings = text_postings_v3(spark, SF0001)
    edges = dedup.detect_duplicates(postings, fuzzy=True)
    rows = edges.collect()
    by_strategy = {}
    for e in rows:
        by_strategy.setdefault(e["strategy"], []).append(e)
    assert by_strategy.get("fuzzy_match")
    for strategy in ("exact_url", "normalized_composite"):   # no posting is a duplicate twice in a stage
        dups = [e["dup_seq"] for e in by_strategy.get(strategy, [])]
        assert len(dups) == len(set(dups))
    assert all(e["confidence"] >= 60 and e["canonical_seq"] != e["dup_seq"] for e in rows)
    merged = dedup.merge_duplicates(postings, edges)
    removed = {e["dup_seq"] for e in rows if e["confidence"] >= 85}
    assert {r["seq"] for r in merged["unique"].select("seq").collect()} == {r["seq"] for r in postings.select("seq").collect()} - removed
    review = merged["review"].orderBy("review_id").collect()
    want = sorted((e["group_seq"], e["confidence"], e["canonical_id"], e["dup_id"]) for e in rows if e["confidence"] < 85)
    assert [(r["group_seq"], r["confidence"], r["canonical_job_id"], r["duplicate_ids"][0]) for r in review] == want
    assert [r["review_id"] for r in review] == [f"review_{i + 1:03d}" for i in range(len(review))]


def test_similar_pairs_lossless(spark):
    from difflib import SequenceMatcher
    words = ["techcorp", "techcorp a", "tech corp", "techcorps", "acme", "acne", "acme labs", "globex",
             "globex inc x", "initech", "initec", "hooli", "hooli xyz", "zz"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    got = {(r["a"], r["b"]) for r in similar_string_pairs(df, 0.8).collect()
           if max(r["r_ab"], r["r_ba"]) >= 0.8}
    want = set()
    for a in words:
        for b in words:
            if a < b and max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= 0.8:
                want.add((a, b))
    assert got == want


def test_plan_has_no_cartesian(spark):
    from hirelake.operators.simjoin import fuzzy_matches
    postings = text_postings_v3(spark, SF0001)
    plan = fuzzy_matches(dedup.prepare(postings))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


RESIDUAL = ("seq bigint, master_id string, session string, completeness double, title_truthy boolean, company_norm string, title_norm string, "
            "location_norm string")


def _residual(spark, rows):
    """(seq, completeness, company, title, location), all normalised."""
    return spark.createDataFrame([(s, f"m{s}", f"s{s % 3}", c, True, co, ti, lo) for s, c, co, ti, lo in rows], RESIDUAL)


def test_fuzzy_pairs_stop_at_the_first_more_complete(spark):
    import random
    from difflib import SequenceMatcher
    from itertools import combinations
    from hirelake.operators.simjoin import fuzzy_matches
    rnd = random.Random(11)
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    companies = ["techcorp", "techcorps", "tech corp", "acme labs", "acme lab", "globex", ""]
    titles = ["senior data analyst", "data analyst", "senior data analyst m", "sales", "sale", ""]
    places = ["wien", "wien ost", "graz", "", "salzburg", "linz"]
    for _ in range(3):
        rows = [(s, rnd.choice([25.0, 37.5, 50.0, 62.5]), rnd.choice(companies), rnd.choice(titles), rnd.choice(places)) for s in range(1, 90)]
        want = {}
        for later in rows:
            for first in rows[:later[0] - 1]:
                if not first[2] or not later[2]:
                    continue
                c, t = ratio(first[2], later[2]), ratio(first[3], later[3])
                place = ratio(first[4], later[4]) if first[4] and later[4] else 0.0
                conf = (c * 0.4 + t * 0.4 + place * 0.2) * 100
                if c >= 0.8 and t >= 0.75 and conf >= 75:
                    want[(first[0], later[0])] = round(conf, 9)
                    if first[1] > later[1]:
                        break
        got = {(r["i"], r["j"]): round(r["conf"], 9) for r in fuzzy_matches(_residual(spark, rows)).collect()}
        assert got == want and len(want) > 100


def test_a_family_of_equal_keys_forms_only_what_it_emits(spark):
    """50,000 postings of one key at four locations, the first the most complete: each stops at the first."""
    from hirelake.operators.simjoin import fuzzy_matches
    rows = spark.range(1, 50_001).selectExpr(
        "id as seq", "concat('m', id) as master_id", "'s' as session", "if(id = 1, 75.0D, 50.0D) as completeness", "true as title_truthy",
        "'acme' as company_norm", "'data analyst' as title_norm", "element_at(array('wien', 'graz', 'linz', ''), cast(id % 4 as int) + 1) as location_norm")
    out = fuzzy_matches(rows).selectExpr("count(*) as n", "max(i) as i", "count(distinct j) as js").first()
    assert (out["n"], out["i"], out["js"]) == (49_999, 1, 49_999)


def test_few_candidates_for_short_strings(spark):
    """The names of the text fixture: candidates before the ratio are a small share of all pairs."""
    from hirelake.functions.similarity import candidate_pairs
    from hirelake.operators.simjoin import string_ids
    from pyspark.sql import functions as F
    names = string_ids(dedup.prepare(text_postings_v3(spark, "/root/testdata/sf0.01")).where("company_norm != ''").select(F.col("company_norm").alias("s")))
    n = names.count()
    assert candidate_pairs(names, 0.8).count() < 0.03 * n * (n - 1) / 2


def test_similar_pairs_lossless_random(spark):
    """Random short strings over a small alphabet (the hard case for prefix filters)."""
    import random
    from difflib import SequenceMatcher
    rnd = random.Random(7)
    words = sorted({"".join(rnd.choice("aabcde ") for _ in range(rnd.randint(1, 14))).strip() or "a"
                    for _ in range(220)})
    df = spark.createDataFrame([(w,) for w in words], "s string")
    for t in (0.8, 0.75):
        got = {(r["a"], r["b"]) for r in similar_string_pairs(df, t).collect() if max(r["r_ab"], r["r_ba"]) >= t}
        want = {(a, b) for i, a in enumerate(words) for b in words[i + 1:]
                if max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= t}
        assert got == want, (t, len(got), len(want))


def _filled(spark, n, edges, own):
    """E-mail of each kept posting after merging ``edges`` = [(group, canonical, duplicate)]."""
    from hirelake.sources.schema import conform
    postings = conform(spark.createDataFrame([(i, f"m{i}", f"s{i}", own.get(i)) for i in range(n)],
                                             "seq bigint, master_id string, session string, contact_email string"))
    frame = spark.createDataFrame(
        [(g, f"dup_{g:03d}", "fuzzy_match", 90, c, f"m{c}", d, f"m{d}", f"s{d}") for g, c, d in edges],
        "group_seq bigint, group_id string, strategy string, confidence int, canonical_seq bigint, canonical_id string, "
        "dup_seq bigint, dup_id string, dup_session string")
    return {r["seq"]: (r["contact_email"], r["contact_email_source"])
            for r in dedup.merge_duplicates(postings, frame)["unique"].collect()}


def test_a_field_reaches_the_head_of_chains(spark):
    for length in (1, 2, 3, 5, 10):
        edges = [(i + 1, i + 1, i) for i in range(length)]   # i merges into i + 1, in order
        assert _filled(spark, length + 1, edges, {0: "a@x.at"}) == {length: ("a@x.at", f"s{length - 1}")}


def test_a_later_merge_does_not_fill_an_earlier_one(spark):
    assert _filled(spark, 3, [(1, 2, 1), (2, 1, 0)], {0: "a@x.at"}) == {2: (None, None)}


def test_the_earliest_filled_group_wins_along_a_chain(spark):
    z, w, y, c, x, p, q = range(7)
    edges = [(1, z, w), (2, y, z), (3, c, y), (5, c, x), (9, p, c), (10, q, p)]
    assert _filled(spark, 7, edges, {w: "w@x.at", x: "x@x.at"})[q][0] == "w@x.at"


def test_company_pairs_made_of_the_same_characters_are_tested_where_they_meet(spark):
    """anagrams share every signature and token; a pair must not be moved (distinct, bags, strings) to be refused."""
    import random
    from difflib import SequenceMatcher
    from itertools import permutations

    from hirelake.functions.similarity import candidate_pairs
    full = sorted("".join(p) for p in permutations("abcdef"))
    df = spark.createDataFrame(list(enumerate(full)), "id bigint, s string")
    got = {(r["a"], r["b"]) for r in candidate_pairs(df, 0.8).collect()}
    assert len(got) < 0.2 * len(full) * (len(full) - 1) / 2    # the multiset bound lets all of them through
    some = random.Random(5).sample(range(len(full)), 60)
    for i in some:
        for j in range(len(full)):
            if i != j and max(SequenceMatcher(None, full[i], full[j]).ratio(), SequenceMatcher(None, full[j], full[i]).ratio()) >= 0.8:
                assert (min(i, j), max(i, j)) in got


def test_ratios_behind_the_subsequence_bound(spark):
    import random
    from difflib import SequenceMatcher

    from hirelake.functions.similarity import common_subsequence, seq_ratios_from
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("abcde é😀") for _ in range(rnd.randint(0, 30))) for _ in range(40)] + ["x" * 250, "xy" * 150, "", "a"]
    texts += [t[:3] + "q" + t[3:] for t in texts[:20]]
    pairs = [(a, b) for a in texts for b in texts]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", seq_ratios_from(0.75)("a", "b").alias("r")).select("a", "b", "r.*").collect()
    for r in got:
        ab, ba = SequenceMatcher(None, r["a"], r["b"]).ratio(), SequenceMatcher(None, r["b"], r["a"]).ratio()
        assert 2 * common_subsequence(r["a"], r["b"]) >= max(ab, ba) * (len(r["a"]) + len(r["b"])) - 1e-9
        if max(ab, ba) >= 0.75:
            assert (r["ab"], r["ba"]) == (ab, ba)
        else:
            assert max(r["ab"], r["ba"]) < 0.75
