"""Similarity functions.

* ``seq_ratio`` (U1): ``difflib.SequenceMatcher(None, a, b).ratio()`` as an
  Arrow-batched pandas UDF, ``seq_ratios_from`` in both orientations behind a bound. They are the
  only Python on the dedup path and run only on candidate pairs that survived the native bounds below.
* ``char_tokens``: a string as its multiset of characters, one token per
  (character, occurrence) -- the exact upper bound of matched characters is the
  overlap of these token sets.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

SLACK = 1e-9


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """SequenceMatcher ratio with the standard-library defaults (autojunk on)."""
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
        else:
            out.append(SequenceMatcher(None, x, y).ratio())
    return pd.Series(out, dtype="float64")


def char_places(s: str) -> dict[str, int]:
    """Where each character of a string stands, as the bits of a whole number."""
    at: dict[str, int] = {}
    for i, ch in enumerate(s):
        at[ch] = at.get(ch, 0) | (1 << i)
    return at


def common_subsequence(a: str, b: str, places: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, bit-parallel: a column of its table is one whole number. ``places``: those of ``b``."""
    at = char_places(b) if places is None else places
    full = (1 << len(b)) - 1
    rest = full
    for ch in a:
        if m := at.get(ch):
            met = rest & m
            rest = ((rest + met) | (rest - met)) & full
    return len(b) - rest.bit_count()


def seq_ratios_from(t: float):
    """U1 in both orientations ``(ab, ba)`` in one Arrow round trip (the ratio is not symmetric), for pairs that may reach ``t``; 0 for those that
    cannot. Matching blocks stand in the same order in both strings, so they are a common subsequence: its length bounds both
    ratios, and is found several times sooner."""
    @F.pandas_udf(StructType([StructField("ab", DoubleType()), StructField("ba", DoubleType())]))
    def ratios(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        ab, ba = [], []
        last, places = None, None   # rows come sorted by the join with the second string
        for x, y in zip(a, b):
            if x is None or y is None:
                one = two = None
            else:
                if y != last:
                    last, places = y, char_places(y)
                if 2.0 * common_subsequence(x, y, places) < (t - SLACK) * (len(x) + len(y)):
                    one = two = 0.0
                else:
                    one, two = SequenceMatcher(None, x, y).ratio(), SequenceMatcher(None, y, x).ratio()
            ab.append(one)
            ba.append(two)
        return pd.DataFrame({"ab": pd.Series(ab, dtype="float64"), "ba": pd.Series(ba, dtype="float64")})
    return ratios


def min_overlap_share(t: float) -> float:
    """For ratio >= t: both lengths and the token overlap must be >= t/(2-t) of a length."""
    return t / (2.0 - t)


def char_tokens(strings: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Tall ``(id, token)`` rows: each character tagged with its occurrence number.

    ``id_col`` should be a small key (a dense integer id), since the occurrence
    numbering shuffles by (id, character)."""
    exploded = strings.select(id_col, F.posexplode(F.split(F.col(text_col), "")).alias("pos", "ch"))
    exploded = exploded.where(F.col("ch") != "")
    w = Window.partitionBy(id_col, "ch").orderBy("pos")  # bounded by one string's length
    return exploded.select(id_col, F.concat(F.col("ch"), F.lit("\u0001"),
                                            F.row_number().over(w).cast("string")).alias("token"))


def prefix_tokens(tokens: DataFrame, lengths: DataFrame, id_col: str, t: float, share: float | None = None) -> DataFrame:
    """Prefix filter: per string, its ``L - ceil(share * L) + 1`` globally rarest tokens
    (``share`` defaults to ``t/(2-t)``), with rank ``rk`` and length ``len``.

    Two strings with ratio >= t share at least one token of their prefixes
    (prefix filtering with a global order; the order is (document frequency, token)).
    With the pair oriented shorter -> longer, the shorter string's prefix may use
    ``share = t`` (its overlap must reach t * len), the longer one keeps ``t/(2-t)``.
    """
    freq = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(freq, "token").join(lengths, id_col)
    w = Window.partitionBy(id_col).orderBy("df", "token")  # bounded by one string's length
    need = F.ceil(F.col("len") * F.lit(min_overlap_share(t) if share is None else share) - F.lit(SLACK))
    return (ranked.withColumn("rk", F.row_number().over(w))
            .where(F.col("rk") <= F.col("len") - need + 1)
            .select(id_col, "token", "rk", "len"))


def shorter_first(len_x: Column, key_x: Column, len_y: Column, key_y: Column) -> Column:
    """Orientation of a pair for the two-prefix join: x is the shorter string
    (equal lengths: the smaller key)."""
    return (len_x < len_y) | ((len_x == len_y) & (key_x < key_y))


def prefix_join_ok(rk_x: Column, len_x: Column, rk_y: Column, len_y: Column, t: float) -> Column:
    """Length and positional filters on one shared prefix token (PPJoin).

    With the token at rank ``rk`` in both global orders, at most ``min(rk_x, rk_y) - 1``
    common tokens precede it and at most ``min(len_x - rk_x, len_y - rk_y)`` follow,
    so the overlap is bounded by their sum plus one; a ratio >= t needs an overlap of
    ``t (len_x + len_y) / 2``.
    """
    share = min_overlap_share(t)
    length_ok = F.least(len_x, len_y) >= F.greatest(len_x, len_y) * F.lit(share) - F.lit(SLACK)
    bound = F.least(rk_x, rk_y) + F.least(len_x - rk_x, len_y - rk_y)
    return length_ok & (bound >= (len_x + len_y) * F.lit(t / 2.0) - F.lit(SLACK))


def bag_bound_ok(tokens_a: Column, tokens_b: Column, len_a: Column, len_b: Column, t: float) -> Column:
    """Length bound and multiset bound: both are upper bounds of the ratio."""
    share = min_overlap_share(t)
    length_ok = F.least(len_a, len_b) >= F.greatest(len_a, len_b) * F.lit(share) - F.lit(SLACK)
    overlap = F.size(F.array_intersect(tokens_a, tokens_b))
    return length_ok & (F.lit(2.0) * overlap / (len_a + len_b) >= F.lit(t - SLACK))


def token_bags(tokens: DataFrame, id_col: str) -> DataFrame:
    """Per string, its token multiset as an array of 64-bit token hashes. A hash
    collision can only make two tokens look equal, which loosens (never breaks) the
    multiset bound."""
    return tokens.groupBy(id_col).agg(F.collect_list(F.xxhash64("token")).alias("bag"))  # one string's characters


#: Characters that a profile counts together; all others are counted together as well.
_COUNTED = [*"abcdefghijklmnopqrstuvwxyz", " ", "01", "23", "456", "789_"]


def char_profile(s: Column) -> Column:
    """How many characters of each class a string has: an array of fixed length."""
    return F.array(*[F.length(s) - F.length(F.translate(s, c, "")) for c in _COUNTED], F.length(F.translate(s, "".join(_COUNTED), "")))


def profile_bound_ok(profile_a: Column, profile_b: Column, len_a: Column, len_b: Column, t: float) -> Column:
    """Length bound and count bound on two profiles. Counting unlike characters together only adds to what two strings
    seem to share, so both are upper bounds of the ratio."""
    share = min_overlap_share(t)
    length_ok = F.least(len_a, len_b) >= F.greatest(len_a, len_b) * F.lit(share) - F.lit(SLACK)
    common = F.lit(0)
    for i in range(len(_COUNTED) + 1):
        common = common + F.least(profile_a[i], profile_b[i])
    return length_ok & (F.lit(2.0) * common / (len_a + len_b) >= F.lit(t - SLACK))


#: Pairs whose longer string has at most so many characters share that many tokens of their prefixes at once (see ``signatures``).
BANDS = ((16, 3), (40, 2))


def gram_parity(s: Column) -> Column:
    """The two-character runs of a string as 64 bits: each turns over the bit of its hash."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(F.substring(s, i, F.lit(2))), F.lit(64)).cast("int"))
    runs = F.when(F.length(s) > 1, F.sequence(F.lit(1), F.length(s) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda bits, i: bits.bitwiseXOR(bit(i)))


def edit_bound_ok(s_a: Column, s_b: Column, grams_a: Column, grams_b: Column, len_a: Column, len_b: Column, t: float) -> Column:
    """Two bounds on the order of the characters. A ratio of ``t`` leaves at most ``k = (1 - t) (la + lb)`` characters outside the matching blocks,
    so that many insertions and deletions make one string the other: each changes at most three two-character runs, and
    the Levenshtein distance is no larger than their number."""
    k = F.floor((len_a + len_b) * F.lit(1.0 - t) + SLACK).cast("int")
    return (F.bit_count(grams_a.bitwiseXOR(grams_b)) <= k * 3) & (F.call_function("levenshtein", s_a, s_b, k) >= 0)


def _combinations(tokens: Column, n: int) -> Column:
    """All ``n``-element combinations (``n`` up to 3) of an array, in order, as arrays."""
    at = lambda i: F.element_at(tokens, i.cast("int"))
    last = F.size(tokens)

    def later(i: Column, left: int, chosen: list[Column]) -> Column:
        if not left:
            return F.array(F.array(*chosen))
        return F.flatten(F.transform(F.sequence(i + 1, last - (left - 1)), lambda j: later(j, left - 1, [*chosen, at(j)])))
    return later(F.lit(0), n, [])


def signatures(tokens: DataFrame, lengths: DataFrame, t: float) -> DataFrame:
    """``(sig, id, len, other)`` and the other columns of ``lengths(id, len, ...)``: join keys of strings for partners of ``other`` characters, a
    pair being similar only if its strings share a key (lengths up to the widest band).

    With ``M = ceil(t (la + lb) / 2)`` tokens in common at least, two strings of ``la`` and ``lb`` characters have at least ``n`` of them
    within their first ``la - M + n`` and ``lb - M + n`` tokens (globally rarest first): behind those, fewer than ``M - n + 1`` are left of either
    string. So they agree in some combination of ``n`` prefix tokens. ``n`` is 3 for short, 2 for longer pairs: several rare tokens
    together are far more selective than one. A key holds both lengths, so each pair of lengths has its own exact ``M``.
    """
    share, widest = min_overlap_share(t), BANDS[-1][0]
    some = lengths.where(F.col("len") <= widest)
    freq = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    carried = [c for c in lengths.columns if c not in ("id", "len")]
    ranked = (tokens.join(some, "id").join(freq, "token").groupBy("id", "len", *carried)   # at most `widest` tokens of a string
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("ranked")))
    ln = F.col("len")
    other = F.sequence(F.ceil(ln * share - SLACK).cast("int"), F.least(F.floor(ln / share + SLACK).cast("int"), F.lit(widest)))
    each = ranked.select("id", "len", *carried, "ranked", F.explode(other).alias("other"))
    need = F.ceil((F.col("len") + F.col("other")) * F.lit(t / 2.0) - SLACK).cast("int")
    each = each.withColumn("need", need).where(F.col("need") <= F.least("len", "other"))
    longer = F.greatest("len", "other")
    n = F.lit(1)
    for most, size in reversed(BANDS):
        n = F.when(longer <= most, size).otherwise(n)
    each = each.withColumn("n", F.least(n, "need"))
    prefix = F.slice("ranked", F.lit(1), F.col("len") - F.col("need") + F.col("n"))
    keys = F.when(F.col("n") == 3, _combinations(prefix, 3)).when(F.col("n") == 2, _combinations(prefix, 2)).otherwise(_combinations(prefix, 1))
    sig = F.transform(keys, lambda c: F.xxhash64(F.least("len", "other"), longer, c))   # an equal hash only adds a candidate
    return each.select(F.explode(sig).alias("sig"), "id", "len", "other", *carried)


def candidate_pairs(strings: DataFrame, t: float) -> DataFrame:
    """Unordered candidate pairs ``(a, b)`` (ids, ``a < b``) of ``strings(id, s)`` that share a signature and pass the edit bounds or, where one is
    longer than the bands, pass the prefix filter and positional bound, and the length and multiset bounds, for threshold ``t``.

    Many strings are made of the same characters, so pairs that share a signature are far more than similar ones: they are tested where they meet, on
    the short strings beside their keys, and only those that pass leave the join. Token bags of long strings are joined to the distinct surviving pairs.
    """
    s = strings.where(F.col("s") != "")
    toks = char_tokens(s, "id", "s")
    lens = s.select("id", F.length("s").alias("len"))
    widest = BANDS[-1][0]
    short = s.select("id", F.length("s").alias("len"), "s", gram_parity(F.col("s")).alias("grams"))
    sigs = signatures(toks, short, t)
    # a signature holds both lengths
    p, q = [sigs.where(side).select("sig", "id", "len", "s", "grams").alias(n) for side, n in (("len <= other", "p"), ("len >= other", "q"))]
    near = edit_bound_ok(F.col("p.s"), F.col("q.s"), F.col("p.grams"), F.col("q.grams"), F.col("p.len"), F.col("q.len"), t)
    met = (p.join(q, (F.col("p.sig") == F.col("q.sig")) & ((F.col("p.len") < F.col("q.len")) | (F.col("p.id") < F.col("q.id"))) & near)
           .select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct())
    # a pair with a string longer than the bands: its shorter one has at least this share of that length
    long_lens = lens.where(F.col("len") >= F.lit(widest * min_overlap_share(t) - SLACK))
    long_toks = toks.join(long_lens.select("id"), "id")
    x = prefix_tokens(long_toks, long_lens, "id", t, share=t).alias("x")
    y = prefix_tokens(long_toks, long_lens, "id", t).where(F.col("len") > widest).alias("y")
    ok = (shorter_first(F.col("x.len"), F.col("x.id"), F.col("y.len"), F.col("y.id"))
          & prefix_join_ok(F.col("x.rk"), F.col("x.len"), F.col("y.rk"), F.col("y.len"), t))
    far = x.join(y, F.col("x.token") == F.col("y.token")).where(ok).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    bags = token_bags(long_toks, "id").join(long_lens, "id")
    far = (far.distinct().join(bags.select(F.col("id").alias("a"), F.col("bag").alias("ta"), F.col("len").alias("la")), "a")
           .join(bags.select(F.col("id").alias("b"), F.col("bag").alias("tb"), F.col("len").alias("lb")), "b")
           .where(bag_bound_ok(F.col("ta"), F.col("tb"), F.col("la"), F.col("lb"), t)))
    return met.unionByName(far.select("a", "b"))   # no pair is in both
