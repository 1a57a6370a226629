"""Secret scan (operator 4), native: fixed formats plus two character Markov models.

Base spans come from three formats. The method adds long tokens that read like random strings: two
first-order character Markov models, one of random strings and one of ordinary identifiers, give a
log-likelihood ratio per character, and tokens above a threshold become spans of kind ``markov``.

Labelled samples (bounded by ``max_docs`` and ``max_random``): random strings are the values that the base formats
find in the sampled documents, and base64, base64url, hex and UUID text of SHA-256 sums; ordinary ones are the documents' other
words, as far as they do not look random themselves (bare keys and UUIDs stand among them): a first model, fitted to words of identifier shape
only, says which of the others to drop, and the second one is fitted to the rest.
Half of the samples train, the other half sets the threshold: the ratio that a share of ``false_positives`` of the ordinary tokens
exceeds, and a margin. The tables come to the driver: at most 66 x 66 numbers.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import documents, let, matches, once, span_list, stored

#: Formats of the base spans (fixed values of the contract). Greedy runs of one character class are written possessive or
#: with their least length inside: the same matches, without backtracking on long runs.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""")
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 12

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
_SIZE = len(ALPHABET)
#: Identifier shape: parts of letters (camel case, one case) or of a few digits, between separators.
PLAIN = r"^[+/=_-]*+(?:(?:(?:[A-Z]?[a-z]{2,}+)++|[A-Z]++|[a-z]|[0-9]{1,4}+)(?:[+/=_-]++|$))++$"


def token(least: int) -> str:
    """The format of the tokens that are scored: runs of the alphabet of at least ``least`` characters."""
    return rf"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{{{least},}}+"


def _pairs(token: Column) -> Column:
    """Indices of the character pairs of a token into the 66 x 66 table (from 0)."""
    codes = F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    return let(codes, lambda s: F.filter(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(s) - 2, F.lit(0))),
                    lambda i: F.when((F.get(s, i) >= 0) & (F.get(s, i + 1) >= 0), F.get(s, i) * _SIZE + F.get(s, i + 1))),
        lambda p: p.isNotNull()))


class Markov:
    """Log-likelihood ratios of character pairs (random over ordinary), the threshold per character and the least length
    of a token that it holds for."""

    def __init__(self, table: list[float], threshold: float, least: int = LEAST_VALUE):
        self.table, self.threshold, self.least = table, threshold, least

    def ratio(self, token: Column) -> Column:
        """Mean log-likelihood ratio per character pair; null for a token without one."""
        weights = F.split(F.lit(",".join(map(repr, self.table))), ",").cast("array<double>")  # folded to one constant
        return let(_pairs(token), lambda p: F.when(F.size(p) > 0, F.aggregate(
            p, F.lit(0.0), lambda a, i: a + F.get(weights, i)) / F.size(p)))


def _pair_table(counts: dict[int, int]) -> list[float]:
    """Log-probability of the second character after the first, add-one smoothed."""
    out = []
    for first in range(_SIZE):
        row = [counts.get(first * _SIZE + second, 0) + 1 for second in range(_SIZE)]
        out += [log(n / sum(row)) for n in row]
    return out


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 500,
                     max_random: int = 2_000) -> DataFrame:
    """(token, random 0/1, half 0/1) from about ``max_docs`` documents (by hash of id; whole texts) and generated strings."""
    share = min(1.0, max_docs / max(1, docs.count()))
    draw = F.pmod(F.xxhash64(F.lit("draw"), F.col(id_col)), F.lit(1 << 20)) / (1 << 20)
    some = stored(docs.where(draw < share).select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), "sample").repartition(8)
    values = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
                      F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    found = some.select(F.explode(values).alias("token")).where(F.char_length("token") >= LEAST_VALUE).select("token", F.lit(1).alias("random"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = (some.select(F.explode(F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/=_-]{4,}+"), F.lit(0))).alias("token"))
             .where(F.col("token").rlike("[A-Za-z]")).distinct().select("token", F.lit(0).alias("random")))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = docs.sparkSession.range(max_random).select(
        F.when(F.col("id") % 8 == 0, digest)
        .when(F.col("id") % 8 == 4, F.regexp_replace(F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"))
        .when(F.col("id") % 4 == 1, F.upper(F.substring(digest, 1, 32)))
        .when(F.col("id") % 4 == 2, F.translate(F.substring(F.base64(F.unhex(digest)), 1, 40), "+/", "-_"))
        .otherwise(F.substring(F.base64(F.unhex(digest)), 1, 40)).alias("token"), F.lit(1).alias("random"))
    # identifiers as programs write them: two ordinary words joined, in camel and snake case
    pair = words.groupBy(F.pmod(F.xxhash64("token"), F.lit(max_random)).alias("at")).agg(
        F.min("token").alias("a"), F.max("token").alias("b"))
    joined = pair.select(F.explode(F.array(F.concat_ws("_", F.lower("a"), F.lower("b")), F.concat(F.lower("a"), F.initcap("b"))))
                         .alias("token"), F.lit(0).alias("random"))
    both = found.unionByName(words).unionByName(made).unionByName(joined)
    return both.withColumn("half", F.pmod(F.xxhash64("token"), F.lit(2)).cast("int"))


def _fit(samples: DataFrame, least: int) -> Markov:
    """Both models, from the half that trains."""
    counts = (samples.where("half = 0").select("random", F.explode(_pairs(F.col("token"))).alias("pair"))
              .groupBy("random", "pair").count().collect())  # at most 2 * 66 * 66 rows
    tables = [_pair_table({r["pair"]: r["count"] for r in counts if r["random"] == label}) for label in (0, 1)]
    return Markov([a - b for a, b in zip(tables[1], tables[0])], 0.0, least)


def _low(samples: DataFrame, model: Markov) -> float:
    """The ratio that 95 of 100 random strings of the held half exceed."""
    held = samples.where("half = 1 and random = 1").select(model.ratio(F.col("token")).alias("r"))
    return held.agg(F.percentile_approx("r", 0.05)).first()[0] or 0.0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.1, least: int = LEAST_VALUE,
          false_positives: float = 0.001, **bounds) -> Markov:
    """Trains both models on one half of the samples and sets the threshold on the other.

    ``least``: characters of the shortest token that is scored, as in the base formats. ``false_positives``: the share of ordinary
    tokens of that length that may pass (before the margin). Words that read like random strings are not ordinary.
    """
    samples = stored(labelled_samples(docs, id_col, text_col, **bounds), "markov")
    plain = F.col("token").rlike(PLAIN)
    first = _fit(samples.where((F.col("random") == 1) | plain), least)
    odd = first.ratio(F.col("token")) > max(0.0, 0.5 * _low(samples, first))
    samples = stored(samples.where((F.col("random") == 1) | plain | ~F.coalesce(odd, F.lit(False))), "markov-ordinary")
    model = _fit(samples, least)
    # tokens as long as those that are scanned; short words vary more
    top = (samples.where((F.col("half") == 1) & (F.col("random") == 0) & (F.char_length("token") >= least))
           .agg(F.percentile_approx(model.ratio(F.col("token")), 1 - false_positives, 1_000_000)).first()[0])
    model.threshold = max(0.0, (top if top is not None else 0.0) + margin, 0.5 * _low(samples, model))
    return model


def _span_of(kind: str):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"),
                              F.lit(kind).alias("kind"))


def scan(docs: DataFrame, model: Markov, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_assign``, ``n_access``, ``n_hex``, ``base`` and ``spans`` (arrays of start, rank, end, kind).

    Offsets are code points, end exclusive; an ``assign`` span covers the whole match. A null or empty text has none.
    Markov spans do not overlap base spans. Each row stands for itself, whatever its id. Columns of ``docs`` with
    the name of a result give way to it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    of = F.col("_text")
    assign = F.when(of.rlike(r"[:=]"), F.filter(matches(of, ASSIGN), lambda m: F.char_length(
        F.regexp_extract(m["hit"], ASSIGN, 1)) >= LEAST_VALUE))
    access = F.when(F.contains(of, F.lit("AKIA")), matches(of, ACCESS))
    spans = {k: F.coalesce(F.transform(v, _span_of(k)), F.array())
             for k, v in (("assign", assign), ("access", access), ("hex", matches(of, HEX)))}
    kept = docs.columns
    found = once(docs.select(F.struct(*kept).alias("_in"), text.alias("_text")), **spans, tokens=matches(F.col("_text"), token(model.least)))
    found = once(found.drop("_text"), base=F.concat(*KINDS[:3]), random=F.filter(
        "tokens", lambda m: model.ratio(m["hit"]) > model.threshold))
    more = let(F.struct("base", "random"), lambda s: F.transform(F.filter(
        s["random"], lambda m: ~F.exists(s["base"], lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))),
        _span_of("markov")))
    found = once(found, spans=F.concat("base", more))
    made = [*[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]], F.col("base"), F.col("spans")]
    taken = {"n_assign", "n_access", "n_hex", "base", "spans"}
    return found.select(*[F.col("_in")[c].alias(c) for c in kept if c.lower() not in taken], *made)


def op4(spark, sf_dir: str) -> DataFrame:
    """Query: base counts and digest, and all spans, of every document."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    out = scan(docs, train(docs))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
                      span_list(F.col("spans")).alias("spans"))
