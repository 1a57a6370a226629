"""Personal data (operator 1), native: candidate spans scored by gradient-boosted trees.

1. **Base spans** come from the four fixed formats with their checks and always stay.
2. **Generators** of high recall propose overlapping candidates of each kind beyond them: e-mail addresses with "at" and "dot" in or without brackets, IPv6 addresses
   (full or compressed) and bracketed IPv4, card numbers with other separators, phone numbers without a plus (one run of digits, two or three groups, pairs).
3. **Boosted trees** (MLlib ``GBTClassifier``) score candidates by format (digits, groups, separators, letters, colons, lengths, neighbours)
   and context (cue words on either side). No table labels personal data, so labels come by *perturbation*: base matches of the corpus, and made-up
   ones so that no kind is without, are rewritten into the other forms and set into neutral surroundings of the corpus. What is clear by its form is
   positive with or without a cue word; digits that could be anything (phones without a plus, cards) are positive beside a cue word and negative
   without one; look-alikes (hexadecimal words around "::", prose with "at" and "dot", cards whose digits fail) are negative. The feature that decides a base
   check is out of sight for its kind (octet range for ip, number of digits for phone).
4. **Calibrated thresholds**: on the half of the sample that trained nothing, the lowest score per kind above which at
   least ``precision`` of the examples are positive (never below 0.5).

Selected candidates that overlap no base span become spans of their kind; of overlapping ones the earliest and longest. The sample of base matches is
bounded (``max_rows``, chosen by hash), the rest covers all rows. Candidates are stored once, without the texts.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import documents, let, matches, once, span_list, stored

KINDS = ("email", "ip", "card", "phone")

#: The base formats (fixed values of the contract), written so that Java's matcher needs no backtracking on long runs: possessive
#: repeats where the next character is outside the class, and a start that cannot lie inside a run (but may follow a match).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must be in a text for a format to match at all.
NEEDS = {"email": "@", "phone": "+"}
_OPEN, _CLOSE = r"\x20?[(\[{]\x20?", r"\x20?[)\]}]\x20?"
#: Candidates beyond the base formats, and what must be in a text for them.
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{_OPEN}(?i:at){_CLOSE}[A-Za-z0-9-]++(?:(?:\.|{_OPEN}(?i:dot){_CLOSE}|\x20(?i:dot)\x20)[A-Za-z0-9-]++)++"
             r"|\x20(?i:at)\x20[A-Za-z0-9-]++(?:\x20(?i:dot)\x20[A-Za-z0-9-]++)++)",
    # up to eight groups, or fewer around one "::"
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?"
          r"|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}|[0-9]{1,3}+(?:(?:\[\.\]|\(\.\))[0-9]{1,3}+){3}+)(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}+(?:[./_][0-9]{4}+){2,3}+(?:[./_][0-9]{1,3}+)?+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.,:/_-])(?:00[1-9][0-9]{0,2}+[\x20.-])?+(?:\(?+[0-9]{2,4}+\)?+[\x20.-][0-9]{3,4}+[\x20.-][0-9]{3,4}+|0[0-9](?:[\x20.-][0-9]{2}){4}"
             r"|0[0-9]{2,4}+[\x20/-][0-9]{5,8}+|[0-9]{10,11}+)(?![0-9A-Za-z]|[.,:/_-][0-9])",
}
WIDE_NEEDS = {"email": r"(?i)[(\[{] ?at ?[)\]}]| dot ", "ip": r"::|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:|\[\.\]|\(\.\)", "card": "[0-9]{4}[./_][0-9]{4}", "phone": "[0-9]{2}"}
#: Words that tell of a kind (our choice), on either side of a candidate.
CUES = {
    "email": ["mail", "email", "contact", "write", "reach"], "ip": ["ip", "address", "host", "server", "login", "gateway"],
    "card": ["card", "visa", "mastercard", "amex", "credit", "debit", "payment", "cvv"],
    "phone": ["phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "dial", "contact"],
}
FEATURES = ("kind", "n_chars", "n_digits", "digit_share", "n_groups", "longest_group", "shortest_group", "n_separators", "distinct_digits",
            "luhn", "in_octet_range", "first_digit", "cue", "letter_before", "letter_after", "digit_before", "digit_after", "sentence_end",
            "n_letters", "n_colons", "brackets", "last_length")
#: Features that decide a kind's base check.
HIDDEN = {"ip": {"in_octet_range"}, "phone": {"n_digits"}}
_CONTEXT = 32


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def total(chars: Column) -> Column:
        twice = F.transform(F.reverse(chars), lambda c, i: F.when(
            i % 2 == 1, let(c.cast("int") * 2, lambda d: d - F.when(d > 9, 9).otherwise(0))).otherwise(c.cast("int")))
        return F.aggregate(twice, F.lit(0), lambda a, x: a + x)
    return let(F.filter(F.split(digits, ""), lambda c: c != ""), lambda s: (F.size(s) > 0) & (total(s) % 10 == 0))


def _passes(kind: str, hit: Column) -> Column:
    """The check of a base format."""
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda d: (F.char_length(d) <= 3) & (
            F.coalesce(F.when(d == "", F.lit(0)).otherwise(d.try_cast("int")), F.lit(999)) <= 255)))
    n = F.char_length(_digits(hit))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn_ok(_digits(hit))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _feature_struct(kind: str, m: Column) -> Column:
    """Format and context features of one match, all doubles."""
    def of(s: Column) -> Column:
        groups, digits, hit = s["groups"], s["digits"], s["hit"]
        sizes = F.transform(groups, lambda g: F.char_length(g))
        n = F.char_length(digits)
        last, first = F.right(s["before"], F.lit(1)), F.left(s["after"], F.lit(1))
        flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
        values = {
            "kind": F.lit(float(KINDS.index(kind))),
            "n_chars": F.char_length(hit).cast("double"), "n_digits": n.cast("double"),
            "digit_share": n / F.greatest(F.char_length(hit), F.lit(1)),
            "n_groups": F.size(groups).cast("double"),
            "longest_group": F.coalesce(F.array_max(sizes), F.lit(0)).cast("double"),
            "shortest_group": F.coalesce(F.array_min(sizes), F.lit(0)).cast("double"),
            "n_separators": (F.char_length(hit) - F.char_length(F.regexp_replace(hit, "[^A-Za-z0-9]", ""))).cast("double"),
            "distinct_digits": F.size(F.array_distinct(F.filter(F.split(digits, ""), lambda c: c != ""))).cast("double"),
            "luhn": flag(F.when(n <= 32, luhn_ok(digits))),
            "in_octet_range": flag(F.forall(groups, lambda g: (F.char_length(g) <= 3) & F.coalesce(g.try_cast("int") <= 255, F.lit(False)))),
            "first_digit": F.coalesce(F.left(digits, F.lit(1)).try_cast("double"), F.lit(-1.0)),
            "cue": flag(F.lower(F.concat(s["before"], F.lit(" | "), s["after"])).rlike(rf"(?<![\p{{L}}])(?:{'|'.join(CUES[kind])})(?![\p{{L}}])")),
            "letter_before": flag(last.rlike(r"\p{L}")), "letter_after": flag(first.rlike(r"\p{L}")),
            "digit_before": flag(F.right(s["before"], F.lit(2)).rlike("[0-9][.-]?$")),
            "digit_after": flag(F.left(s["after"], F.lit(2)).rlike("^[.-]?[0-9]")),
            "sentence_end": flag(first.rlike(r"[.!?\n]")),
            "n_letters": F.char_length(F.regexp_replace(hit, "[^A-Za-z]", "")).cast("double"),
            "n_colons": F.char_length(F.regexp_replace(hit, "[^:]", "")).cast("double"),
            "brackets": flag(hit.rlike(r"[(\[{]")),
            "last_length": F.char_length(F.regexp_extract(hit, "([A-Za-z0-9-]*)$", 1)).cast("double"),
        }
        return F.struct(*[(F.lit(0.0) if f in HIDDEN.get(kind, ()) else values[f]).alias(f) for f in FEATURES])

    hit = m["hit"]
    return let(F.struct(hit.alias("hit"), F.filter(F.split(hit, "[^0-9]+"), lambda g: g != "").alias("groups"), _digits(hit).alias("digits"),
                        m["before"].alias("before"), m["after"].alias("after")), of)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``' other columns with ``found``: per match ``kind, start, end, rank, base`` (a base format),
    ``ok`` (its check passed; null for a wide candidate), ``features`` (null for a base match) and ``seen`` (match and surroundings of a base match)."""
    text = F.col("_text")
    columns = {}
    for kind in KINDS:
        hits = matches(text, BASE[kind], _CONTEXT)
        if kind in NEEDS:
            hits = F.when(F.contains(text, F.lit(NEEDS[kind])), hits)
        columns[f"base_{kind}"] = F.coalesce(F.transform(hits, _match(kind, True)), F.array())
        wide = F.when(text.rlike(WIDE_NEEDS[kind]), matches(text, WIDE[kind], _CONTEXT))
        columns[f"wide_{kind}"] = F.coalesce(F.transform(wide, _match(kind, False)), F.array())
    kept = [c for c in docs.columns if c != text_col]
    out = once(docs.select(F.struct(F.lit(0).alias("_none"), *kept).alias("_in"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), **columns)
    return out.select(*[F.col("_in")[c].alias(c) for c in kept], F.concat(*columns).alias("found"))


def _match(kind: str, base: bool):
    features = "struct<" + ",".join(f"{f}:double" for f in FEATURES) + ">"
    seen = "struct<hit:string,before:string,after:string>"
    return lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(base).alias("base"),
        (_passes(kind, m["hit"]) if base else F.lit(None).cast("boolean")).alias("ok"),
        (F.lit(None).cast(features) if base else _feature_struct(kind, m)).alias("features"),
        (F.struct(m["hit"].alias("hit"), m["before"].alias("before"), m["after"].alias("after")) if base else F.lit(None).cast(seen)).alias("seen"))


class Selector:
    """Trees and thresholds; ``model`` is None where the sample has not both labels, and selects nothing."""

    def __init__(self, model=None, thresholds: dict[str, float] | None = None):
        self.model, self.thresholds = model, thresholds or {}

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the feature columns, plus ``score``."""
        out = self.model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="_v").transform(rows))
        return out.withColumn("score", vector_to_array("probability")[1]).drop("_v", "rawPrediction", "probability", "prediction")


def _digit_string(seed: Column, n: int) -> Column:
    """``n`` digits drawn by a hash."""
    return F.substring(F.regexp_replace(F.sha2(F.concat(seed.cast("string"), F.lit("|digits")).cast("binary"), 512), "[^0-9]", ""), 1, n)


def _luhn_number(digits: Column) -> Column:
    """Digits with a last one that makes them pass the Luhn check."""
    ends = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(digits, d.cast("string")))
    return F.element_at(F.filter(ends, luhn_ok), 1)


def _examples(found: DataFrame, max_rows: int, made_up: int) -> DataFrame:
    """``(name, hit, before, after, label)``: rewritten matches in neutral surroundings, see the module's text."""
    spark = found.sparkSession
    real = found.where("base and ok").select("kind", "seen.*", F.xxhash64("row", "start", "rank").alias("h"))
    n = real.count()
    real = real.where(F.pmod(F.xxhash64(F.lit("draw"), "h"), F.lit(1 << 20)) < F.lit(int(min(1.0, max_rows / max(1, n)) * (1 << 20))))
    seed = spark.range(made_up).select(F.xxhash64(F.lit("seed"), "id").alias("h"))
    octet = lambda i: F.pmod(F.xxhash64(F.lit(i), "h"), F.lit(256)).cast("string")
    word = lambda i: F.translate(F.substring(F.sha2(F.concat(F.lit(str(i)), F.col("h").cast("string")).cast("binary"), 256), 1, 4 + i % 3),
                                 "0123456789", "ghijklmnop")
    fresh = {"email": F.concat(word(1), F.lit("."), word(2), F.lit("@"), word(3), F.lit(".com")), "ip": F.concat_ws(".", *[octet(i) for i in range(4)]),
             "card": _luhn_number(F.concat(F.lit("4"), _digit_string(F.col("h"), 14))), "phone": F.concat(F.lit("+1"), _digit_string(F.col("h"), 10))}
    blank = [F.lit("").alias("before"), F.lit(" ").alias("after")]
    for kind, hit in fresh.items():
        real = real.unionByName(seed.select(F.lit(kind).alias("kind"), hit.alias("hit"), *blank, "h"))
    real = stored(real, "pii-real").coalesce(4)
    digits = _digits(F.col("hit"))
    user, host = F.split_part("hit", F.lit("@"), F.lit(1)), F.split_part("hit", F.lit("@"), F.lit(2))
    parts = F.split("hit", r"\.")
    hexed = lambda i: F.lower(F.hex(F.get(parts, F.lit(i)).cast("bigint")))
    groups = lambda text, sizes, sep: F.concat_ws(sep, *[F.substring(text, 1 + sum(sizes[:k]), n) for k, n in enumerate(sizes)])
    ten = F.rpad(F.substring(F.concat(F.substring(digits, 2, 20), _digit_string(F.col("h"), 10)), 1, 10), 10, "5")
    wrong = F.concat(F.substring(digits, 1, 15), F.pmod(F.substring(digits, 16, 1).cast("int") + 3, F.lit(10)).cast("string"))
    ending = F.element_at(F.array(*[F.lit(x) for x in ("com", "org", "net", "de", "info")]), (F.pmod(F.xxhash64(F.lit("ending"), "h"), F.lit(5)) + 1).cast("int"))
    # one to four hexadecimal letters
    letters = lambda k: F.translate(F.substring(F.sha2(F.concat("hit", F.lit(str(k))).cast("binary"), 256), F.lit(1),
                                                (F.pmod(F.xxhash64(F.lit(k), "hit"), F.lit(4)) + 1).cast("int")), "0123456789", "abcdefabcd")
    forms = {  # (form, positive with a cue, positive without)
        "email": [(F.concat(user, F.lit(" (at) "), F.replace(host, F.lit("."), F.lit(" (dot) "))), 1, 1), (F.concat(user, F.lit("[at]"), host), 1, 1),
                  (F.concat(user, F.lit(" at "), F.replace(host, F.lit("."), F.lit(" dot "))), 1, 1), (F.concat(word(4), F.lit(" at "), word(5), F.lit(" dot "), ending), 1, 1),
                  (F.concat(word(8), F.lit(" (at) "), word(9), F.lit(" dot "), ending), 1, 1), (F.concat(word(6), F.lit(" at "), word(7), F.lit(" dot "), word(4), word(5)), 0, 0)],
        "ip": [(F.concat(F.lit("2001:db8:"), *[F.concat(hexed(k % 4), F.lit(":")) for k in range(5)], hexed(3)), 1, 1), (F.concat(F.lit("fe80::"), hexed(0), F.lit(":"), hexed(1)), 1, 1),
               (F.concat(F.lit("2001:db8::"), hexed(2)), 1, 1), (F.concat(F.lit("fe80::"), F.substring(hexed(3), 1, 1)), 1, 1), (F.replace("hit", F.lit("."), F.lit("[.]")), 1, 1),
               (F.concat_ws(":", *[F.substring(F.sha2(F.col("hit").cast("binary"), 256), 1 + 4 * k, 4) for k in range(8)]), 1, 1),
               *[(F.concat(letters(k), F.lit("::"), letters(k + 1)), 0, 0) for k in (0, 2, 4)], (F.concat_ws("::", letters(6), letters(7), letters(8)), 0, 0)],
        "card": [(groups(digits, [4, 4, 4, 4], sep), 1, 0) for sep in (".", "/", "_")] + [(groups(wrong, [4, 4, 4, 4], "."), 0, 0)],
        "phone": [(ten, 1, 0), (groups(ten, [3, 3, 4], " "), 1, 0), (groups(ten, [3, 3, 4], "-"), 1, 0), (groups(F.concat(F.lit("0"), ten), [4, 7], " "), 1, 0),
                  (groups(F.concat(F.lit("0"), ten), [2, 2, 2, 2, 2], " "), 1, 0)],
    }
    out = None
    for kind, some in forms.items():
        cue = F.element_at(F.array(*[F.lit(c) for c in CUES[kind]]), (F.pmod(F.xxhash64(F.lit("cue"), "h"), F.lit(len(CUES[kind]))) + 1).cast("int"))
        variants = []
        for form, with_cue, without in some:
            variants += [F.struct(form.alias("hit"), F.concat("before", cue, F.lit(" ")).alias("before"), F.col("after").alias("after"), F.lit(float(with_cue)).alias("label")),
                         F.struct(form.alias("hit"), F.col("before").alias("before"), F.concat(F.lit(" "), cue, F.col("after")).alias("after"), F.lit(float(with_cue)).alias("label")),
                         F.struct(form.alias("hit"), F.col("before").alias("before"), F.col("after").alias("after"), F.lit(float(without)).alias("label"))]
        rows = real.where(F.col("kind") == kind)
        if kind == "card":
            rows = rows.where(F.char_length(digits) == 16)
        part = rows.select(F.lit(kind).alias("name"), "h", F.explode(F.array(*variants)).alias("v")).select("name", "h", "v.*")
        out = part if out is None else out.unionByName(part)
    return out


def train(found: DataFrame, max_rows: int = 2_000, made_up: int = 150, trees: int = 12, depth: int = 4, precision: float = 0.95) -> Selector:
    """Fits on rewritten forms of at most about ``max_rows`` base matches (``found``: exploded candidates with ``row``) and ``made_up`` more of each kind."""
    examples = _examples(found, max_rows, made_up)
    labelled = None
    for kind in KINDS:
        m = F.struct("hit", "before", "after")
        part = examples.where(F.col("name") == kind).select("name", "h", "label", _feature_struct(kind, m).alias("f"))
        labelled = part if labelled is None else labelled.unionByName(part)
    sample = stored(labelled.select(F.col("name").alias("kind_name"), "label", F.pmod(F.xxhash64(F.lit("half"), "h"), F.lit(2)).alias("_half"), "f.*"),
                    "pii-sample").coalesce(4)
    learn = sample.where("_half = 0")
    gbt = GBTClassifier(featuresCol="_v", labelCol="label", maxIter=trees, maxDepth=depth, seed=7, maxBins=32, cacheNodeIds=False)
    model = gbt.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="_v").transform(learn))
    out = Selector(model)
    # calibration on the other half: counts by kind and hundredth of score, at most 4 x 101 rows
    bins = (out.score(sample.where("_half = 1")).groupBy("kind_name", F.floor(F.col("score") * 100).cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).collect())
    for kind in KINDS:
        n = good = 0.0
        best = 1.0
        for r in sorted((r for r in bins if r["kind_name"] == kind), key=lambda r: -r["bin"]):
            n, good = n + r["n"], good + r["good"]
            if good / n >= precision:
                best = r["bin"] / 100
        out.thresholds[kind] = max(0.5, best)
    return out


def scan(docs: DataFrame, text_col: str = "text", selector: Selector | None = None, **training) -> DataFrame:
    """Every row of ``docs`` without its text, with ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans), ``base`` and ``spans``
    (arrays of start, rank, end, kind; code points, end exclusive). A null or empty text has none. Rows stand for themselves: repeated
    ids and rows each get their result. Columns of ``docs`` with the name of a result give way to it.
    """
    taken = {"base", "spans", "row", "found", *(f"n_{k}" for k in KINDS)}
    kept = [c for c in docs.columns if c.lower() not in taken and c != text_col]
    rows = stored(candidates(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(F.lit(0).alias("_none"), *kept).alias("kept"),
                                         F.col(text_col).alias("text"))), "pii")
    found = rows.where(F.size("found") > 0).select("row", F.inline("found"))
    selector = selector or train(found, **training)
    base = F.transform(F.filter("found", lambda m: m["base"] & m["ok"]),
                       lambda m: F.struct(*[m[c].alias(c) for c in ("start", "rank", "end", "kind")]))
    out = rows.select("row", "kept", base.alias("base"))
    if selector.model is not None:
        wide = selector.score(found.where("not base").select("row", "start", "rank", "end", F.col("kind").alias("name"), "features.*"))
        limit = F.lit(2.0)
        for kind, least in selector.thresholds.items():
            limit = F.when(F.col("name") == kind, least).otherwise(limit)
        picked = wide.where(F.col("score") >= limit).groupBy("row").agg(
            F.collect_set(F.struct("start", "rank", "end", F.col("name").alias("kind"))).alias("picked"))
        out = out.join(picked, "row", "left")
    else:
        out = out.withColumn("picked", F.lit(None).cast("array<struct<start:int,rank:int,end:int,kind:string>>"))
    clear = let(F.struct("base", F.coalesce("picked", F.array()).alias("picked")), lambda s: F.filter(
        s["picked"], lambda p: ~F.exists(s["base"], lambda b: (b["start"] < p["end"]) & (p["start"] < b["end"]))))
    # of overlapping ones the earliest, then the longest
    first = F.transform(F.array_sort(F.transform(clear, lambda p: F.struct(p["start"].alias("at"), (-p["end"]).alias("neg"), p.alias("p")))), lambda x: x["p"])
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>").alias("kept"))
    free = F.aggregate(first, start, lambda acc, p: F.when(p["start"] < acc["end"], acc).otherwise(
        F.struct(p["end"].alias("end"), F.concat(acc["kept"], F.array(p)).alias("kept"))))["kept"]
    out = out.withColumn("spans", F.concat("base", free))
    number = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return out.select(*[F.col("kept")[c].alias(c) for c in kept], *[number(k) for k in KINDS], "base", "spans")


def op1(spark, sf_dir: str) -> DataFrame:
    """Query: base counts and digest, and all spans, of every document."""
    out = scan(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
                      span_list(F.col("spans")).alias("spans"))
