"""String normalisers and predicates as native Column expressions.

All of these compile to JVM expressions inside whole-stage codegen; none is a
Python UDF. Character classes are spelled out so that Java's regex engine
agrees with a Unicode-aware ``\\w`` / ``\\s``:

* whitespace = ``\\t \\n \\v \\f \\r``, U+001C..U+001F, U+0085 and every ``\\p{Z}``
  code point (this is exactly ``str.isspace``);
* word char = ``\\p{L}``, ``\\p{N}`` and ``_``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------
# Business suffixes removed by the keep-first normaliser:
KEEPFIRST_SUFFIXES = ["gmbh", "ag", "ltd", "inc", "llc", "corp", "corporation"]
# Business suffixes removed by the dedup company normaliser:
DEDUP_COMPANY_SUFFIXES = ["gmbh", "inc", "llc", "ltd", "ag", "corp", "corporation", "company"]
# Diversity markers removed by the keep-first normaliser:
DIVERSITY_MARKERS = ["(m/w/d)", "(w/m/d)"]
# Email, phone and date patterns of the extraction schema:
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_PATTERN = r"\+?\d[\d\s\-\(\)]{7,}"
DATE_PATTERN = r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}"
# ---------------------------------------------------------------------------

WS_CHARS = r"\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}"
WORD_CHARS = r"\p{L}\p{N}_"
WS_RUN = f"[{WS_CHARS}]+"
NON_WORD = f"[^{WORD_CHARS}{WS_CHARS}]"


def _alternation(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def _whole_word(words: list[str]) -> str:
    """Regex matching any of ``words`` between word boundaries (Unicode \\b)."""
    return f"(?<![{WORD_CHARS}]){_alternation(words)}(?![{WORD_CHARS}])"


def trim_ws(c: Column) -> Column:
    """Python ``str.strip()``: removes every Unicode whitespace char at both ends."""
    return F.regexp_replace(c, f"^{WS_RUN}|{WS_RUN}$", "")


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(c, WS_RUN, " ")


def normalize_string(c: Column) -> Column:
    """P8, the keep-first normaliser: punctuation is kept."""
    s = trim_ws(F.lower(F.coalesce(c, F.lit(""))))
    s = F.regexp_replace(s, _whole_word(KEEPFIRST_SUFFIXES), "")
    s = F.regexp_replace(s, "|".join(m.replace("(", r"\(").replace(")", r"\)") for m in DIVERSITY_MARKERS), "")
    return trim_ws(collapse_ws(s))


def normalize_text(c: Column) -> Column:
    """Lower, punctuation to space, collapse whitespace, strip.

    Punctuation and whitespace together are exactly the non-word characters, so
    "punctuation -> space, then whitespace runs -> one space" is one pass that turns
    every run of non-word characters into a single space; only plain spaces can
    then remain at the ends.
    """
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^{WORD_CHARS}]+", " ")
    return F.trim(s)


def normalize_company(c: Column) -> Column:
    """P10: P9, then whole-word suffix removal; inner double spaces stay."""
    s = F.regexp_replace(normalize_text(c), _whole_word(DEDUP_COMPANY_SUFFIXES), "")
    return F.trim(s)   # P9 output holds no whitespace but plain spaces


def first_email(c: Column) -> Column:
    """First address matching the schema's email pattern, NULL when none
    (the regex only runs on texts containing an '@')."""
    m = F.regexp_extract(c, EMAIL_PATTERN, 0)
    return F.when(c.contains("@") & (m != ""), m)


def parse_schema_date(c: Column) -> Column:
    """A value matching the schema's date pattern, as a DATE (ISO first, then day/month/year)."""
    iso = F.regexp_extract(c, r"\d{4}-\d{2}-\d{2}", 0)
    dmy = F.regexp_extract(c, r"\d{1,2}/\d{1,2}/\d{4}", 0)
    return F.coalesce(F.try_to_date(F.when(iso != "", iso), "yyyy-MM-dd"),
                      F.try_to_date(F.when(dmy != "", dmy), "d/M/yyyy"))


def normalize_location(city: Column, country: Column | None = None, is_struct: Column | None = None,
                       scalar: Column | None = None) -> Column:
    """A location object gives P9(city + ' ' + country); a scalar gives P9(scalar)."""
    obj = normalize_text(F.concat(F.coalesce(city, F.lit("")), F.lit(" "),
                                  F.coalesce(country, F.lit("")) if country is not None else F.lit("")))
    if is_struct is None:
        return obj
    return F.when(is_struct, obj).otherwise(normalize_text(scalar))


def fuzzy_key(company: Column, title: Column, location: Column) -> Column:
    """Keep-first key; NULL when all three parts normalise to ''."""
    key = F.concat_ws("|", normalize_string(company), normalize_string(title), normalize_string(location))
    return F.when(key != F.lit("||"), key)


def composite_key(company_norm: Column, title_norm: Column, location_norm: Column) -> Column:
    """Only when company and title are non-empty."""
    return F.when((company_norm != "") & (title_norm != ""),
                  F.concat_ws("|", company_norm, title_norm, location_norm))


def word_set(normalized: Column) -> Column:
    """Distinct words of an already P9-normalised string (empty string -> [])."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda w: w != ""))


def text_words(c: Column) -> Column:
    """``word_set(normalize_text(c))`` of a long text in one pass: it is split at the runs that P9 turns into spaces."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), f"[^{WORD_CHARS}]+")), "")


def jaccard(words_a: Column, words_b: Column) -> Column:
    """|A∩B| / |A∪B|; 0.0 when either side is empty."""
    inter = F.size(F.array_intersect(words_a, words_b))
    union = F.size(words_a) + F.size(words_b) - inter
    return F.when((F.size(words_a) == 0) | (F.size(words_b) == 0), F.lit(0.0)) \
        .otherwise(inter.cast("double") / union.cast("double"))


def truthy_str(c: Column) -> Column:
    """M17 for strings: not null and not ''."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def truthy_num(c: Column) -> Column:
    """M17 for numbers: not null and not 0."""
    return F.coalesce(c != 0, F.lit(False))


def nullif_empty(c: Column) -> Column:
    return F.when(truthy_str(c), c)
