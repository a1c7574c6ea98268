"""Label and text expressions.  All are plain Catalyst columns: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# White space as ECMAScript understands it (wider than Java's \s).
JS_SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
ACRONYMS = (("Egfr", "eGFR"), ("Hba1c", "HbA1c"), ("Ldl", "LDL"), ("Tsh", "TSH"),
            ("Inr", "INR"), ("Ckd", "CKD"), ("Copd", "COPD"))
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are",
    "was", "were", "be", "been", "has", "have", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "this", "that", "these", "those", "it", "its")
# --- end of fixed values ----------------------------------------------------

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def is_blank(c: Column) -> Column:
    # looks for one other character: trimming runs over the whole text at every space
    return F.coalesce(~c.rlike(f"[^{JS_SPACE}]"), F.lit(True))


def collapse_space(c: Column) -> Column:
    return js_trim(F.regexp_replace(c, f"[{JS_SPACE}]+", " "))


def title_case(c: Column) -> Column:
    """Lower-case, then capitalise after every ASCII word boundary (``a-fib`` -> ``A-Fib``)."""
    pieces = F.split(F.lower(collapse_space(c)), r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.translate(F.substring(p, 1, 1), _LOWER, _UPPER),
                                               p.substr(F.lit(2), F.length(p)))), "")


def fix_acronyms(c: Column) -> Column:
    for word, acronym in ACRONYMS:
        c = F.regexp_replace(c, rf"\b{word}\b", acronym)
    return c


def search_tokens(c: Column) -> Column:
    """Tokens of the lexical index: duplicates kept, stop words and one-letter tokens dropped."""
    return F.filter(F.split(F.lower(c), "[^A-Za-z0-9_.%/-]+"),
                    lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def word_tokens(c: Column) -> Column:
    """Tokens compared by Jaccard: ASCII alphanumerics, longer than one character."""
    cleaned = F.regexp_replace(F.lower(c), f"[^a-z0-9{JS_SPACE}]", " ")
    return F.filter(F.split(cleaned, f"[{JS_SPACE}]+"), lambda t: F.length(t) > 1)


def let(x: Column, body) -> Column:
    """Evaluate ``x`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def bigrams(c: Column) -> Column:
    def grams(clean: Column) -> Column:
        n = F.length(clean)
        return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: clean.substr(i, F.lit(2)))) \
                .otherwise(F.array().cast("array<string>"))

    return let(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), grams)


def multiset(grams: Column) -> Column:
    """Tag repeats (``ab#1``, ``ab#2``) so that multiset overlap becomes set overlap."""
    return let(grams, lambda all_: F.transform(all_, lambda g, i: F.concat(
        g, F.lit("#"), F.size(F.filter(F.slice(all_, 1, i + 1), lambda h: h == g)).cast("string"))))


def jaccard(a: Column, b: Column) -> Column:
    ta, tb = F.array_distinct(word_tokens(a)), F.array_distinct(word_tokens(b))
    inter = F.size(F.array_intersect(ta, tb))
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0)) \
            .otherwise(inter / (F.size(ta) + F.size(tb) - inter))


def dice(a: Column, b: Column) -> Column:
    ga, gb = bigrams(a), bigrams(b)
    overlap = F.size(F.array_intersect(multiset(ga), multiset(gb)))
    return F.when((F.size(ga) == 0) | (F.size(gb) == 0), (a == b).cast("double")) \
            .otherwise(2.0 * overlap / (F.size(ga) + F.size(gb)))


def similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(jaccard(a, b), dice(a, b)))


def js_round(x: Column, digits: int = 2) -> Column:
    """Half-up toward +infinity, as ECMAScript rounds; Spark's ``round`` differs on negatives."""
    scale = float(10 ** digits)
    return F.floor(x * scale + 0.5) / scale


def stable_id(prefix: str, c: Column) -> Column:
    """31-multiplier hash over UTF-16 code units, modulo 2^32, base 36.  32 bits collide
    at scale, so it is a display id only; joins use the natural keys."""
    units = F.hex(F.encode(c, "UTF-16BE"))
    count = (F.length(units) / 4).cast("int")
    codes = F.when(count > 0, F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.conv(units.substr(i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    ).otherwise(F.array().cast("array<bigint>"))
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, u: (acc * 31 + u) % F.lit(4294967296))
    return F.concat(F.lit(prefix + "_"), F.lower(F.conv(h.cast("string"), 10, 36)))


def js_number(x: Column) -> Column:
    """Text of a double the way ECMAScript prints it: no trailing ``.0``, no exponent for ordinary sizes."""
    x = x.cast("double")
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,12)").cast("string"), "0+$", ""), "[.]$", "")
    return (F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string"))
            .when((F.abs(x) >= 1e-3) & (F.abs(x) < 1e7), x.cast("string"))
            .otherwise(plain))


def describe_list(first_items: Column, total: Column, shown: int = 4) -> Column:
    """``a, b, c, d, and n more`` from the first items and the total count."""
    extra = total - F.least(total, F.lit(shown))
    return F.concat(F.array_join(F.slice(first_items, 1, shown), ", "),
                    F.when(extra > 0, F.concat(F.lit(", and "), extra.cast("string"), F.lit(" more"))).otherwise(""))


def strip_code_fence(raw: Column) -> Column:
    """Payload of an optional Markdown code fence, trimmed."""
    trimmed = js_trim(raw)
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    return F.when(trimmed.rlike(fence), js_trim(F.regexp_extract(trimmed, fence, 1))).otherwise(trimmed)


def distinct_strings(values: Column) -> Column:
    """Trimmed, case-insensitive distinct, first spelling kept."""
    trimmed = F.filter(F.transform(values, js_trim), lambda v: v != "")
    return F.filter(trimmed, lambda v, i: ~F.exists(F.slice(trimmed, 1, i), lambda u: F.lower(u) == F.lower(v)))


def distinct_exact(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda v: F.coalesce(v != "", F.lit(False))))
