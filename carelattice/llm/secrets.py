"""Secret scan: known shapes, and stretches of high entropy, as Spark column expressions only.

The known shapes are regular expressions; places are found by splitting a text at the matches and adding up lengths,
so they count code points.  Candidate strings for the entropy test are the maximal runs of base64 and url-safe
characters of at least a window's length.  A window slides over a candidate; the sum of count * log2(count) over its
characters is kept and only changed by the character that leaves and the one that enters, so is its Shannon entropy.
A window is high if its entropy reaches the limit of its character class.  Touching high windows join to one span.
Long candidates are cut into stretches of STRIDE windows, and spans that touch at a cut are joined, so the cost is in proportion to the text.
An allowed stretch within a candidate takes only the windows over it; an allowed shape takes the whole candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The known shapes, in the order in which spans of one start are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")

WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_=-]{%d,}"
# Character classes of a window, the first that fits counts, with the entropy (bits a character) from which it is high.
# Letters alone are long words, digits alone are numbers and card numbers: no limit makes those secrets.
CLASSES = ((r"^[0-9+/_=-]*$", None), (r"^[A-Za-z+/_=-]*$", None), (r"^[0-9a-f]*$|^[0-9A-F]*$", 3.0), (r"", 3.6))
# Candidate strings that are public by their whole shape: UUIDs, paths of words, the example keys of a provider's manual.
ALLOWED = (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"^[A-Za-z+/_=-]*+[0-9]{0,4}$",
           r"^(?:AKIA[0-9A-Z]{9}EXAMPLE|[A-Za-z0-9+/]{30}EXAMPLEKEY)$")
# Stretches that are public wherever they stand: no window over a part of one is high, the windows beside it are judged.
STRETCH = r"(?i:example|0123456789|abcdefghij)|(.)\1{7,}"
CHUNK = 256
STRIDE = 256  # windows of a candidate that are slid over in one go


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scan(lengths: Column) -> Column:
    """[0, l1, l1+l2, ...]; for short arrays."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def running_starts(lengths: Column) -> Column:
    """The sum of all lengths before each; CHUNK at a time, so the cost hardly grows faster than the array."""
    def cut(lengths: Column) -> Column:
        return F.when(F.size(lengths) == 0, F.array().cast("array<array<int>>")).otherwise(F.transform(
            F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")), lambda i: F.slice(lengths, i * CHUNK + 1, F.lit(CHUNK))))

    def summed(chunks: Column) -> Column:
        bases = _scan(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)))
        return F.flatten(F.zip_with(chunks, bases, lambda c, b: F.transform(
            F.slice(_scan(F.coalesce(c, F.array().cast("array<int>"))), F.lit(1), F.coalesce(F.size(c), F.lit(0))), lambda x: x + b)))

    return _let(_let(lengths, cut), summed)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, hit>> of leftmost, non-overlapping matches, in order; start counts code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(F.transform(F.split(text, pattern, -1), F.length), F.transform(hits, F.length),
                         lambda gap, hit: F.struct(gap.alias("gap"), F.coalesce(hit, F.lit(0)).alias("hit")))
    starts = running_starts(F.transform(lengths, lambda x: x.gap + x.hit))
    found = F.zip_with(F.zip_with(starts, lengths, lambda s, x: s + x.gap), hits, lambda s, h: F.struct(s.alias("start"), h.alias("hit")))
    return F.when(text.rlike(pattern), F.filter(found, lambda x: x.hit.isNotNull())).otherwise(
        F.array().cast("array<struct<start:int,hit:string>>"))


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind) if kind in KINDS else len(KINDS)).alias("rank"),
                    F.lit(kind).alias("kind"), end.cast("int").alias("end"))


def known_spans(text: Column) -> dict[str, Column]:
    """For each known shape its spans in order of start."""
    spans = lambda kind, found: F.transform(found, lambda x: _span(kind, x.start, x.start + F.length(x.hit)))
    return {
        "assign": spans("assign", F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x.hit, ASSIGN, 2)) >= 12)),
        "access": spans("access", matches(text, ACCESS.replace("+", "{14,}"))),  # 18 and more characters of the maximal run
        "hex": spans("hex", matches(text, HEX.replace("+", "{16,}"))),
    }


def _clog(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(0.0)


def _count(text: Column, char: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, char))


def high_windows(text: Column, window: int = WINDOW, stride: int = STRIDE) -> Column:
    """array<struct<start, end>>: the joined high windows of one candidate string, by place in it.

    The candidate is cut into pieces of ``stride``; each is slid over with the next ``window - 1`` characters behind it."""
    def stretches(pieces: Column) -> Column:
        return F.zip_with(pieces, F.slice(pieces, F.lit(2), F.size(pieces)), lambda piece, after: F.concat(piece, F.coalesce(F.left(after, F.lit(window - 1)), F.lit(""))))

    cut = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0)), stretches)
    return _let(F.flatten(F.transform(cut, lambda s, i: F.transform(
        _slide(s, window), lambda w: F.struct((w.start + i * stride).alias("start"), (w.end + i * stride).alias("end"))))), _joined)


def _joined(spans: Column) -> Column:
    """Spans in order, those that touch as one."""
    first = F.filter(spans, lambda s, i: (i == 0) | (s.start > F.get(spans, i - 1).end))
    last = F.filter(spans, lambda s, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1).start > s.end))
    return F.zip_with(first, last, lambda a, b: F.struct(a.start.alias("start"), b.end.alias("end")))


def _slide(text: Column, window: int) -> Column:
    """The joined high windows of a short string (none, if it is shorter than a window)."""
    limit = lambda w: F.coalesce(*(F.when(w.rlike(p), F.lit(float("inf") if h is None else float(h))) for p, h in CLASSES))
    first = F.substring(text, 1, window)
    total = F.aggregate(F.array_distinct(F.split(first, "")), F.lit(0.0), lambda a, c: a + _clog(_count(first, c)))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def join(spans: Column, total: Column, at: Column) -> Column:
        """Adds the window that begins at ``at`` if it is high."""
        high = F.log2(F.lit(float(window))) - total / window >= limit(F.substring(text, at + 1, F.lit(window)))
        last = F.element_at(spans, -1)
        return (F.when(~high, spans)
                .when((F.size(spans) > 0) & (F.try_element_at(spans, F.lit(-1)).end >= at),
                      F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), F.array(F.struct(last.start.alias("start"), (at + window).alias("end")))))
                .otherwise(F.concat(spans, F.array(F.struct(at.alias("start"), (at + window).alias("end"))))))

    def step(state: Column, at: Column) -> Column:
        kept = F.substring(text, at + 1, F.lit(window - 1))
        gone, new = F.substring(text, at, F.lit(1)), F.substring(text, at + window, F.lit(1))
        less, more = _count(kept, gone), _count(kept, new)
        total = state.total - _clog(less + 1) + _clog(less) + _clog(more + 1) - _clog(more)
        return F.struct(total.alias("total"), join(state.spans, total, at).alias("spans"))

    start = F.struct(total.alias("total"), F.when(F.length(text) >= window, join(none, total, F.lit(0))).otherwise(none).alias("spans"))
    steps = F.when(F.length(text) > window, F.sequence(F.lit(1), F.length(text) - window)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda s: s.spans)


def pieces(text: Column, pattern: str) -> Column:
    """array<struct<start, piece>>: what stands between the matches, in order."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(gaps, hits, lambda gap, hit: F.length(gap) + F.coalesce(F.length(hit), F.lit(0)))
    found = F.zip_with(running_starts(lengths), gaps, lambda s, gap: F.struct(s.alias("start"), gap.alias("piece")))
    return F.when(text.rlike(pattern), found).otherwise(F.array(F.struct(F.lit(0).alias("start"), text.alias("piece"))))


def entropy_spans(text: Column, window: int = WINDOW) -> Column:
    """Spans of the joined high windows of all candidates of no allowed shape, beside the allowed stretches in them."""
    allowed = lambda s: F.coalesce(*(F.when(s.rlike(p), F.lit(True)) for p in ALLOWED), F.lit(False))
    strings = F.filter(matches(text, CANDIDATE % window), lambda x: ~allowed(x.hit))
    parts = F.flatten(F.transform(strings, lambda x: F.transform(pieces(x.hit, STRETCH), lambda p: F.struct(
        (x.start + p.start).alias("start"), p.piece.alias("piece")))))
    return F.flatten(F.transform(F.filter(parts, lambda p: F.length(p.piece) >= window), lambda p: F.transform(
        high_windows(p.piece, window), lambda w: _span("entropy", p.start + w.start, p.start + w.end))))


def scan(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` and assign, access, hex, entropy: arrays of struct<start, rank, kind, end>.

    Whole texts; null counts as empty.  An entropy span within a known one is left out.  Empty, short and very long
    texts: all the same rule, at a cost in proportion to the text.  Ties: spans of one start in the order of KINDS, entropy last.
    Empty table: no rows.  Repeated rows: once per row.  Columns that have one of these names are replaced."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = docs.withColumns(known_spans(whole) | {"entropy": entropy_spans(whole, window)})
    known = F.concat("assign", "access", "hex")
    return found.withColumn("entropy", F.filter("entropy", lambda e: ~F.exists(known, lambda k: (k.start <= e.start) & (k.end >= e.end))))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x.kind, x.start, x.end)))


def digest(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts, the hash of the known spans, and all spans, as texts."""
    known = F.concat("assign", "access", "hex")
    return scanned.select(
        F.col(doc_id).cast("long").alias("doc_id"), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_listed(known), 256).alias("base_sha256"), _listed(F.concat(known, "entropy")).alias("spans"))
