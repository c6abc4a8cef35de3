"""Text columns. White space is Unicode white space and lengths are code points throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderspark.functions.columns import let

WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Fixed values.
ALLOWED_PUNCTUATION = " \n\t.,;:!?()[]{}\"'-/%$&@#*+=<>|\\_~^`"
MAX_NOISE = 0.35
MIN_QUALITY_CHARS = 10
MIN_PAGE_CHARS = 20
MIN_QUOTE_CHARS = 40
MAX_REASON_CHARS = 500
HEADING_MARKDOWN = r"^#{1,6}\s+\S"
HEADING_LABEL = r"(?i)^(SECTION|PART|VOLUME|ATTACHMENT|APPENDIX|ANNEX)\s+[A-Z0-9]"
HEADING_CLAUSE = r"^([A-Z]{1,3}(\.\d+){0,4}|\d+(\.\d+){0,4})[.)]?\s{1,4}[A-Z][A-Za-z0-9 ,/&()'-]{2,90}$"
REQUIREMENT_TAGS = r"(?i)\s*\[Req\s+\d+(?:\s*,\s*(?:Req\s+)?\d+)*\]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))  # looks at the ends only, which a pattern does not


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE_SPACE))


def normalize_ws(c: Column) -> Column:
    """White space collapsed to single spaces, trimmed, lower case."""
    return F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " ")))


def is_heading(line: Column) -> Column:
    """A line that opens a section: mark-up, a label with a number, a numbered clause title, or short capitals."""

    def opens(t: Column) -> Column:
        capitals = (F.length(t) <= 90) & (F.upper(t) == t) & (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) >= 3)
        return (t != "") & (F.length(t) <= 120) & (t.rlike(HEADING_MARKDOWN) | t.rlike(HEADING_LABEL) | t.rlike(HEADING_CLAUSE) | capitals)

    return F.coalesce(let(strip(line), opens), F.lit(False))


def word_list(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(word_list(c))


def _noise(t: Column) -> Column:
    allowed = "".join("\\" + ch if ch in "\\[]^-&~" else ch for ch in ALLOWED_PUNCTUATION)
    return F.length(F.regexp_replace(t, rf"[\p{{L}}\p{{N}}{allowed}]", ""))


def text_quality_ok(c: Column) -> Column:
    """At least 10 characters, of which at most 0.35 are neither letters, digits nor usual punctuation."""
    t = strip(F.coalesce(c, F.lit("")))
    return (F.length(t) >= MIN_QUALITY_CHARS) & (_noise(t) / F.greatest(F.length(t), F.lit(1)) <= MAX_NOISE)


def choose_page_text(page: Column, ocr: Column) -> Column:
    """OCR text replaces a nearly empty page if it is longer and of good quality."""
    page, ocr = F.coalesce(page, F.lit("")), F.coalesce(ocr, F.lit(""))
    own, other = F.length(strip(page)), F.length(strip(ocr))
    return F.when((own < MIN_PAGE_CHARS) & (other > own) & text_quality_ok(ocr), ocr).otherwise(page)


def guard_input(c: Column, budget: int) -> Column:
    """struct<text, truncated>: a hard cut at the budget."""
    return F.struct(F.substring(c, 1, budget).alias("text"), (F.length(c) > budget).alias("truncated"))


def truncate(c: Column, limit: int) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(rstrip(F.substring(c, 1, limit)), F.lit(" …[truncated]")))


def failure_reason(kind: Column, message: Column) -> Column:
    m = strip(F.coalesce(message, F.lit("")))
    full = F.when(m == "", kind).otherwise(F.concat_ws(": ", kind, m))
    return F.when(F.length(full) <= MAX_REASON_CHARS, full).otherwise(F.concat(F.substring(full, 1, MAX_REASON_CHARS), F.lit("…")))


def quote_grounded(quote: Column, source: Column) -> Column:
    """A quote that is blank or short counts as grounded; a longer one must occur in the normalised source."""
    q = normalize_ws(F.coalesce(quote, F.lit("")))
    return (F.length(q) < MIN_QUOTE_CHARS) | F.coalesce(F.contains(normalize_ws(source), q), F.lit(False))


def quote_grounded_in(quote: Column, normalized_source: Column) -> Column:
    """The same where the source was normalised once for many quotes."""
    q = normalize_ws(F.coalesce(quote, F.lit("")))
    return (F.length(q) < MIN_QUOTE_CHARS) | F.coalesce(F.contains(normalized_source, q), F.lit(False))


def strip_requirement_tags(c: Column) -> Column:
    return F.regexp_replace(c, REQUIREMENT_TAGS, "")


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a pipe table: the first row is the header, short rows are filled."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    clean = lambda c: F.replace(F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    full = F.transform(rows, lambda r: F.concat(F.transform(r, clean), F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    lines = F.transform(full, line)
    rule = line(F.array_repeat(F.lit("---"), width.cast("int")))
    table = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, F.lit("")).otherwise(table)

