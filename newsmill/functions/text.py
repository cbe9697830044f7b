"""Text functions: Column to Column, all on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named entities in the order in which they are decoded (fixed values); &amp; first, so that &amp;lt; ends as <.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " ")]
#: Opening and closing quotes that a title may be wrapped in (fixed values).
QUOTES = [('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’")]


def replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def strip_cdata(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"</?[^>]*>", "")


def decode_numeric(text: Column) -> Column:
    """Decimal character references in order of appearance, leading zeros included; those beyond Unicode stay as they are."""
    parts = F.split(text, r"(?=&#0*\d{1,7};)")
    code = lambda p: F.regexp_extract(p, r"^&#0*(\d{1,7});", 1)
    value = lambda p: F.try_to_number(code(p), F.lit("9999999")).cast("int")
    char = lambda p: F.decode(F.unhex(F.lpad(F.hex(value(p)), 8, "0")), "UTF-32")
    one = lambda p: F.when(code(p) == "", p).when(value(p) > 1114111, p).otherwise(F.concat(char(p), F.regexp_replace(p, r"^&#0*\d{1,7};", "")))
    return F.when(text.rlike(r"&#0*\d{1,7};"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def decode_entities(text: Column) -> Column:
    return decode_numeric(replace_all(text, ENTITIES))


def collapse_space(text: Column) -> Column:
    """Unicode white space runs to one space, and none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sanitize(text: Column) -> Column:
    """CDATA, then tags, then entities, then white space: escaped markup survives as text. Null gives ''."""
    return collapse_space(decode_entities(strip_tags(strip_cdata(F.coalesce(text, F.lit(""))))))


def contains_html(text: Column) -> Column:
    return F.coalesce(strip_cdata(text).rlike(r"</?[a-zA-Z][^>]*>"), F.lit(False))


def xml_escape(text: Column) -> Column:
    return replace_all(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")])


def normalize_title(title: Column) -> Column:
    """Lower case, one pair of wrapping quotes gone, single spaces, none before punctuation; '' becomes null."""
    trimmed = F.regexp_replace(title, r"(?U)^\s+|\s+$", "")
    wrapped = F.lit(False)
    for a, b in QUOTES:
        wrapped = wrapped | (F.startswith(trimmed, F.lit(a)) & F.endswith(trimmed, F.lit(b)) & (F.char_length(trimmed) >= 2))
    bare = F.when(wrapped, F.trim(F.substring(trimmed, F.lit(2), F.char_length(trimmed) - 2))).otherwise(trimmed)
    out = F.regexp_replace(F.lower(bare), r"(?U)\s+", " ")
    out = F.trim(F.regexp_replace(out, r" +([,.;:!?])", "$1"))
    return F.when(out != "", out)


def tag_content(block: Column, tag: str) -> Column:
    """Content of the first such element, null without one; '' stays ''."""
    pattern = rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"
    return F.when(block.rlike(pattern), F.regexp_extract(block, pattern, 1))


def numbers(text: Column) -> Column:
    """All numeric tokens: digits, groups, and a percent or basis-point unit."""
    return F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)*(?:%|bps)?)"), 1)


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")


def forbidden(text: Column, phrases: list[str]) -> Column:
    """Phrases between word boundaries of ASCII: a letter with an accent ends a word."""
    return text.rlike(r"(?i)(?<![A-Za-z0-9_])(" + "|".join(phrases) + r")(?![A-Za-z0-9_])")
