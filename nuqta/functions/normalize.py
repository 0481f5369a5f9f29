"""Arabic text functions as Columns: built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the query language of the web has it, for use inside a character class;
#: Java's own \s is ASCII.
WS = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
LETTERS = "\\u0621-\\u064A"
MARKS = "\\u064B-\\u065F\\u0670\\u06D6-\\u06DC\\u06DF-\\u06E8\\u06EA-\\u06FC"
# hamza carriers and alef forms to one letter, final ya to ya
FOLD_FROM, FOLD_TO = "إأآٱؤئى", "ااااءءي"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    """Any value as text, null as ''."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def remove_tashkeel(c: Column | str) -> Column:
    """Without vowel marks and recitation signs; wasl alef becomes alef. Null stays null."""
    return F.regexp_replace(F.translate(col(c), "ٱ", "ا"), f"[{MARKS}]", "")


def normalize_arabic(c: Column | str) -> Column:
    """The form in which texts are compared: without marks and tatweel, letter variants
    folded, only letters, hyphens and single white space left. Null and '' give ''.

    Composition (NFC) is not needed: what it could join is removed before it."""
    # tatweel, which has no counterpart, goes; marks are not among what is left
    x = F.translate(text_or_empty(c), FOLD_FROM + "\r\nـ", FOLD_TO + "  ")
    x = F.regexp_replace(x, f"[^{LETTERS}{WS}-]+", "")
    return trim_ws(F.regexp_replace(x, f"[{WS}]{{2,}}", " "))


def clean_field_query(c: Column | str) -> Column:
    """Query cleaning of the single-field search: the whole Arabic block stays."""
    return normalize_arabic(trim_ws(F.regexp_replace(text_or_empty(c), f"[^\\u0600-\\u06FF{WS}]+", "")))


def clean_query(c: Column | str) -> Column:
    """Query cleaning of the combined search: letters only, so wasl alef goes."""
    return normalize_arabic(trim_ws(F.regexp_replace(text_or_empty(c), f"[^{LETTERS}{WS}]", "")))


def strip_word(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"[^{LETTERS}]", "")


def tokenize(c: Column | str) -> Column:
    """Split at white space; a leading blank gives '' first, and '' gives ['']."""
    return F.split(col(c), f"[{WS}]+")


def contains_all_tokens(value: Column | str, query: Column | str) -> Column:
    """Whether the normalized value contains every token of the normalized query; false for
    an empty query."""
    q, v = normalize_arabic(query), normalize_arabic(value)
    return (q != "") & F.forall(tokenize(q), lambda t: F.contains(v, t))
