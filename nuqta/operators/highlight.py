"""Highlight ranges: where the words of a display text match matched tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import WS, normalize_arabic, text_or_empty
from ..schemas import FUZZY, NONE, PARTS, RANGES
from .corpus import PIECE, with_offsets

#: Letters of a normalized token and what they stand for in a text.
VARIANTS = {"ا": "اأإآٱٰو", "ي": "يىیئ", "ى": "ىيیئ", "ة": "ةهت", "ه": "هة", "ك": "كڬڭڮگڰ", "ء": "ءؤئ", "و": "وؤ"}
BETWEEN = "[\\u064B-\\u065F\\u0670\\u06D6-\\u06ED\\u0640]*?"


def core_pattern(token: Column) -> Column:
    """The pattern of a normalized token inside a word: letter variants with marks between
    them. What a normal form can hold needs no escape."""
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    one = lambda c: F.coalesce(F.element_at(F.create_map(*[x for k, v in VARIANTS.items() for x in (F.lit(k), F.lit(f"[{v}]"))]), c), c)
    return F.array_join(F.transform(letters, one), BETWEEN)


def label(types: Column | None, token: Column) -> Column:
    t = F.element_at(types, token) if types is not None else F.lit(None).cast("string")
    return F.when(F.coalesce(t, F.lit(FUZZY)) == NONE, FUZZY).otherwise(F.coalesce(t, F.lit(FUZZY)))


def word_ranges(text: Column | str, tokens: Column | str, types: Column | str | None = None) -> Column:
    """Ranges (start, end exclusive, token, matchType) for tokens without white space inside:
    of each word of the text, the first token that occurs in it. No token, or one whose normal
    form is empty, gives none; offsets count characters (code points)."""
    text, tokens = (F.col(c) if isinstance(c, str) else c for c in (text, tokens))
    types = F.col(types) if isinstance(types, str) else types
    patterns = F.filter(F.transform(tokens, lambda t: F.struct(t.alias("t"), core_pattern(normalize_arabic(t)).alias("p"))), lambda x: x["p"] != "")
    words = with_offsets(F.regexp_extract_all(text_or_empty(text), F.lit(PIECE), F.lit(0)))
    found = F.transform(words, lambda w: F.struct(w["start"].alias("start"), (w["end"] + 1).alias("end"), F.get(F.filter(patterns, lambda x: F.rlike(w["word"], x["p"])), F.lit(0))["t"].alias("token")))
    found = F.filter(found, lambda r: r["token"].isNotNull())
    out = F.transform(found, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["token"].alias("token"), label(types, r["token"]).alias("matchType")))
    return F.coalesce(out, F.array().cast(RANGES))


_ws = re.compile(f"[{WS}]".encode().decode("unicode_escape"))


def _normal(s: str) -> str:
    """``normalize_arabic`` for one token, without a session."""
    ws = f"[{WS}]".encode("ascii").decode("unicode_escape")
    s = re.sub("[ً-ٰٟۖ-ۜ۟-۪ۨ-ۼـ]", "", s.replace("ٱ", "ا"))
    s = s.translate(str.maketrans("إأآٱؤئى", "ااااءءي"))
    s = re.sub("[\r\n]+", " ", s)
    s = re.sub(f"[^ء-ي{ws[1:-1]}-]+", "", s)
    return re.sub(f"^{ws}+|{ws}+$", "", re.sub(f"{ws}{{2,}}", " ", s))


def overlap_ranges(text: str, tokens: list[str], types: dict[str, str] | None = None) -> list[tuple[int, int, str, str]]:
    """Ranges for any tokens: all matches, the longest first, then the leftmost, then the
    token named first; a match is taken if no taken one overlaps it."""
    between = "[ً-ٰٟۖ-ۭـ]*?"
    ws = f"[{WS}]".encode("ascii").decode("unicode_escape")
    solid = "[^" + ws[1:]
    every = []
    for token in tokens or []:
        norm = _normal(token)
        if not norm:
            continue
        core = between.join(f"[{VARIANTS[c]}]" if c in VARIANTS else re.escape(c) for c in norm)
        kind = (types or {}).get(token) or FUZZY
        every += [(m.start(), m.end(), token, FUZZY if kind == NONE else kind) for m in re.finditer(f"{solid}*{core}{solid}*", text)]
    every.sort(key=lambda r: (r[0] - r[1], r[0]))
    taken, out = [False] * len(text), []
    for r in every:
        if not any(taken[r[0] : r[1]]):
            taken[r[0] : r[1]] = [True] * (r[1] - r[0])
            out.append(r)
    return sorted(out)


def highlight(rows: DataFrame, *, text: str = "uthmani", tokens: str = "matchedTokens", types: str = "tokenTypes", out: str = "ranges") -> DataFrame:
    """``rows`` with the highlight ranges of ``text``. Rows whose tokens have no inner white
    space take built-in expressions, the others an Arrow function. To be applied to a page of
    results, not to all."""
    several = F.coalesce(F.exists(F.col(tokens), lambda t: normalize_arabic(t).rlike(f"[{WS}]")), F.lit(False))
    plain = rows.where(~several).withColumn(out, word_ranges(text, tokens, types))
    names = [*rows.columns, out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [overlap_ranges(x or "", [] if t is None else list(t), dict(k) if k is not None else None) for x, t, k in zip(b["__x"], b["__t"], b["__k"], strict=True)]
            yield pd.DataFrame({"__row": b["__row"], out: [[{"start": s, "end": e, "token": t, "matchType": m} for s, e, t, m in r] for r in found]})

    marked = rows.where(several).withColumn("__row", F.struct(*rows.columns))
    general = marked.select("__row", F.col(text).alias("__x"), F.col(tokens).alias("__t"), F.col(types).alias("__k")).mapInPandas(run, f"__row {marked.schema['__row'].dataType.simpleString()}, {out} {RANGES}")
    return plain.unionByName(general.select("__row.*", out).select(*names))


def parts(text: Column | str, ranges: Column | str) -> Column:
    """The text cut into (text, matchType or null) at the ranges; joined, they are the text."""
    text, ranges = (F.col(c) if isinstance(c, str) else c for c in (text, ranges))
    x = text_or_empty(text)
    piece = lambda a, b, t: F.struct(F.substring(x, a + 1, b - a).alias("text"), t.alias("matchType"))
    none = F.lit(None).cast("string")
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(ranges, i - 1)["end"])
    body = F.flatten(F.transform(ranges, lambda r, i: F.array(piece(before(i), r["start"], none), piece(r["start"], r["end"], r["matchType"]))))
    tail = F.array(piece(F.coalesce(F.element_at(F.transform(ranges, lambda r: r["end"]), -1), F.lit(0)), F.length(x), none))
    whole = F.array(F.struct(x.alias("text"), none.alias("matchType")))
    return F.when(F.coalesce(F.size(ranges), F.lit(0)) <= 0, whole).otherwise(F.filter(F.concat(body, tail), lambda p: p["text"] != "")).cast(PARTS)
