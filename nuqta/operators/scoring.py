"""What of a verse each token matches, and the score, type and labels that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import normalize_arabic
from ..schemas import EXACT, FUZZY, LEMMA, NONE, ROOT
from .corpus import Corpus
from .layers import Settle, lazily

NO_STRINGS = "cast(array() as array<string>)"


def text_tokens(words: Column, token: Column) -> Column:
    """Distinct stripped words whose normal form contains the token."""
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.contains(w["norm"], token)), lambda w: w["stripped"]))


def dictionary_tokens(words: Column, part: str, target: Column) -> Column:
    """Distinct raw words whose dictionary lemma or root contains the target."""
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.coalesce(F.contains(w[part], target), F.lit(False))), lambda w: w["word"]))


def morphology_tokens(elements: Column, target: Column) -> Column:
    """Distinct lemmas or roots, as given, whose normal form contains the target."""
    hit = F.transform(F.filter(elements, lambda x: F.contains(x["n"], target)), lambda x: x["s"])
    return F.coalesce(F.array_distinct(hit), F.expr(NO_STRINGS))


def positive_tokens(verses: DataFrame, mode: str, *, token: str = "token", target: str | None = None, dictionary: bool = False) -> Column:
    """The tokens of a verse (a row of ``Corpus.verse_arrays`` with the columns named) that
    match in ``mode`` text, lemma or root; none if the token is empty. ``dictionary``: words
    that the dictionary relates to the target come first, and the morphology's strings only
    where there are none."""
    if mode == "text":
        found = text_tokens(F.col("words"), normalize_arabic(token))
    else:
        goal = normalize_arabic(target)
        found = morphology_tokens(F.col("lemmas" if mode == "lemma" else "roots"), goal)
        if dictionary:
            own = dictionary_tokens(F.col("words"), f"word_{mode}", goal)
            found = F.when(F.size(own) > 0, own).otherwise(found)
        found = F.when(F.coalesce(F.col(target), F.lit("")) != "", found)
    return F.coalesce(F.when(normalize_arabic(token) != "", found), F.expr(NO_STRINGS))


def token_matches(results: DataFrame, tokens: DataFrame, corpus: Corpus, *, lemma: bool = True, root: bool = True, settle: Settle = lazily) -> DataFrame:
    """The rows of ``results`` (qid, gid, _pos, ...) once for each token of the query, with
    tpos, text, lemma and root: what the token matches in the verse."""
    asked = settle(tokens.join(corpus.entries.select("token", "norm_lemma", "norm_root"), "token", "left"))
    # only the verses found are shuffled, if any; a row without a gid has no words
    found = corpus.verse_arrays.where("gid is not null").join(results.select("_pos").distinct(), "_pos", "left_semi").drop("gid")
    rows = results.join(asked, "qid").join(found, "_pos", "left")
    none = F.expr(NO_STRINGS)
    text = F.coalesce(text_tokens(F.col("words"), F.col("token")), none)
    lemmas = F.coalesce(F.when(F.col("norm_lemma").isNotNull(), morphology_tokens(F.col("lemmas"), F.col("norm_lemma"))), none) if lemma else none
    if root:
        own = dictionary_tokens(F.col("words"), "word_root", F.col("norm_root"))
        found = F.when(F.size(own) > 0, own).otherwise(morphology_tokens(F.col("roots"), F.col("norm_root")))
        roots = F.coalesce(F.when(F.col("norm_root").isNotNull(), found), none)
    else:
        roots = none
    return rows.select(*results.columns, "tpos", text.alias("text"), lemmas.alias("lemma"), roots.alias("root"))


def fold_matches(matches: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """qid, gid, score, type, strings, exact and others from ``token_matches``, in token
    order, and the columns ``carry``, which are the same for all tokens of a result. The type is that of the first token with any match: exact if it matches text, else
    lemma if any token does, else root."""
    any_of = lambda x: (F.size(x["text"]) > 0) | (F.size(x["lemma"]) > 0) | (F.size(x["root"]) > 0)
    g = matches.groupBy("qid", "gid").agg(
        F.sum(3 * F.size("text") + 2 * F.size("lemma") + F.size("root")).cast("double").alias("score"),
        F.max(F.size("lemma") > 0).alias("any_lemma"),
        F.array_sort(F.collect_list(F.struct("tpos", "text", "lemma", "root"))).alias("t"),
        *[F.first(c).alias(c) for c in carry or []],
    )
    lead = F.element_at(F.filter("t", any_of), 1)
    kind = F.when(F.size(F.filter("t", any_of)) == 0, NONE).when(F.size(lead["text"]) > 0, EXACT).when(F.col("any_lemma"), LEMMA).otherwise(ROOT)
    label = lambda name, c: F.transform(c, lambda s: F.struct(s.alias("s"), F.lit(name).alias("t")))
    return g.select(
        "qid",
        "gid",
        *(carry or []),
        "score",
        kind.alias("type"),
        F.array_distinct(F.flatten(F.transform("t", lambda x: F.concat(x["text"], x["lemma"], x["root"])))).alias("strings"),
        F.array_distinct(F.flatten(F.transform("t", lambda x: x["text"]))).alias("exact"),
        F.flatten(F.transform("t", lambda x: F.concat(label(LEMMA, x["lemma"]), label(ROOT, x["root"])))).alias("others"),
    )


def string_type(s: Column) -> Column:
    """exact if any token yields the string as text, else what first yields it."""
    return F.when(F.array_contains(F.col("exact"), s), EXACT).otherwise(F.element_at(F.filter("others", lambda o: o["s"] == s), 1)["t"])


def score_results(results: DataFrame, tokens: DataFrame, corpus: Corpus, *, lemma: bool = True, root: bool = True, settle: Settle = lazily) -> DataFrame:
    """``results`` (qid, gid, _pos, fuzzyMatches, ...) with matchScore, matchType,
    matchedTokens and tokenTypes. Fuzzy matches count only where nothing else does: half a
    point a range, whose text becomes a matched token."""
    carry = [c for c in results.columns if c not in ("qid", "gid")]
    rows = fold_matches(token_matches(results, tokens, corpus, lemma=lemma, root=root, settle=settle), carry).join(corpus.verses.select("_pos", F.col("standard").alias("_standard"), F.col("uthmani").alias("_uthmani")), "_pos")
    is_fuzzy = (F.col("type") == NONE) & (F.coalesce(F.size("fuzzyMatches"), F.lit(0)) > 0)
    source = lambda m: F.when(m["key"] == "standard", F.col("_standard")).otherwise(F.col("_uthmani"))
    cut = F.flatten(F.transform("fuzzyMatches", lambda m: F.transform(m["indices"], lambda r: F.substring(source(m), r["start"] + 1, r["end"] - r["start"] + 1))))
    rows = rows.withColumn("segments", F.when(is_fuzzy, F.filter(cut, lambda s: s != "")).otherwise(F.expr(NO_STRINGS)))
    every = F.array_distinct(F.concat("strings", "segments"))
    return rows.select(
        *results.columns,
        (F.col("score") + 0.5 * F.size("segments")).alias("matchScore"),
        F.when(is_fuzzy, FUZZY).otherwise(F.col("type")).alias("matchType"),
        every.alias("matchedTokens"),
        F.map_from_arrays(every, F.transform(every, lambda s: F.when(F.array_contains("segments", s), FUZZY).otherwise(string_type(s)))).alias("tokenTypes"),
    )
