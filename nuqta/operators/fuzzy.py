"""Approximate matching of a token inside a word: the least edit distance of the token to any
substring of the word, divided by the token's length. Locations don't matter; tokens under
three letters never match."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


@dataclass(frozen=True)
class FuzzyOptions:
    """``threshold``: worst score of a hit. A token that has a hit at ``good`` or better keeps
    only those at ``strict`` or better."""

    threshold: float = 0.5
    min_length: int = 3
    good: float = 0.25
    strict: float = 0.35


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def substring_distances(tokens: list[str], words: list[str]) -> np.ndarray:
    """Distance for each pair, all pairs at once: a column of the dynamic program a step of
    the words."""
    n = len(tokens)
    out = np.zeros(n, np.int32)
    if not n:
        return out
    size_t, size_w = (np.array([len(x) for x in xs]) for xs in (tokens, words))
    for m in np.unique(size_t):
        at = np.flatnonzero(size_t == m)
        at = at[np.argsort(size_w[at], kind="stable")]
        for part in np.array_split(at, max(1, len(at) // 4096)):
            wide = int(size_w[part].max()) if len(part) else 0
            t = code_points([tokens[i] for i in part]).reshape(len(part), m)
            w = np.zeros((len(part), wide), np.uint32)
            w[np.arange(wide) < size_w[part, None]] = code_points([words[i] for i in part])
            col = np.tile(np.arange(m + 1, dtype=np.int32), (len(part), 1))
            best = col[:, m].copy()
            for j in range(wide):
                before, col[:, 0] = col.copy(), 0
                for i in range(1, m + 1):
                    col[:, i] = np.minimum(np.minimum(before[:, i], col[:, i - 1]) + 1, before[:, i - 1] + (t[:, i - 1] != w[:, j]))
                best = np.where(j < size_w[part], np.minimum(best, col[:, m]), best)
            out[part] = best
    return out


def substring_distance(token: Column | str, word: Column | str) -> Column:
    """The distances as an Arrow function."""

    def run(token: pd.Series, word: pd.Series) -> pd.Series:
        return pd.Series(substring_distances(token.fillna("").tolist(), word.fillna("").tolist()), dtype="int32")

    return F.pandas_udf(run, IntegerType())(token, word)  # type: ignore[call-overload]


def native_distance(token: Column, word: Column) -> Column:
    """The same of built-in expressions; for short words only, as it tries every substring."""
    n = F.length(word)
    starts = F.sequence(F.lit(0), n)
    each = F.flatten(F.transform(starts, lambda a: F.transform(F.sequence(F.lit(0), n - a), lambda k: F.levenshtein(token, F.substring(word, a + 1, k)))))
    return F.array_min(each)


def letters(c: str) -> Column:
    """A 64-bit set of the code points in a text, modulo 64."""
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(x).bitwiseAND(63))
    return F.aggregate(F.split(c, ""), F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(F.when(x == "", F.lit(0).cast("long")).otherwise(one(x))))


def fuzzy_words(tokens: DataFrame, words: DataFrame, options: FuzzyOptions) -> DataFrame:
    """token, word, score: of every token with the words near enough. The tokens are a set of
    queries that is held against the whole vocabulary: at half its length in edits, a token
    has no part that a near word must share. Pairs are passed over on bounds of the
    distance, before any Python: a word's letters that are too few, or letters of the token
    that the word lacks, each of which is an edit."""
    t = tokens.where(F.length("token") >= options.min_length).withColumn("_t", letters("token"))
    w = words.withColumn("_w", letters("word"))
    edits = F.length("token") * options.threshold
    lacking = F.bit_count(F.col("_t").bitwiseAND(F.bitwise_not(F.col("_w"))))
    pairs = t.join(w, (F.length("word") >= F.length("token") - edits) & (lacking <= edits))
    scored = pairs.select("token", "word", (substring_distance("token", "word") / F.length("token")).alias("score"))
    return scored.where(F.col("score") <= options.threshold)


def adaptive_cutoff(hits: DataFrame, options: FuzzyOptions, *by: str) -> DataFrame:
    """The rows of ``hits`` at or below their group's cutoff, which is strict where the group
    has a good hit."""
    w = Window.partitionBy(*by)
    cut = F.when(F.min("score").over(w) <= options.good, options.strict).otherwise(options.threshold)
    return hits.withColumn("_cut", cut).where("score <= _cut").drop("_cut")
