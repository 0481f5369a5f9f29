"""The layers of a search, for any number of queries at once: which verses each token
matches, and which verses match all tokens of a query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import clean_field_query, clean_query, tokenize
from .corpus import Corpus
from .fuzzy import FuzzyOptions, adaptive_cutoff, fuzzy_words


#: Rows that a single search fetches between its steps; larger steps stay in the plan.
SETTLED = 10_000
#: Letters of a token by which it is looked up in the vocabulary.
GRAM = 3
Settle = Callable[[DataFrame], DataFrame]


def lazily(df: DataFrame) -> DataFrame:
    return df


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a local table, which joins without a shuffle, if it has at most SETTLED rows;
    otherwise ``df`` as it is."""
    rows = df.limit(SETTLED + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows <= SETTLED else df


def query_tokens(queries: DataFrame, *, field_query: bool = False) -> DataFrame:
    """qid, tpos, token, n_tokens of every query that isn't empty when cleaned. Tokens that
    repeat stay."""
    clean = (clean_field_query if field_query else clean_query)("query")
    t = queries.select("qid", clean.alias("clean")).where("clean <> ''").select("qid", tokenize("clean").alias("tokens"))
    return t.select("qid", F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("tpos", "token"))


def containing(tokens: DataFrame, vocabulary: DataFrame, token: str, word: str, few: bool = False) -> DataFrame:
    """Pairs of distinct tokens and vocabulary words that contain them. A vocabulary, not the
    texts, is scanned, which grows far slower than these; its words meet the tokens by the
    letters a token begins with, GRAM at most. A ``few`` local tokens are looked for in one
    pass instead."""
    if few:
        return tokens.select(token).distinct().join(vocabulary, F.contains(F.col(word), F.col(token)))
    asked = tokens.select(token).distinct().withColumn("_gram", F.left(token, F.lit(GRAM)))
    n = F.length(word)
    own = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(word, i, F.lit(k)))
    grams = vocabulary.withColumn("_gram", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[own(k) for k in range(1, GRAM + 1)]))))
    return asked.join(grams, "_gram").where(F.contains(F.col(word), F.col(token))).drop("_gram")


def simple_matches(tokens: DataFrame, postings: DataFrame, vocabulary: DataFrame | None = None, settle: Settle = lazily) -> DataFrame:
    """qid, gid, _pos: the rows whose normalized field contains every token. A token has no
    white space, so that a hit lies within one word of the field."""
    vocabulary = vocabulary if vocabulary is not None else postings.select("norm_word").distinct()
    hits = settle(containing(tokens, vocabulary, "token", "norm_word", settle is not lazily)).join(postings, "norm_word").select("token", "gid", "_pos").distinct()
    # a query's repeated tokens ask for no more than one of them
    own = tokens.groupBy("qid").agg(F.collect_set("token").alias("set")).select("qid", F.size("set").alias("need"), F.explode("set").alias("token"))
    return own.join(hits, "token").groupBy("qid", "gid", "_pos").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n = need").select("qid", "gid", "_pos")


def simple_search(corpus: Corpus, queries: DataFrame, field: str = "standard") -> DataFrame:
    """qid with the whole rows of ``corpus.verses`` that match in ``field``."""
    postings = corpus.postings if field == "standard" else corpus.field_words(field)
    found = simple_matches(query_tokens(queries, field_query=True), postings)
    return found.select("qid", "_pos").join(corpus.verses, "_pos")


def linguistic_hits(tokens: DataFrame, corpus: Corpus, *, lemma: bool = True, root: bool = True, settle: Settle = lazily) -> DataFrame:
    """token, gid, rank (0: by lemma, 1: by root alone) for distinct tokens that the
    dictionary has."""
    entries = settle(tokens.select("token").distinct().join(corpus.entries, "token"))
    parts = []
    for on, kind, postings, rank in ((lemma, "lemma", corpus.lemma_postings, 0), (root, "root", corpus.root_postings, 1)):
        if not on:
            continue
        mine, theirs = f"target_{kind}", f"norm_{kind}"
        asked = entries.where(f"norm_{kind} is not null").select("token", F.col(theirs).alias(mine))
        near = settle(containing(asked, postings.select(theirs).distinct(), mine, theirs, settle is not lazily))
        parts.append(asked.join(near, mine).join(postings, theirs).select("token", "gid", F.lit(rank).alias("rank")))
    if not parts:
        return entries.select("token", F.lit(None).cast("long").alias("gid"), F.lit(0).alias("rank")).where("false")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # verses alone are searched
    return both.groupBy("token", "gid").agg(F.min("rank").alias("rank")).join(corpus.places.select("gid"), "gid", "left_semi")


def fuzzy_hits(tokens: DataFrame, corpus: Corpus, options: FuzzyOptions, settle: Settle = lazily) -> DataFrame:
    """token, gid, score, score_pos and matches: for distinct tokens, the verses with a near
    word. The matches are the words of the best score, field by field, of the last row of a
    gid."""
    near = settle(fuzzy_words(tokens.select("token").distinct(), corpus.raw_vocabulary, options))
    rows = near.join(corpus.raw_words, "word").select("token", "gid", "_pos", "field", "key", "start", "end", "score")
    best = rows.groupBy("token", "gid", "_pos").agg(
        F.min("score").alias("score"), F.array_sort(F.collect_list(F.struct("score", "field", "start", "end", "key"))).alias("all")
    )
    kept = adaptive_cutoff(best, options, "token")
    ranges = F.filter("all", lambda x: x["score"] == F.col("score"))
    by_key = lambda name: F.struct(
        F.lit(name).alias("key"), F.transform(F.filter(ranges, lambda x: x["key"] == name), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("indices")
    )
    kept = kept.withColumn("matches", F.filter(F.array(by_key("standard"), by_key("uthmani")), lambda m: F.size(m["indices"]) > 0))
    # the order of a gid is that of its first hit; its matches are those of its last
    order = F.struct("score", "_pos")
    return kept.groupBy("token", "gid").agg(F.min(order).alias("first"), F.max_by("matches", order).alias("matches")).select("token", "gid", F.col("first.score").alias("score"), F.col("first._pos").alias("score_pos"), "matches")


def token_hits(tokens: DataFrame, corpus: Corpus, *, lemma: bool = True, root: bool = True, fuzzy: FuzzyOptions | None = None, settle: Settle = lazily) -> DataFrame:
    """token, gid, rank, score, score_pos, matches: each distinct token's linguistic verses,
    or its fuzzy ones if it has none of these."""
    ling = settle(linguistic_hits(tokens, corpus, lemma=lemma, root=root, settle=settle))
    none = "cast(null as array<struct<key:string,indices:array<struct<start:int,end:int>>>>)"
    out = ling.select("token", "gid", "rank", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("score_pos"), F.expr(none).alias("matches"))
    if fuzzy is not None:
        rest = settle(tokens.select("token").distinct().join(ling.select("token").distinct(), "token", "left_anti"))
        hits = fuzzy_hits(rest, corpus, fuzzy, settle)
        out = out.unionByName(hits.select("token", "gid", F.lit(2).alias("rank"), F.col("score").cast("double").alias("score"), "score_pos", "matches"))
    return out


def intersect_tokens(tokens: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, gid of the verses that every token of the query hits, with the order that the
    first token gives them and all fuzzy matches in token order."""
    rows = tokens.join(hits, "token")
    first = F.min(F.when(F.col("tpos") == 0, F.struct("rank", "score", "score_pos"))).alias("first")
    found = rows.groupBy("qid", "gid").agg(
        F.count_distinct("tpos").alias("n"), F.first("n_tokens").alias("need"), first, F.array_sort(F.collect_list(F.when(F.col("matches").isNotNull(), F.struct("tpos", "matches")))).alias("m")
    )
    return found.where("n = need").select("qid", "gid", "first", F.flatten(F.transform("m", lambda x: x["matches"])).alias("fuzzyMatches"))


def union_layers(simple: DataFrame, advanced: DataFrame, corpus: Corpus) -> DataFrame:
    """qid, gid, _pos, layer (0: simple, 1: advanced), fuzzyMatches and the keys of ties. A
    verse in both layers counts as simple, and then has no fuzzy matches. A simple verse is
    the first matching row of its gid, an advanced one the last row of it."""
    s = simple.groupBy("qid", "gid").agg(F.min("_pos").alias("simple_pos"))
    a = advanced.join(corpus.places, "gid")
    both = s.join(a, ["qid", "gid"], "full")
    is_simple = F.col("simple_pos").isNotNull()
    tie = F.when(is_simple, F.struct(F.lit(0).alias("rank"), F.lit(0.0).alias("score"), F.col("simple_pos").alias("pos"))).otherwise(
        F.struct(F.col("first.rank").alias("rank"), F.col("first.score").alias("score"), F.when(F.col("first.rank") == 2, F.col("first.score_pos")).otherwise(F.col("first_pos")).alias("pos"))
    )
    return both.select(
        "qid",
        "gid",
        F.coalesce("simple_pos", "last_pos").alias("_pos"),
        F.when(is_simple, 0).otherwise(1).alias("layer"),
        F.when(~is_simple, F.col("fuzzyMatches")).alias("fuzzyMatches"),
        tie.alias("tie"),
    )
